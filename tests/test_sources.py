"""Readers, sinks, the SQLite source, configuration, and a whole run from files."""

import json
import sqlite3
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from rillflow import config as cfg
from rillflow.operators.pieces import numbered_pieces
from rillflow.operators.topology import topology
from rillflow.plans import workflows
from rillflow.sources import geopackage, readers, sinks


def test_gauge_csv(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text(
        "STAID,STANAME,DRAIN_SQKM,LAT_GAGE,LNG_GAGE,COMID,DA_VALID,EXTRA\n"
        "1234,,10.5,40,-80,77,True,x\n0123456789,Long,3,41,-81,78.0,false,y\n"
    )
    rows = {r.staid: r for r in readers.read_gauges(spark, str(path)).collect()}
    assert set(rows) == {"00001234", "0123456789"}
    assert rows["00001234"].name == "1234" and rows["0123456789"].name == "Long"
    assert rows["00001234"].reach_id == 77 and rows["0123456789"].reach_id == 78
    assert rows["00001234"].da_valid is True and rows["0123456789"].da_valid is False
    assert readers.checked_gauges(readers.read_gauges(spark, str(path)), True).count() == 2


def test_bad_gauges_fail(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("STAID,DRAIN_SQKM,LAT_GAGE\n1,2,3\n")
    with pytest.raises(KeyError):
        readers.read_gauges(spark, str(path))
    path = tmp_path / "h.csv"
    path.write_text("STAID,DRAIN_SQKM,LAT_GAGE,LNG_GAGE\n1,-2,3,4\n")
    with pytest.raises(Exception, match="positive"):
        readers.checked_gauges(readers.read_gauges(spark, str(path))).collect()


def test_geopackage_in_ranges(spark, tmp_path):
    path = str(tmp_path / "net.gpkg")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE flowpaths (fid INTEGER PRIMARY KEY, id TEXT, toid TEXT, tot_drainage_areasqkm REAL, geom BLOB)")
        con.executemany("INSERT INTO flowpaths VALUES (?,?,?,?,NULL)", [(i, f"wb-{i}", f"nex-{i // 2}" if i else None, i / 2) for i in range(25)])
    geopackage.register(spark)
    reader = spark.read.format("geopackage").option("table", "flowpaths").option("rowsPerTask", "7")
    df = reader.load(path)
    assert df.columns == ["fid", "id", "toid", "tot_drainage_areasqkm"] and df.count() == 25
    two = reader.option("columns", "id,toid").load(path)
    assert two.columns == ["id", "toid"]
    assert two.filter("toid IS NULL").count() == 1
    with pytest.raises(Exception, match="no table"):
        spark.read.format("geopackage").option("table", "absent").load(path).count()


def test_aligned_parameter_files(spark, tmp_path):
    for name, values in (("k", [9000.0, 8000.0, 7000.0]), ("x", [0.25, 0.25, 0.3]), ("ids", [30, 10, 20])):
        (tmp_path / name).write_text("\n".join(str(v) for v in values) + "\n")
    rows = readers.read_linear_parameters(spark, *[str(tmp_path / n) for n in ("k", "x", "ids")]).collect()
    assert {(r.reach_id, r.k, r.x) for r in rows} == {(30, 9000.0, 0.25), (10, 8000.0, 0.25), (20, 7000.0, 0.3)}
    (tmp_path / "short").write_text("1\n2\n")
    with pytest.raises(Exception, match="differ in length"):
        readers.read_linear_parameters(spark, str(tmp_path / "k"), str(tmp_path / "short"), str(tmp_path / "ids")).collect()


def test_connectivity(spark, tmp_path):
    (tmp_path / "c.csv").write_text("10,30\n20,30\n40,50\n30,50\n")
    got = {(r.reach_id, r.down_id) for r in readers.read_connectivity(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {(10, 30), (20, 30), (40, 50), (30, 50), (50, None)}


def test_station_ids(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" gauge_id ; name\n 1013500 ; a\n01022500; b\n")
    got = {r.staid for r in readers.read_station_ids(spark, str(tmp_path / "ids.txt"), ";", "gauge_id").collect()}
    assert got == {"01013500", "01022500"}


def test_clean_store(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1), 8.64), (1, datetime(2024, 2, 1), float("nan")), (2, datetime(2024, 1, 1), -3.0)]
    inflow = spark.createDataFrame(rows, "reach_id bigint, ts timestamp_ntz, qr double")
    areas = spark.createDataFrame([(1, 10.0), (2, 5.0)], "reach_id bigint, area_sqkm double")
    report = {r.month: r for r in sinks.clean_store(inflow, areas, str(tmp_path / "s"), "2", dry_run=True).collect()}
    assert report["2024-01"].n_negative == 1 and report["2024-02"].n_missing == 1
    assert not (tmp_path / "s").exists()
    sinks.clean_store(inflow, areas, str(tmp_path / "s"), "2")
    got = sorted(r.qr for r in spark.read.parquet(str(tmp_path / "s" / "version=2")).collect())
    assert got == pytest.approx([1e-6, 1e-6, 1.0])
    with pytest.raises(KeyError):
        sinks.clean_store(inflow, areas.filter("reach_id = 1"), str(tmp_path / "s"), "3")


def test_configuration(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"mode": "testing", "experiment": {"start_time": "1999/10/01", "end_time": "2000/09/30"}}))
    c = cfg.load_config(str(path), ["experiment.rho=90", "params.save_path=/tmp/x"])
    assert c.experiment.rho == 90 and c.params.save_path == "/tmp/x" and c.params.tau == 3
    for bad in ({"mode": "dreaming"}, {"colour": 1}, {"params": {"tua": 2}}, {"experiment": {"start_time": "2000/01/01", "end_time": "2000/01/05", "rho": 9}}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            cfg.load_config(str(path))


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    rng = np.random.default_rng(0)
    m, days = 15, 8
    reaches = [(k, k // 2, float(rng.uniform(2, 8)), float(rng.uniform(0.001, 0.01))) for k in range(1, m + 1)]
    reach = spark.createDataFrame(reaches, "COMID int, NextDownID int, lengthkm double, slope double")
    (root / "g.csv").write_text(
        "STAID,STANAME,DRAIN_SQKM,LAT_GAGE,LNG_GAGE,COMID,COMID_DRAIN_SQKM,COMID_UNITAREA_SQKM,ABS_DIFF,DA_VALID\n"
        + "\n".join(f"{k},g{k},90,40,-80,{k},100,20,10,True" for k in (1, 2, 9)) + "\n"
    )
    gauges = readers.read_gauges(spark, str(root / "g.csv"))
    assert workflows.build_network(reach, str(root / "net"), "merit", gauges) == 3
    attrs = spark.createDataFrame([(k, *map(float, rng.normal(size=2))) for k in range(1, m + 1)], "reach_id bigint, a double, b double")
    attrs.write.parquet(str(root / "attrs"))
    t0 = datetime(2000, 1, 1)
    inflow = spark.createDataFrame(
        [(k, t0 + timedelta(days=d), float(rng.gamma(1.0, 3.0))) for k in range(1, m + 1) for d in range(days)],
        "reach_id bigint, ts timestamp_ntz, qr double",
    )
    sinks.write_by_month(inflow, str(root / "inflow"))
    obs = [(f"{g:08d}", date(2000, 1, 1) + timedelta(days=d), float(rng.uniform(1, 40))) for g in (1, 2, 9) for d in range(days)]
    spark.createDataFrame(obs, "staid string, d date, streamflow double").write.parquet(str(root / "obs"))
    conf = {
        "geodataset": "merit",
        "data_sources": {
            "network": f"{root}/net", "reaches": f"{root}/net/reaches", "attributes": f"{root}/attrs", "statistics": f"{root}/stats",
            "streamflow": f"{root}/inflow", "observations": f"{root}/obs", "gages": f"{root}/g.csv",
        },
        "params": {"save_path": f"{root}/out"},
        "kan": {"input_var_names": ["a", "b"], "hidden_size": 4, "learnable_parameters": ["n", "q_spatial", "p_spatial"]},
        "experiment": {"start_time": "2000/01/01", "end_time": "2000/01/08", "batch_size": 2, "epochs": 1, "rho": 6, "warmup": 1},
    }
    (root / "c.json").write_text(json.dumps(conf))
    return root, cfg.load_config(str(root / "c.json"))


def test_network_round_trip(spark, files):
    root, _ = files
    order, pairs, name = readers.read_network(spark, str(root / "net"))
    assert name == "merit" and order.count() == 15 and pairs.count() == 14
    assert pairs.filter("dn_idx <= up_idx").count() == 0
    assert readers.read_gauge_subset(spark, str(root / "net"), "00000002").count() == 6
    assert readers.read_gauge_subset(spark, str(root / "net"), "00000009").count() == 0
    with pytest.raises(KeyError):
        readers.read_gauge_subset(spark, str(root / "net"), "99999999")
    with pytest.raises(FileExistsError):
        sinks.write_network(order, pairs, str(root / "net"), "merit")
    pieces = numbered_pieces(topology(order.select("reach_id", "down_id"))).order
    assert sinks.write_gauge_subsets(readers.read_gauges(spark, str(root / "g.csv")), pieces, order, str(root / "net")) == 0


def test_summed_run(spark, files):
    root, config = files
    summary = {r.metric: r for r in workflows.summed(spark, config).collect()}
    assert summary["nse"].valid == 3
    done = spark.read.parquet(str(root / "out" / "summed_q_prime"))
    total = spark.read.parquet(str(root / "inflow")).agg(F.sum("qr")).head()[0]
    assert done.filter("staid = '00000001'").agg(F.sum("pred")).head()[0] == pytest.approx(total)
    reports = list((root / "out").glob("metrics_summary_*/part-*.json"))
    body = json.loads(reports[0].read_text())
    assert body["total_gauges"] == 3 and body["valid_gauge_counts"]["nse"] == 3 and "flv_percent" in body["metrics_summary"]


def test_route_and_test_runs(spark, files):
    root, config = files
    row = workflows.route(spark, config).head()
    assert row.n_reaches == 15 and row.min_q > 0
    log = workflows.test(spark, config).head()
    assert log.mean_rmse > 0
    assert spark.read.parquet(str(root / "out" / "model_test")).select("staid").distinct().count() == 3


def test_train_run(spark, files):
    _, config = files
    path = workflows.train(spark, config)
    assert path.endswith("epoch_1_batch_0")


def test_geometry_run(spark, files):
    _, config = files
    out = workflows.geometry(spark, config)
    assert out.count() == 15 and out.filter("depth_mean IS NULL").count() == 0
    assert len(out.columns) == 5 + 24
