"""Round trips through sinks and sources, gauge tables, sampling."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.network_queries import BRIDGE, ORDER
from catalog.registry import ORACLES, query
from catalog.stand_in import network, table, with_tables
from rillflow.operators.cleaning import NATIVE_AND_HYDROATLAS
from rillflow.operators import gauges, network as net, references, summaries
from rillflow.scratch import scratch_path
from rillflow.sources import readers, sinks


RAW_ATTRIBUTES = [source for _, source in NATIVE_AND_HYDROATLAS]


@query(
    "k_network_round_trip",
    with_tables("reach", recursive=True, body=ORDER + "SELECT dn_id, up_id, dn_idx, up_idx FROM pairs"),
)
def k_network_round_trip(spark, sf_dir):
    t = network(spark, sf_dir)
    path = scratch_path(spark, "network")
    sinks.write_network(t["order"], t["pairs"], path, "merit")
    return readers.read_network(spark, path)[1]


@query(
    "k_gauge_subsets",
    with_tables(
        "reach",
        "gauge",
        recursive=True,
        body=ORDER + BRIDGE + """SELECT b.staid, count(p.dn_id) AS n_links, max(p.dn_idx) AS last_idx FROM bridge b
          LEFT JOIN pairs p ON p.dn_id = b.reach_id GROUP BY b.staid""",
    ),
)
def k_gauge_subsets(spark, sf_dir):
    """Subsets written in two rounds; gauges of the first round are not written again."""
    t, g = network(spark, sf_dir), table(spark, sf_dir, "gauge")
    path = scratch_path(spark, "subsets")
    sinks.write_labelled_pairs(t["pairs"], t["pieces"].order, path)
    sinks.write_gauge_subsets(g.filter("da_valid"), t["pieces"].order, t["order"], path)
    sinks.write_gauge_subsets(g, t["pieces"].order, t["order"], path)
    stored = readers.read_gauge_subsets(spark, path).groupBy("staid").agg(F.count("*").alias("n"), F.max("dn_idx").alias("last_idx"))
    return spark.read.parquet(f"{path}/gauges").join(stored, "staid", "left").select(
        "staid", F.coalesce("n", F.lit(0)).alias("n_links"), "last_idx"
    )


@query(
    "k_reach_attributes",
    with_tables(
        "reach",
        "attributes",
        recursive=True,
        body=ORDER + "SELECT t.reach_id, t.topo_idx, " + ", ".join(f"CAST(a.{n} AS FLOAT) AS {n}" for n in RAW_ATTRIBUTES)
        + " FROM topo t LEFT JOIN attributes a ON a.reach_id = t.reach_id",
    ),
)
def k_reach_attributes(spark, sf_dir):
    return sinks.reach_attributes(network(spark, sf_dir)["order"], table(spark, sf_dir, "attributes"), RAW_ATTRIBUTES)


@query(
    "s_inflow_period",
    with_tables(
        "gauge",
        "inflow_hourly",
        body="""SELECT reach_id, ts, round(qr, 9) AS qr FROM inflow_hourly WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'
          AND reach_id IN (SELECT reach_id FROM gauge)""",
    ),
)
def s_inflow_period(spark, sf_dir):
    """Inflow stored by month, read back for the gauges' reaches and ten days."""
    path = scratch_path(spark, "inflow")
    sinks.write_by_month(table(spark, sf_dir, "inflow_hourly"), path)
    rows = readers.read_inflow(spark, path, table(spark, sf_dir, "gauge"), datetime(2024, 1, 10), datetime(2024, 1, 20))
    return rows.withColumn("qr", F.round("qr", 9))


@query(
    "s_observations",
    with_tables(
        "gauge",
        "observed",
        body="""SELECT o.staid, o.d, round(o.streamflow * 0.0283168, 9) AS streamflow FROM observed o JOIN gauge g USING (staid)
          WHERE o.d BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND g.da_valid""",
    ),
)
def s_observations(spark, sf_dir):
    from datetime import date

    path = scratch_path(spark, "observed")
    table(spark, sf_dir, "observed").write.parquet(path)
    wanted = table(spark, sf_dir, "gauge").filter("da_valid")
    rows = readers.read_observations(spark, path, wanted, date(2024, 1, 5), date(2024, 1, 25), cubic_feet=True)
    return rows.withColumn("streamflow", F.round("streamflow", 9))


@query(
    "k_clean_store",
    with_tables(
        "inflow_hourly",
        "reach",
        body="""SELECT i.reach_id, i.ts, round(greatest(i.qr * r.length_m * 1000e0 / 86400e0, 0.000001e0), 9) AS qr FROM inflow_hourly i JOIN reach r USING (reach_id)""",
    ),
)
def k_clean_store(spark, sf_dir):
    path = scratch_path(spark, "clean")
    areas = table(spark, sf_dir, "reach").select("reach_id", F.col("length_m").alias("area_sqkm"))
    sinks.clean_store(table(spark, sf_dir, "inflow_hourly"), areas, path, "2")
    return spark.read.parquet(f"{path}/version=2").select("reach_id", "ts", F.round("qr", 9).alias("qr"))


@query(
    "k_statistics_cache",
    with_tables(
        "attributes",
        body=" UNION ALL ".join(
            f"""SELECT '{n}' AS attr, round(min({n}), 6) AS min, round(max({n}), 6) AS max, round(avg({n}), 6) AS mean, round(stddev_pop({n}), 6) AS std,
              round(quantile_cont({n}, 0.1), 6) AS p10, round(quantile_cont({n}, 0.9), 6) AS p90 FROM attributes"""
            for n in RAW_ATTRIBUTES
        ),
    ),
)
def k_statistics_cache(spark, sf_dir):
    path = scratch_path(spark, "statistics")
    attributes = table(spark, sf_dir, "attributes")
    sinks.cached_statistics(attributes, RAW_ATTRIBUTES, path)
    stats = sinks.cached_statistics(attributes, RAW_ATTRIBUTES, path)
    return stats.select("attr", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std", "p10", "p90")])


@query(
    "u_zones",
    with_tables(
        "inflow_daily",
        body="SELECT zone, count(*) AS n, round(sum(qr), 6) AS volume FROM (SELECT 71 + CAST(reach_id % 7 AS INT) AS zone, qr FROM inflow_daily) GROUP BY zone",
    ),
)
def u_zones(spark, sf_dir):
    """One folder per zone, read back as a single table."""
    zones = tuple(str(z) for z in range(71, 78))
    path = scratch_path(spark, "zones")
    rows = table(spark, sf_dir, "inflow_daily").select("reach_id", F.col("d").cast("timestamp_ntz").alias("ts"), "qr")
    for k, z in enumerate(zones):
        rows.filter(F.col("reach_id") % 7 == k).write.parquet(f"{path}/{z}")
    whole = readers.read_zones(spark, path, zones)
    zone = (F.lit(71) + (F.col("reach_id") % 7).cast("int")).alias("zone")
    return whole.groupBy(zone).agg(F.count("*").alias("n"), F.round(F.sum("qr"), 6).alias("volume"))


@query(
    "j_reference_areas",
    with_tables(
        "gauge",
        "reach",
        body="""SELECT g.staid, round(abs(g.drain_sqkm - r.length_m), 6) AS abs_diff, abs(g.drain_sqkm - r.length_m) <= greatest(r.slope * 1000, 100.0) AS da_valid,
          round(CASE WHEN g.drain_sqkm < r.length_m AND r.length_m - g.drain_sqkm < r.slope * 1000 THEN (r.slope * 1000 - (r.length_m - g.drain_sqkm)) / (r.slope * 1000) ELSE 1.0 END, 9) AS flow_scale
          FROM gauge g JOIN reach r ON r.reach_id = g.reach_id""",
    ),
)
def j_reference_areas(spark, sf_dir):
    g = table(spark, sf_dir, "gauge").select("staid", "reach_id", "drain_sqkm")
    r = table(spark, sf_dir, "reach")
    out = references.with_reach_areas(
        g, r.select("reach_id", F.col("length_m").alias("uparea")), r.select("reach_id", (F.col("slope") * 1000).alias("unitarea"))
    )
    return out.select("staid", F.round("abs_diff", 6).alias("abs_diff"), "da_valid", F.round("flow_scale", 9).alias("flow_scale"))


@query(
    "j_point_in_polygon",
    """WITH p AS (SELECT c_custkey AS point_id, (c_acctbal + 1000) / 100.0 AS lon, (c_custkey * 7 % 1000) / 25.0 AS lat FROM customer)
    , box AS (SELECT n_nationkey AS poly_id, n_nationkey * 4.3 AS x0, n_nationkey * 4.3 + 3.9 AS x1, 1.7 + n_regionkey AS y0, 31.3 + n_regionkey AS y1 FROM nation)
    SELECT point_id, min(poly_id) AS poly_id FROM p LEFT JOIN box ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 GROUP BY point_id""",
)
def j_point_in_polygon(spark, sf_dir):
    """Customers placed on a map of overlapping-free rectangles, one per nation."""
    points = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("point_id"), ((F.col("c_acctbal") + 1000) / 100.0).alias("lon"), (F.col("c_custkey") * 7 % 1000 / 25.0).alias("lat")
    )
    x0, y0 = F.col("n_nationkey") * F.lit(4.3), F.lit(1.7) + F.col("n_regionkey")
    x1, y1 = x0 + 3.9, F.lit(31.3) + F.col("n_regionkey")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    rings = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("poly_id"), F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("ring")
    )
    return references.points_in_polygons(points, rings, cell=2.0).select("point_id", "poly_id")


@query(
    "w_batches",
    with_tables(
        "gauge",
        body="SELECT CAST(b AS BIGINT) AS batch, 4 AS n FROM range((SELECT CAST(floor(count(*) / 4) AS BIGINT) FROM gauge)) t(b)",
    ),
)
def w_batches(spark, sf_dir):
    batches = gauges.sample_batches(table(spark, sf_dir, "gauge"), 4, seed=42)
    return batches.groupBy("batch").agg(F.count("*").cast("int").alias("n"))


@query(
    "e_routing_summary",
    with_tables(
        "inflow_hourly",
        body="SELECT count(DISTINCT reach_id) AS n_reaches, min(ts) AS first_ts, max(ts) AS last_ts, round(min(qr), 6) AS min_q, round(avg(qr), 6) AS mean_q, round(max(qr), 6) AS max_q FROM inflow_hourly",
    ),
)
def e_routing_summary(spark, sf_dir):
    out = summaries.routing_summary(table(spark, sf_dir, "inflow_hourly").withColumnRenamed("qr", "q"))
    return out.select("n_reaches", "first_ts", "last_ts", *[F.round(c, 6).alias(c) for c in ("min_q", "mean_q", "max_q")])


@query(
    "g_dense_adjacency",
    with_tables(
        "reach",
        body="""SELECT down_id AS dn_id, count(*) FILTER (reach_id % 2 = 0) AS even_side, count(*) FILTER (reach_id % 2 = 1) AS odd_side
          FROM reach WHERE down_id IS NOT NULL GROUP BY 1""",
    ),
)
def g_dense_adjacency(spark, sf_dir):
    """Matrix form with two columns: links are pivoted by the side from which they enter."""
    sides = network(spark, sf_dir)["pairs"].select(
        "dn_id", F.when(F.col("up_id") % 2 == 0, "even_side").otherwise("odd_side").alias("up_id")
    )
    return net.dense_adjacency(sides)


@query(
    "e_score_json",
    "SELECT gauge, nse, kge, corr FROM (" + ORACLES["e_nse_kge"] + ")",
)
def e_score_json(spark, sf_dir):
    """Scores read back from the JSON texts."""
    from rillflow.operators.metrics import moment_scores

    texts = sinks.scores_as_json(moment_scores(table(spark, sf_dir, "series")))
    row = F.from_json("body", "gauge bigint, nse double, kge double, corr double").alias("s")
    return texts.select(row).select("s.gauge", *[(F.round(f"s.{c}", 6) + 0.0).alias(c) for c in ("nse", "kge", "corr")])


FLOWPATH_TABLE = """
SELECT concat('wb-', reach_id) AS id, length_m AS Length_m, slope AS So, top_width AS TopWdth, side_slope AS ChSlp, x AS MusX
FROM reach WHERE reach_id % 11 <> 0"""
STRING_ORDER = """, num AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM nexus_network WHERE id LIKE 'wb-%')
, link AS (SELECT DISTINCT a.id AS up_id, b.toid AS dn_id FROM nexus_network a JOIN nexus_network b ON a.toid = b.id
    WHERE a.id LIKE 'wb-%' AND a.toid LIKE 'nex-%' AND b.toid LIKE 'wb-%')
, flow AS (SELECT u.id, u.n, l.dn_id FROM num u LEFT JOIN link l ON l.up_id = u.id)
, way AS (SELECT id, id AS below, 0 AS hops FROM flow UNION ALL SELECT w.id, f.dn_id, w.hops + 1 FROM way w JOIN flow f ON f.id = w.below WHERE f.dn_id IS NOT NULL)
, shape AS (SELECT below AS id, max(hops) AS level, count(*) AS size FROM way GROUP BY 1)
, topo AS (SELECT f.id, f.dn_id, s.level, row_number() OVER (ORDER BY CASE WHEN s.size = 1 AND f.dn_id IS NULL THEN 1 ELSE 0 END, s.level, f.n) - 1 AS topo_idx
    FROM flow f JOIN shape s USING (id))
"""


def _string_network(spark, sf_dir) -> str:
    """Folder of a network that is built from string ids, links, attributes and marked gauges."""
    from rillflow.plans.workflows import build_string_network

    rows, reach = table(spark, sf_dir, "nexus_network"), table(spark, sf_dir, "reach")
    path = scratch_path(spark, "string-network")
    attributes = spark.sql(FLOWPATH_TABLE.replace("FROM reach", "FROM {reach}"), reach=reach)
    build_string_network(rows.filter(F.col("id").startswith("wb-")), rows, path, "lynker", attributes, table(spark, sf_dir, "gauge"))
    return path


@query(
    "k_lynker_build",
    with_tables(
        "nexus_network",
        recursive=True,
        body=STRING_ORDER + """SELECT t.id, t.dn_id, CAST(t.level AS BIGINT) AS level, t.topo_idx, CAST(d.topo_idx AS BIGINT) AS dn_idx FROM topo t
          LEFT JOIN topo d ON d.id = t.dn_id""",
    ),
)
def k_lynker_build(spark, sf_dir):
    """String ids, junctions collapsed, order and adjacency written and read back."""
    order, pairs, _ = readers.read_network(spark, _string_network(spark, sf_dir))
    names = order.select(F.col("reach_id").alias("down_id"), F.col("id").alias("dn_id"))
    linked = pairs.select(F.col("up_id").alias("reach_id"), F.col("dn_id").alias("down_id"), "dn_idx").join(names, "down_id")
    return order.join(linked.select("reach_id", "dn_id", "dn_idx"), "reach_id", "left").select("id", "dn_id", "level", "topo_idx", "dn_idx")


@query(
    "k_lynker_attributes",
    with_tables(
        "nexus_network",
        recursive=True,
        body=STRING_ORDER + f""", attrs AS ({FLOWPATH_TABLE})
        SELECT t.id, t.topo_idx, """ + ", ".join(f"CAST(a.{c} AS FLOAT) AS {n}" for c, n in sinks.FLOWPATH_ATTRIBUTES.items()) + """,
          coalesce(w.toid, '') AS toid FROM topo t LEFT JOIN attrs a ON a.id = t.id LEFT JOIN nexus_network w ON w.id = t.id""",
    ),
)
def k_lynker_attributes(spark, sf_dir):
    """Five attributes and the target of every flowpath, in the stored order."""
    return readers.read_table(spark, f"{_string_network(spark, sf_dir)}/reaches")


@query(
    "k_lynker_gauges",
    with_tables(
        "nexus_network",
        "gauge",
        recursive=True,
        body=STRING_ORDER + """, place AS (SELECT staid, id FROM (SELECT g.staid, w.id,
            row_number() OVER (PARTITION BY g.staid ORDER BY abs(w.tot_drainage_areasqkm - g.drain_sqkm), w.id) AS rn
          FROM gauge g JOIN nexus_network w ON w.hl_uri = 'gages-' || g.staid WHERE w.id LIKE 'wb-%') WHERE rn = 1)
        SELECT p.staid, t.topo_idx AS gauge_idx, count(u.id) - 1 AS n_links FROM place p JOIN topo t ON t.id = p.id JOIN way u ON u.below = p.id GROUP BY 1, 2""",
    ),
)
def k_lynker_gauges(spark, sf_dir):
    """Gauges placed by their marks, and the links above each of them."""
    path = _string_network(spark, sf_dir)
    links = readers.read_gauge_subsets(spark, path).groupBy("staid").agg(F.count("*").alias("n"))
    stored = readers.read_table(spark, f"{path}/gauges").join(links, "staid", "left")
    return stored.select("staid", "gauge_idx", F.coalesce("n", F.lit(0)).alias("n_links"))


@query(
    "g_upstream_ids",
    with_tables(
        "nexus_network",
        recursive=True,
        body=STRING_ORDER + "SELECT dn_id AS id, string_agg(up_id, ',' ORDER BY up_id) AS up_ids FROM link GROUP BY 1",
    ),
)
def g_upstream_ids(spark, sf_dir):
    return net.upstream_ids(table(spark, sf_dir, "nexus_network")).select("id", F.array_join("up_ids", ",").alias("up_ids"))


@query(
    "f_in_store",
    with_tables("gauge", "observed", body="SELECT staid FROM gauge WHERE staid IN (SELECT staid FROM observed WHERE streamflow > 300)"),
)
def f_in_store(spark, sf_dir):
    return gauges.in_store(table(spark, sf_dir, "gauge"), table(spark, sf_dir, "observed").filter("streamflow > 300")).select("staid")


@query(
    "g_batch_pairs",
    with_tables(
        "reach",
        "gauge",
        recursive=True,
        body=ORDER + BRIDGE + """SELECT DISTINCT p.dn_idx, p.up_idx FROM pairs p JOIN bridge b ON b.reach_id = p.dn_id JOIN gauge g ON g.staid = b.staid AND g.da_valid""",
    ),
)
def g_batch_pairs(spark, sf_dir):
    """Links of all gauges of a batch, each once."""
    t, g = network(spark, sf_dir), table(spark, sf_dir, "gauge")
    subsets = net.subset_pairs(net.gauge_intervals(t["pieces"].order, g), net.labelled_pairs(t["pairs"], t["pieces"].order))
    return net.batch_pairs(subsets, g.filter("da_valid"))
