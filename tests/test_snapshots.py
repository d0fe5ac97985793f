"""Snapshots of a table: earlier ones stay, torn writes are not seen, coverage comes from the log."""

from datetime import datetime, timedelta

import pytest
from rillflow.sources import snapshots as snap

HOUR = timedelta(hours=1)
START = datetime(2024, 1, 1)


def series(spark, first, n, value):
    rows = [(1, START + (first + k) * HOUR, float(value)) for k in range(n)]
    return spark.createDataFrame(rows, "reach_id long, ts timestamp, q double")


def values(df):
    return sorted(r.q for r in df.collect())


def test_earlier_snapshots_and_branches_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    assert snap.snapshots(spark, path).count() == 0
    assert snap.write_snapshot(series(spark, 0, 2, 1), path) == 0
    assert snap.write_snapshot(series(spark, 2, 3, 2), path, append=True) == 1
    assert snap.write_snapshot(series(spark, 0, 1, 9), path, branch="trial", append=True) == 2
    assert snap.write_snapshot(series(spark, 0, 1, 5), path) == 3
    assert values(snap.read_snapshot(spark, path, number=0)) == [1, 1]
    assert values(snap.read_snapshot(spark, path, number=1)) == [1, 1, 2, 2, 2]
    assert values(snap.read_snapshot(spark, path)) == [5]
    assert values(snap.read_snapshot(spark, path, "trial")) == [9]
    with pytest.raises(KeyError):
        snap.read_snapshot(spark, path, number=2)  # of the other branch
    with pytest.raises(KeyError):
        snap.read_snapshot(spark, path, "absent")


def test_a_torn_write_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    snap.write_snapshot(series(spark, 0, 2, 1), path)
    series(spark, 0, 4, 7).write.parquet(f"{path}/data/torn")  # ended before its row in the log
    assert values(snap.read_snapshot(spark, path)) == [1, 1]
    assert snap.write_snapshot(series(spark, 2, 1, 3), path, append=True) == 1
    assert values(snap.read_snapshot(spark, path)) == [1, 1, 3]


def test_coverage_from_the_log(spark, tmp_path):
    path = str(tmp_path / "t")
    snap.write_snapshot(series(spark, 0, 24, 1), path)
    snap.write_snapshot(series(spark, 24, 24, 2), path, append=True)
    whole = snap.read_covered(spark, path, START, START + 48 * HOUR, HOUR)
    assert whole.count() == 48
    assert snap.read_covered(spark, path, START + 23 * HOUR, START + 25 * HOUR, HOUR).count() == 2
    for start, end in ((START, START + 49 * HOUR), (START - HOUR, START + HOUR)):
        with pytest.raises(ValueError, match="not covered"):
            snap.read_covered(spark, path, start, end, HOUR)


def test_empty_tables_and_rows_without_time(spark, tmp_path):
    path = str(tmp_path / "t")
    snap.write_snapshot(series(spark, 0, 2, 1).limit(0), path)
    assert snap.read_snapshot(spark, path).count() == 0
    with pytest.raises(ValueError, match="not covered"):
        snap.read_covered(spark, path, START, START + HOUR, HOUR)
    unknown = spark.createDataFrame([(1, None, 4.0), (1, START, 6.0)], "reach_id long, ts timestamp, q double")
    snap.write_snapshot(unknown, path, append=True)
    row = snap.find_snapshot(spark, path)
    assert (row.n_rows, row.first, row.last) == (2, START, START)
    assert values(snap.read_covered(spark, path, START, START + HOUR, HOUR)) == [6]
