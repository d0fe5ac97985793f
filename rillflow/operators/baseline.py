"""Unrouted baseline: inflow summed over everything upstream of a gauge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.values import null_if_nan
from rillflow.operators.network import gauge_forest
from rillflow.operators.topology import accumulate, topology
from rillflow.scratch import by_key, store


def gauge_structure(flow: DataFrame, gauges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables for the baseline: nearest gauge of each reach, topology of the gauges."""
    tree, segment = gauge_forest(flow, gauges)
    return topology(tree), store(segment, "segment")


def summed_inflow(
    inflow: DataFrame, gauges: DataFrame, calendar: DataFrame, gauge_topo: DataFrame, segment: DataFrame
) -> DataFrame:
    """``staid, d, pred``: sum of all upstream inflow per gauge and day, 0 when all is missing.

    ``calendar`` is gapless; its ends limit the scan of the inflow.

    The long inflow table is read once and at once reduced to one row per (gauge, day),
    by the nearest gauge below each reach; only these few rows then move from gauge to
    gauge. No row is repeated for each of the nested gauges that it counts towards.
    """
    first, last = calendar.agg(F.min("d")).scalar(), calendar.agg(F.max("d")).scalar()
    local = (
        inflow.filter((F.col("d") >= first) & (F.col("d") <= last))
        .join(by_key(segment), "reach_id")
        .groupBy(F.col("marked_id").alias("reach_id"), "d")
        .agg(F.sum(null_if_nan(F.col("qr"))).alias("_s"))
    )
    # one row per gauge reach and day, whether or not there was inflow
    grid = gauge_topo.select("reach_id", F.explode(F.sequence(first, last)).alias("d"))
    dense = grid.join(by_key(local), ["reach_id", "d"], "left").select("reach_id", "d", F.coalesce("_s", F.lit(0.0)).alias("pred"))
    total = accumulate(dense, gauge_topo, ["d"], "pred")
    ids = gauges.select("staid", F.col("reach_id").cast("long").alias("reach_id"))
    return ids.join(by_key(total), "reach_id").select("staid", "d", "pred")


def with_observations(pred: DataFrame, obs: DataFrame) -> DataFrame:
    """Predictions next to observations of the same gauge and day (NULL where there is none)."""
    o = obs.select("staid", "d", null_if_nan(F.col("streamflow")).alias("target"))
    return pred.join(by_key(o), ["staid", "d"], "left")
