"""Discharge by accumulation of inflow, without routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.hydraulics import MINIMUMS, at_least
from rillflow.functions.values import MISSING_INFLOW, null_if_nan
from rillflow.operators.pieces import Pieces, upstream_sums
from rillflow.scratch import store


def hot_start(inflow: DataFrame, pieces: Pieces, discharge_min: float = MINIMUMS["discharge"]) -> DataFrame:
    """``reach_id, q``: initial discharge, the inflow of one instant summed over everything upstream."""
    q = inflow.select("reach_id", null_if_nan(F.col("qr")).alias("q"))
    total = upstream_sums(q, pieces, ["q"], MISSING_INFLOW)
    return total.select("reach_id", at_least(F.col("q"), discharge_min).alias("q"))


DAYS_PER_ROW = 16


def daily_discharge(
    inflow: DataFrame, pieces: Pieces, days: DataFrame, discharge_min: float = MINIMUMS["discharge"]
) -> DataFrame:
    """``reach_id, d, q`` for every reach and day of a gapless calendar; inflow is floored before it is summed.

    Runs of days travel as columns of one row. The inflow is brought to runs once; the grid of
    reaches and runs is shuffled once, by piece.
    """
    first, last = days.agg(F.min("d"), F.max("d")).head()
    names = [f"_q{i}" for i in range(DAYS_PER_ROW)]
    offset = F.date_diff("d", F.lit(first))
    inside = inflow.filter((F.col("d") >= F.lit(first)) & (F.col("d") <= F.lit(last)))
    slots = inside.select(
        "reach_id", F.floor(offset / DAYS_PER_ROW).alias("_run"), F.pmod(offset, F.lit(DAYS_PER_ROW)).alias("_i"), null_if_nan(F.col("qr")).alias("qr")
    )
    floored = F.max(at_least(F.col("qr"), discharge_min))
    wide = slots.groupBy("reach_id", "_run").pivot("_i", list(range(DAYS_PER_ROW))).agg(floored)
    wide = store(wide.toDF("reach_id", "_run", *names), "runs")
    runs = F.sequence(F.lit(0).cast("long"), F.lit((last - first).days // DAYS_PER_ROW).cast("long"))
    total = upstream_sums(wide, pieces, names, max(MISSING_INFLOW, discharge_min), ["_run"], lambda df: df.withColumn("_run", F.explode(runs)))
    day = F.date_add(F.lit(first), (F.col("_run") * DAYS_PER_ROW + F.col("_i")).cast("int"))
    long = total.select("reach_id", "_run", F.posexplode(F.array(*names)).alias("_i", "_q"))
    return long.select("reach_id", day.alias("d"), at_least(F.col("_q"), discharge_min).alias("q")).filter(F.col("d") <= F.lit(last))
