"""Descriptive tables behind the reports and figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.hydraulics import MINIMUMS, at_least, trapezoid
from rillflow.functions.values import clip, finite_or_null, null_if_nan
from rillflow.operators.ranking import quantiles, row_numbers

# Drainage-area classes in km2, right-closed
AREA_EDGES = (0, 1000, 5000, 10000, 30000, 50000)
GEOMETRY = ("depth", "top_width", "bottom_width", "side_slope", "hydraulic_radius", "discharge")


def cumulative_distribution(df: DataFrame, value: str, key: str, group: list[str] | None = None) -> DataFrame:
    """Sorted values with rank i/(n-1)."""
    group = group or []
    kept = df.select(*group, key, null_if_nan(F.col(value)).alias(value)).filter(F.col(value).isNotNull())
    ranked = row_numbers(kept, [F.col(value), F.col(key)], group)
    share = F.try_divide((F.col("rn") - 1).cast("double"), (F.col("rn_total") - 1).cast("double"))
    return ranked.select(*group, key, value, F.coalesce(share, F.lit(0.0)).alias("cdf"))


def area_class(area: Column, edges: tuple[int, ...] = AREA_EDGES) -> Column:
    """Right-closed class label ``lo-hi``; NULL outside the edges."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(edges, edges[1:], strict=False))):
        out = F.when((area > lo) & (area <= hi), F.lit(f"{lo}-{hi}")).otherwise(out)
    return out


BOX = {"p05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "p95": 0.95}


def box_statistics(df: DataFrame, value: str, group: list[str], bounds: tuple[float, float] | None = None) -> DataFrame:
    """Whiskers at 5 and 95 percent, quartiles, median and count, values clipped first if asked for."""
    if not group:
        raise ValueError("box statistics need at least one grouping column")
    v = null_if_nan(F.col(value))
    if bounds:
        v = clip(v, *bounds)
    rows = df.select(*group, v.alias("_x"))
    counts = rows.groupBy(*group).agg(F.count("_x").alias("n"))
    return counts.join(quantiles(rows, "_x", BOX, group), group, "left").select(*group, *BOX, "n")


def score_change(left: DataFrame, right: DataFrame, key: str, score: str) -> DataFrame:
    """Difference of a score between two models, clipped to [-1, 1]."""
    other = right.select(key, F.col(score).alias("_o"))
    return left.join(other, key).select(key, clip(F.col(score) - F.col("_o"), -1.0, 1.0).alias("delta"))


def color_limit(delta: DataFrame) -> DataFrame:
    return delta.agg(F.greatest(F.abs(F.min("delta")), F.abs(F.max("delta")), F.lit(0.1)).alias("limit"))


def log_histogram(df: DataFrame, value: str, low: float = 0.1, high: float = 1000.0, bins: int = 50) -> DataFrame:
    """Counts per logarithmic bin, the last bin closed on both sides."""
    width = (math.log10(high) - math.log10(low)) / bins
    pos = F.floor((F.log10(F.col(value)) - F.lit(math.log10(low))) / F.lit(width))
    return (
        df.filter((F.col(value) >= low) & (F.col(value) <= high))
        .groupBy(F.least(pos, F.lit(bins - 1)).alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def value_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min, median and max of each column."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])))
    ends = long.groupBy("name").agg(F.min("v").alias("min"), F.max("v").alias("max"))
    return ends.join(quantiles(long, "v", {"median": 0.5}, ["name"]), "name", "left").select("name", "min", "median", "max")


def routing_summary(discharge: DataFrame) -> DataFrame:
    """Number of reaches, covered period and the range of routed discharge."""
    return discharge.agg(
        F.count_distinct("reach_id").alias("n_reaches"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("q").alias("min_q"),
        F.avg("q").alias("mean_q"),
        F.max("q").alias("max_q"),
    )


def score_log(scores: DataFrame) -> DataFrame:
    """Mean and median of NSE, RMSE and KGE; the NSE ignores infinite values in the median."""
    names = ("nse", "rmse", "kge")
    nse, rmse, kge = (null_if_nan(F.col(c)) for c in names)
    means = scores.agg(*[F.avg(v).alias(f"mean_{n}") for n, v in zip(names, (nse, rmse, kge), strict=True)])
    long = scores.select(finite_or_null(nse).alias("nse"), rmse.alias("rmse"), kge.alias("kge")).unpivot([], list(names), "name", "v")
    medians = quantiles(long, "v", {"m": 0.5}, ["name"])
    wide = medians.agg(*[F.max(F.when(F.col("name") == n, F.col("m"))).alias(f"median_{n}") for n in names])
    order = [f"{what}_{n}" for n in names for what in ("mean", "median")]
    # two single rows
    return means.withColumn("_k", F.lit(1)).join(wide.withColumn("_k", F.lit(1)), "_k").select(*order)


def histogram_statistics(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Mean, median and population standard deviation of each data set, missing values ignored."""
    v = df.select(*group, null_if_nan(F.col(value)).alias("_x"))
    moments = v.groupBy(*group).agg(F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"), F.count("_x").alias("n"))
    return moments.join(quantiles(v, "_x", {"median": 0.5}, group), group, "left").select(*group, "mean", "median", "std", "n")


def wettest(discharge: DataFrame, key: str, value: str) -> DataFrame:
    """Reach with the largest mean discharge; the smaller id wins a tie."""
    means = discharge.groupBy(key).agg(F.avg(value).alias("_m"))
    return means.agg(F.max_by(key, F.struct("_m", -F.col(key))).alias(key), F.max("_m").alias("mean_q"))


def plotted_reaches(discharge: DataFrame, targets: DataFrame | None, key: str = "reach_id", value: str = "q"):
    """Given targets that occur in the data, else the reach with the largest mean discharge."""
    if targets is not None:
        found = targets.join(discharge.select(key), key, "left_semi")
        if not found.isEmpty():
            return found.select(key).distinct()
    return wettest(discharge, key, value).select(key)


def series_mass(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias("mass"))


def geometry_statistics(daily: DataFrame, params: DataFrame, minimums: dict[str, float] = MINIMUMS) -> DataFrame:
    """Min, max, median and mean over days of the channel geometry of each reach.

    ``daily`` is ``reach_id, d, q``; ``params`` is ``reach_id, n, p_spatial, q_spatial, slope``.
    """
    q = F.col("q")
    slope = at_least(F.col("slope"), minimums["slope"])
    geo = trapezoid(
        F.col("n"), F.col("p_spatial"), F.col("q_spatial"), q, slope, minimums["depth"], minimums["bottom_width"]
    )
    rows = daily.join(params, "reach_id").select(
        "reach_id", *[geo[g].alias(g) for g in GEOMETRY if g != "discharge"], q.alias("discharge")
    )
    aggs = []
    for g in GEOMETRY:
        aggs += [
            F.min(g).alias(f"{g}_min"),
            F.max(g).alias(f"{g}_max"),
            F.median(g).alias(f"{g}_median"),
            F.avg(g).alias(f"{g}_mean"),
        ]
    return rows.groupBy("reach_id").agg(*aggs)
