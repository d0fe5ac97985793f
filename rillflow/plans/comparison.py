"""Comparison of several models at common gauges and days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.values import null_if_nan
from rillflow.operators.metrics import check_predictions, mass_balance, moment_scores
from rillflow.operators.ranking import quantiles
from rillflow.scratch import by_key, store


def without_headwaters(series: DataFrame, gauge_pairs: DataFrame) -> DataFrame:
    """Blank the predictions of gauges that have no upstream reach; their rows stay."""
    headed = gauge_pairs.select("staid", F.lit(True).alias("_ok")).distinct()
    return series.join(by_key(headed), "staid", "left").select("staid", "d", F.when(F.col("_ok"), F.col("pred")).alias("pred"))


def stacked(models: dict[str, DataFrame]) -> DataFrame:
    """``model, staid, d, pred`` of all models, one below the other."""
    parts = [df.select(F.lit(name).alias("model"), "staid", "d", null_if_nan(F.col("pred")).alias("pred")) for name, df in models.items()]
    return reduce(DataFrame.unionByName, parts)


def common(models: dict[str, DataFrame]) -> DataFrame:
    """Rows of gauges and days for which every model has a value; the shortest series decides."""
    # read twice below, and a routed series is long to derive
    rows = store(stacked(models).filter("pred IS NOT NULL"), "models")
    shared = rows.groupBy("staid", "d").agg(F.count_distinct("model").alias("_n")).filter(F.col("_n") == len(models))
    return rows.join(by_key(shared.select("staid", "d")), ["staid", "d"], "left_semi")


def compare(models: dict[str, DataFrame], obs: DataFrame) -> DataFrame:
    """Moment scores per model and gauge over the common rows."""
    target = obs.select("staid", "d", null_if_nan(F.col("streamflow")).alias("target"))
    both = check_predictions(common(models)).join(by_key(target), ["staid", "d"], "left")
    keyed = both.withColumn("_key", F.struct("model", "staid"))
    return moment_scores(keyed, "_key").select("_key.model", "_key.staid", *[F.col(c) for c in ("n", "bias", "mae", "rmse", "nse", "kge", "corr", "pbias")])


def balance(routed: DataFrame, base: DataFrame) -> DataFrame:
    """Relative mass error of a model against the unrouted sum, per gauge."""
    pair = common({"routed": routed, "base": base}).groupBy("staid", "d").pivot("model", ["routed", "base"]).agg(F.first("pred"))
    return mass_balance(pair, "staid", "routed", "base")


def balance_summary(errors: DataFrame) -> DataFrame:
    rows = errors.select(F.lit(0).alias("_k"), null_if_nan(F.col("mass_error")).alias("v"))
    means = rows.groupBy("_k").agg(F.avg("v").alias("mean_error"))
    return means.join(quantiles(rows, "v", {"median_error": 0.5}, ["_k"]), "_k", "left").select("mean_error", "median_error")


def located(scores: DataFrame, gauges: DataFrame, columns: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """Scores of the gauges whose location is known, next to it."""
    return scores.join(gauges.select("staid", *columns), "staid")
