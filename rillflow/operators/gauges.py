"""Gauge filters, metadata and flow-scale factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.values import flow_scale, null_if_nan
from rillflow.scratch import by_key


def _require(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise KeyError(f"gauge table has no column {column!r}")


def within_area_gap(wanted: DataFrame, gauges: DataFrame, threshold: float) -> DataFrame:
    """Keep gauges whose area mismatch is at most ``threshold``; unknown gauges drop out."""
    _require(gauges, "abs_diff")
    ok = gauges.filter(null_if_nan(F.col("abs_diff")) <= F.lit(float(threshold))).select("staid")
    return wanted.join(ok, "staid", "left_semi")


def with_valid_area(wanted: DataFrame, gauges: DataFrame) -> DataFrame:
    """Keep gauges flagged as having a valid drainage area; unknown gauges drop out."""
    _require(gauges, "da_valid")
    return wanted.join(gauges.filter(F.col("da_valid")).select("staid"), "staid", "left_semi")


def not_headwater(wanted: DataFrame, gauge_pairs: DataFrame) -> DataFrame:
    """Keep gauges whose subset has at least one link."""
    return wanted.join(gauge_pairs.select("staid"), "staid", "left_semi")


def training_gauges(
    wanted: DataFrame, gauges: DataFrame, gauge_pairs: DataFrame, threshold: float | None, use_valid_flag: bool = True
) -> DataFrame:
    """Area check (validity flag first if asked for and present, else threshold), then the headwater check."""
    if use_valid_flag and "da_valid" in gauges.columns:
        wanted = with_valid_area(wanted, gauges)
    elif threshold is not None:
        wanted = within_area_gap(wanted, gauges, threshold)
    return not_headwater(wanted, gauge_pairs)


def removed_count(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.join(after, "staid", "left_anti").agg(F.count("*").alias("n_removed"))


def complete_gauges(obs: DataFrame) -> DataFrame:
    """Gauges without a missing observation in the window."""
    return (
        obs.groupBy("staid")
        .agg(F.bool_or(null_if_nan(F.col("streamflow")).isNull()).alias("_gap"))
        .filter(~F.col("_gap"))
        .select("staid")
    )


def segment_flow_scale(batch: DataFrame, gauges: DataFrame) -> DataFrame:
    """Scale factor per gauge reach of a batch ``staid, reach_id, pos``.

    A given ``flow_scale`` column counts (missing gives 1); otherwise the factor is computed
    when the area columns are there, else it is 1. The last gauge of a reach wins.
    """
    needed = ("drain_sqkm", "comid_drain_sqkm", "comid_unitarea_sqkm")
    if "flow_scale" in gauges.columns:
        factor = F.coalesce(null_if_nan(F.col("flow_scale")), F.lit(1.0))
    elif all(c in gauges.columns for c in needed):
        factor = flow_scale(*[F.col(c) for c in needed])
    else:
        factor = F.lit(1.0)
    scaled = gauges.select("staid", factor.alias("_f"))
    return (
        batch.join(by_key(scaled), "staid", "left")
        .groupBy("reach_id")
        .agg(F.max_by(F.coalesce("_f", F.lit(1.0)), "pos").alias("flow_scale"))
    )


def sample_batches(gauges: DataFrame, size: int, seed: int) -> DataFrame:
    """Shuffle gauges and cut them into whole batches; the remainder is left out.

    The random order comes from a hash of the id and the seed, so that it does not
    depend on partitioning.
    """
    from rillflow.operators.ranking import row_numbers

    mixed = gauges.select("staid").withColumn("_r", F.xxhash64(F.lit(seed), F.col("staid")))
    ranked = row_numbers(mixed, [F.col("_r"), F.col("staid")])
    batch = F.floor((F.col("rn") - 1) / F.lit(size))
    return ranked.filter(batch < F.floor(F.col("rn_total") / F.lit(size))).select("staid", batch.alias("batch"))


def in_store(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Gauges that a store of subsets or series knows, by station id."""
    return wanted.join(stored.select("staid").distinct(), "staid", "left_semi")
