"""Exact ranks without gathering a group in one task.

``row_number() over (partition by g order by v)`` sends a whole group to one task.
Here rows are placed by a range partitioning on (group, order), so that a hot group
spans many partitions; each partition then needs only the number of rows of the group
in the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.scratch import by_key, store

_SHIFT = 33  # monotonically_increasing_id keeps the partition above this bit


def row_numbers(df: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "rn") -> DataFrame:
    """Add the 1-based position of each row in ``order`` within its group.

    ``order`` must end in something unique within the group for a repeatable result.
    Also adds ``<name>_total``, the number of rows of the group.
    """
    group = group or []
    keys = [*[F.col(g) for g in group], *order]
    placed = store(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright(F.col("_at"), _SHIFT)
    blocks = placed.groupBy(*group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # at most one row per group and partition is left here
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    blocks = blocks.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        "_part",
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_total"),
    )
    same = part == blocks["_part"]
    for i, g in enumerate(group):
        same = same & placed[g].eqNullSafe(blocks[f"_g{i}"])
    # with groups there may be as many blocks as groups
    return placed.join(by_key(blocks) if group else blocks, same).select(
        *df.columns,
        (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name),
        F.col("_total").alias(f"{name}_total"),
    )


def running_counts(df: DataFrame, order: list[Column], count: str, group: list[str]) -> DataFrame:
    """Add ``_before``, the sum of ``count`` over the rows before in ``order``, and ``_total``, the group's sum.

    ``order`` is unique within the group. As in ``row_numbers`` a large group spans many range
    partitions; inside a partition the running sum is a window over (partition, group).
    """
    keys = [*[F.col(g) for g in group], *order]
    placed = store(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "counted"
    ).withColumn("_part", F.shiftright(F.col("_at"), _SHIFT))
    blocks = placed.groupBy(*group, "_part").agg(F.sum(count).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_part").alias("_block"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("_total"),
    )
    same = F.col("_part") == F.col("_block")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("_inside", F.coalesce(F.sum(count).over(inside), F.lit(0))).join(by_key(blocks) if group else blocks, same)
    return out.select(*df.columns, (F.col("_earlier") + F.col("_inside")).alias("_before"), "_total")


def average_rank(df: DataFrame, group: list[str], value: str, tie_break: list[str], name: str) -> DataFrame:
    """Add the rank of ``value`` in its group, ties sharing the mean of their positions."""
    ranked = row_numbers(df, [F.col(value), *[F.col(c) for c in tie_break]], group, "_pos")
    ties = ranked.groupBy(*group, value).agg(F.avg("_pos").alias(name))
    return ranked.drop("_pos", "_pos_total").join(by_key(ties), [*group, value])


def quantiles(df: DataFrame, value: str, shares: dict[str, float], group: list[str]) -> DataFrame:
    """Exact quantiles per group, linear between neighbours: one column per name in ``shares``.

    Missing values are ignored; a group without values is missing from the result. Equal values
    are counted before anything moves, so a tie that holds most rows of a group is one row in
    the range partitioning; only the values next to the wanted positions are brought together.
    """
    kept = df.select(*group, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counted = kept.groupBy(*group, "_v").agg(F.count("*").alias("_ties"))
    ranked = running_counts(counted, [F.col("_v")], "_ties", group)
    # the value covers the 0-based positions from _before to _before + _ties - 1
    first, last = F.col("_before"), F.col("_before") + F.col("_ties") - 1
    at = {n: (F.col("_total") - 1) * F.lit(float(p)) for n, p in shares.items()}
    covers = lambda pos: (pos >= first) & (pos <= last)
    wanted = None
    for a in at.values():
        near = covers(F.floor(a)) | covers(F.ceil(a))
        wanted = near if wanted is None else wanted | near
    aggs = []
    for n, a in at.items():
        low = F.max(F.when(covers(F.floor(a)), F.col("_v")))
        high = F.max(F.when(covers(F.ceil(a)), F.col("_v")))
        aggs.append((low + (high - low) * F.max(a - F.floor(a))).alias(n))
    return ranked.filter(wanted).groupBy(*group).agg(*aggs)
