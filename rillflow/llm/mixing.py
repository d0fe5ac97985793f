"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source whose target is ``ratio`` times its words gives every document floor(ratio) whole
copies for certain. The words still missing come from a Pareto sample: document i has
inclusion odds ``f/(1-f) * measure_i`` (f the fraction of the ratio), a fixed random number
u_i, and rank ``(u_i/(1-u_i)) / odds_i``; the lowest ranks get one more copy, up to the fixed
size of the sample, counted in words. The measure is the square root of the document's
words, so that a long document is likelier to fill the gap than a very short one.

No source is ordered in one task. A rank maps to a 40-bit key; words are summed per source
and leading 14 bits, then per next 13 bits inside the one cell in which the source's gap
closes, and only the documents of that leaf are put in order.

Null source: a source of its own, last. Null or wordless text: size 0, nothing to take.
Documents that share id and text share their random number and are interchangeable; their
order is arbitrary, and at the border only as many of them as fill the gap are taken. An empty table gives an empty result. Other columns travel untouched in
``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.common import unit_interval, word_count
from rillflow.scratch import store

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
COARSE, FINE, BITS = 26, 13, 40


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` of a table with one row per source.

    Filling in closed form: with sources ordered by cap/weight, a prefix of them stands at its
    cap and the rest share what is left by weight. The first source at which the common level
    lies below its own cap/weight ends the prefix. One row per source, never per document.
    """
    at_all = Window.partitionBy(F.lit(0))
    ordered = at_all.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(ordered) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    t = sizes.select("source", "source_size", weight.alias("weight")).withColumns(
        {"most": most * F.col("source_size"), "total": F.sum("source_size").over(at_all)}
    )
    t = t.withColumn("full_at", F.col("most") / F.col("weight"))
    by_level = at_all.orderBy("full_at", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after))
    # levels rise along the prefix at its caps and fall after it, so the first one below its cap is the largest such
    level = F.max(F.when(F.col("level") < F.col("full_at"), F.col("level"))).over(at_all)
    share = F.when(level.isNull() | (F.col("full_at") <= level), F.col("most").cast("double")).otherwise(level * F.col("weight"))
    return t.select("source", "source_size", share.alias("target"))


def pareto_key(u: Column, fraction: Column, measure: Column) -> Column:
    """Rank of Pareto sampling as an ordered 40-bit integer; ``rank/(1+rank)`` keeps the order."""
    odds = fraction / (1 - fraction) * measure
    rank = (u / (1 - u)) / odds
    return F.floor(rank / (1 + rank) * float(1 << BITS)).cast("long")


def _closing_cell(cells: DataFrame) -> DataFrame:
    """Of cells (source, cell, words, gap): the one in which the gap closes, and the words before it."""
    w = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cells.withColumn("run", F.sum("words").over(w))
    return run.filter((F.col("run") >= F.col("gap")) & (F.col("run") - F.col("words") < F.col("gap"))).select(
        "source", "cell", (F.col("gap") - F.col("run") + F.col("words")).alias("left")
    )


def copies(docs: DataFrame, seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, payload: list[str] | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, copies`` and the ``payload`` columns in a struct."""
    kept = F.struct(*[F.col(f"`{c}`") for c in payload]) if payload else F.lit(None).cast("string")
    slim = store(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            unit_interval(F.lit(seed), F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("u"),
            F.monotonically_increasing_id().alias("row"),  # tells apart rows that repeat id and text
            kept.alias("payload"),
        ).withColumn("named", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit(""))),
        "mix-sizes",
    )
    key = ["named", "source"]
    sizes = slim.groupBy(*key).agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes.select(F.when(F.col("named"), F.col("source")).alias("source"), "source_size"), weights)
    targets = targets.withColumns({"ratio": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)})
    plan = store(
        targets.select(
            F.struct(F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("name")).alias("source"),
            "source_size",
            "target",
            F.floor("ratio").alias("whole"),
            (F.col("ratio") - F.floor("ratio")).alias("fraction"),
        ).withColumn("gap", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")),
        "mix-plan",
    )
    slim = slim.withColumn("source", F.struct("named", F.col("source").alias("name"))).drop("named")
    ranked = slim.join(plan, "source").withColumn(
        "key", F.when((F.col("gap") > 0) & (F.col("size") > 0) & (F.col("fraction") > 0), pareto_key(F.col("u"), F.col("fraction"), F.sqrt(F.col("size").cast("double"))))
    )
    first = F.shiftright("key", COARSE)
    second = F.shiftright("key", FINE)
    open_ = ranked.filter("key is not null")

    def cells(rows: DataFrame, cell: Column, gap: str) -> DataFrame:
        return rows.groupBy("source", cell.alias("cell"), F.col(gap).alias("gap")).agg(F.sum("size").alias("words"))

    coarse = store(_closing_cell(cells(open_, first, "gap")).select("source", F.col("cell").alias("cut1"), F.col("left").alias("gap1")), "mix-coarse")
    inside = open_.join(coarse, "source").filter(first == F.col("cut1"))
    fine = store(_closing_cell(cells(inside, second, "gap1")).select("source", F.col("cell").alias("cut2"), F.col("left").alias("gap2")), "mix-fine")
    leaf = open_.join(fine, "source").filter(second == F.col("cut2"))
    w = Window.partitionBy("source").orderBy("key", "u", "size", "doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.sum("size").over(w)
    # the document across the border is taken if that brings the source nearer to its target
    chosen = leaf.withColumn("run", run).filter(2 * (F.col("run") - F.col("gap2")) <= F.col("size"))
    mine = F.struct("key", "u", "size", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "row")
    ends = chosen.groupBy("source").agg(F.max(mine).alias("last"))
    limits = plan.select("source").join(fine.select("source", "cut2"), "source", "left").join(ends, "source", "left")
    extra = (second < F.col("cut2")) | ((second == F.col("cut2")) & F.coalesce(mine <= F.col("last"), F.lit(False)))
    # a source whose gap never closes (it equals all its words) takes every document
    extra = F.col("key").isNotNull() & F.when(F.col("cut2").isNull(), True).otherwise(extra)
    out = ranked.join(limits, "source").withColumn("copies", F.col("whole") + F.when(extra, 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", "copies", "payload")


def mix_documents(docs: DataFrame, seed: str = "mix", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with the columns of ``docs``."""
    taken = copies(docs, seed, weights, docs.columns).filter("copies > 0")
    return taken.select("payload", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        *[F.col("payload").getField(c).alias(c) for c in docs.columns]
    )
