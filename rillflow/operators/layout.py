"""Cutting a drainage forest into bounded pieces of work.

With M the wanted number of reaches per piece and ``size`` the number of reaches at or
above a reach, links are cut wherever floor(size / M) changes. What is left are whole
subtrees of fewer than M reaches (quotient 0) and single stretches of main stem with at
most M reaches (two upstream reaches of equal quotient k >= 1 would give at least 2k).
So no piece exceeds M, even if one basin holds every reach. Pieces form a forest again;
its levels are the stages in which they can be computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.operators.pieces import cut_pieces
from rillflow.operators.ranking import row_numbers
from rillflow.operators.topology import join_link
from rillflow.scratch import by_key, store


def layout(topo: DataFrame, limit: int) -> DataFrame:
    """Written table ``reach_id, piece_id, stage, bundle, level, inner_down, out_down, to_stage``.

    ``inner_down`` is the downstream reach inside the piece, ``out_down`` the one the piece
    drains into, which belongs to a piece of the later stage ``to_stage``. The pieces of a
    bundle are computed by one task.
    """
    return staged(*cut_pieces(topo, limit), limit)


def staged(placed: DataFrame, forest: DataFrame, limit: int) -> DataFrame:
    """The table of ``layout`` from pieces that are cut already."""
    order = forest.select(F.col("reach_id").alias("piece_id"), F.col("level").alias("stage"), F.col("down_id").alias("to_piece"))
    sizes = placed.groupBy("piece_id").agg(F.count("*").alias("_n"))
    packed = store(_pack(order.join(by_key(sizes), "piece_id"), limit), "bundles")
    stages = packed.select(F.col("piece_id").alias("to_piece"), F.col("stage").alias("to_stage"))
    plan = join_link(packed, "to_piece", "piece_id", stages).select("piece_id", "stage", "bundle", "to_stage")
    return store(
        placed.join(by_key(plan), "piece_id").select(
            "reach_id",
            "piece_id",
            "level",
            "inner_down",
            "out_down",
            F.col("stage").cast("int"),
            F.col("bundle").cast("int"),
            F.when(F.col("out_down").isNotNull(), F.col("to_stage")).cast("int").alias("to_stage"),
        ),
        "layout",
    )


def _pack(pieces: DataFrame, limit: int) -> DataFrame:
    """Bundle per piece within its stage: large pieces alone, small ones sharing by hash."""
    large = F.col("_n") * 4 >= F.lit(limit)
    ranked = row_numbers(
        pieces.withColumn("_large", large.cast("int")), [F.col("_large").desc(), F.col("_n").desc(), F.col("piece_id")], ["stage"]
    )
    # one row per stage: always small
    totals = F.broadcast(
        pieces.groupBy("stage").agg(
            F.count_if(large).alias("_alone"),
            F.greatest(F.ceil(F.sum(F.when(~large, F.col("_n"))) / F.lit(limit)), F.lit(1)).alias("_shared"),
        )
    )
    shared = F.col("_alone") + F.pmod(F.xxhash64("piece_id"), F.col("_shared"))
    return ranked.join(totals, "stage").select(
        "piece_id", "stage", "to_piece", F.when(F.col("_large") == 1, F.col("rn") - 1).otherwise(shared).alias("bundle")
    )


def stage_tasks(plan: DataFrame) -> list[tuple[int, int]]:
    """(stage, bundles) in order; one row per stage reaches the driver."""
    rows = plan.groupBy("stage").agg(F.max("bundle").alias("b")).orderBy("stage").collect()
    return [(r.stage, r.b + 1) for r in rows]
