"""Reaches ordered inside bounded pieces, and what that order answers.

``cut_pieces`` cuts a forest into pieces of at most M reaches (see ``layout``). ``piece_order`` walks every
piece once, in the task that holds it, and gives each reach

* ``pos`` and ``span``: inside its piece, the reaches at or above it are the ``span`` positions from ``pos`` on;
* ``pre`` and ``size``: in the whole forest, they are the ``size`` numbers from ``pre`` on.

A sum over everything upstream is then a difference of two running sums in the piece plus what the pieces
further up bring in, and those pass one row per piece (``upstream_sums``). "Upstream of X" is a range of
numbers (``intervals`` and ``inside``), so no closure is stored or built from pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.ranking import running_counts
from rillflow.operators.topology import accumulate, join_link, sum_to_outlet, topology
from rillflow.scratch import by_key, store

#: Numbers that share a bin of the range join, reaches of a piece.
BIN, LIMIT = 1024, 4096


@dataclass(frozen=True)
class Pieces:
    """``order``: reach_id, piece_id, pos, span, pre, size. ``exits``: piece_id, to_piece, at. ``forest``: topology of pieces."""

    order: DataFrame
    exits: DataFrame
    forest: DataFrame


def cut_pieces(topo: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Written ``reach_id, level, size, inner_down, out_down, piece_id`` and the topology of the pieces."""
    part = F.floor(F.col("size") / F.lit(limit))
    below = topo.select(F.col("reach_id").alias("down_id"), part.alias("_below"))
    linked = join_link(topo.select("reach_id", "down_id", "level", "size", part.alias("_part")), "down_id", "reach_id", below)
    same = F.col("_part") == F.col("_below")
    split = store(
        linked.select(
            "reach_id", "level", "size", F.when(same, F.col("down_id")).alias("inner_down"), F.when(~same, F.col("down_id")).alias("out_down")
        ),
        "split",
    )
    tips = topology(split.select("reach_id", F.col("inner_down").alias("down_id"))).select("reach_id", F.col("outlet").alias("piece_id"))
    placed = store(split.join(by_key(tips), "reach_id"), "pieces")
    into = placed.select(F.col("reach_id").alias("out_down"), F.col("piece_id").alias("to_piece"))
    ends = placed.filter(F.col("reach_id") == F.col("piece_id")).select("piece_id", "out_down")
    links = join_link(ends, "out_down", "piece_id", into).select(F.col("piece_id").alias("reach_id"), F.col("to_piece").alias("down_id"))
    return placed, topology(links)


def _walk(rows: list[tuple[int, int | None, int, bool]], root: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Of (reach, downstream, size, is another piece): (reach, pos, span, rel) and, of other pieces, (piece, rel, position it enters at)."""
    above: dict[int, list[tuple[int, int, bool]]] = {}
    for reach, down, size, other in rows:
        if reach != root or other:
            above.setdefault(down, []).append((reach, size, other))
    order, entering, todo = [], [], [(root, 0, -1)]
    parents: list[int] = []
    while todo:
        reach, rel, parent = todo.pop()
        here = len(order)
        order.append((reach, rel))
        parents.append(parent)
        rel += 1
        inner = []
        for up, size, other in sorted(above.get(reach, ())):
            if other:
                entering.append((up, rel, here))
            else:
                inner.append((up, rel, here))
            rel += size
        todo += reversed(inner)
    span = [1] * len(order)
    for i in range(len(order) - 1, 0, -1):
        span[parents[i]] += span[i]
    return [(reach, i, span[i], rel) for i, (reach, rel) in enumerate(order)], entering


_WALKED = ["reach_id", "piece_id", "pos", "span", "rel", "other"]


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by piece."""
    piece, rows = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if rows:
            own, entering = _walk(rows, piece)
            out = [(r, piece, pos, span, rel, False) for r, pos, span, rel in own]
            out += [(p, piece, at, None, rel, True) for p, rel, at in entering]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*[pa.int64()] * 5, pa.bool_()], strict=True)], names=_WALKED)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("piece_id", "reach_id", "down", "size", "other")]
        for p, reach, down, size, other in zip(*columns, strict=True):
            if p != piece:
                yield from flush()
                piece, rows = p, []
            rows.append((reach, down, size, other))
    yield from flush()


def piece_order(placed: DataFrame, forest: DataFrame) -> Pieces:
    """Order of every piece from ``cut_pieces``, written once."""
    own = placed.select("piece_id", "reach_id", F.col("inner_down").alias("down"), "size", F.lit(False).alias("other"))
    tips = placed.filter((F.col("reach_id") == F.col("piece_id")) & F.col("out_down").isNotNull()).select("reach_id", "out_down", "size")
    into = forest.filter("down_id is not null").select("reach_id", F.col("down_id").alias("piece_id"))
    hanging = tips.join(by_key(into), "reach_id").select("piece_id", "reach_id", F.col("out_down").alias("down"), "size", F.lit(True).alias("other"))
    rows = own.unionByName(hanging).repartition("piece_id").sortWithinPartitions("piece_id")
    walked = store(rows.mapInArrow(_walks, "reach_id long, piece_id long, pos long, span long, rel long, other boolean"), "walked")
    exits = walked.filter("other").select(F.col("reach_id").alias("piece_id"), F.col("piece_id").alias("to_piece"), F.col("pos").alias("at"), "rel")
    # where a piece starts: the reaches of earlier basins, then what lies before it in each piece on its way down
    basins = placed.filter("inner_down is null and out_down is null").select("reach_id", "size")
    starts = running_counts(basins, [F.col("reach_id")], "size", []).select("reach_id", F.col("_before").alias("rel"))
    steps = starts.unionByName(exits.select(F.col("piece_id").alias("reach_id"), "rel"))
    base = sum_to_outlet(steps, forest, "rel").select(F.col("reach_id").alias("piece_id"), F.col("rel").alias("base"))
    order = walked.filter("not other").drop("other").join(by_key(base), "piece_id").join(by_key(placed.select("reach_id", "size")), "reach_id")
    order = order.select("reach_id", "piece_id", F.col("pos").cast("int"), F.col("span").cast("int"), (F.col("base") + F.col("rel")).alias("pre"), "size")
    return Pieces(store(order, "piece-order"), store(exits.select("piece_id", "to_piece", F.col("at").cast("int")), "exits"), forest)


def numbered_pieces(topo: DataFrame, limit: int = LIMIT) -> Pieces:
    return piece_order(*cut_pieces(topo, limit))


def upstream_sums(
    values: DataFrame, pieces: Pieces, names: list[str], default: float, keys: list[str] = (), spread: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """``reach_id, *keys, *names``: sums over each reach and everything upstream of it.

    ``values`` has at most one row per reach and keys; ``default`` counts where it has none or NULL.
    ``spread`` repeats rows for all keys that are wanted. The rows of all reaches and keys are shuffled
    once, by piece; apart from that one row per piece and keys moves.
    """
    keys = list(keys)
    group = ["piece_id", *keys]
    above = [(F.coalesce(F.col(n).cast("double"), F.lit(default)) - F.lit(default)).alias(n) for n in names]
    placed = values.join(pieces.order.select("reach_id", "piece_id", "pos"), "reach_id").select(*group, "pos", *above)
    sums = placed.groupBy(*group).agg(*[F.sum(n).alias(n) for n in names])
    roots = spread(pieces.order.filter("pos = 0").select("piece_id", F.col("span").alias("_n")))
    whole = [(F.col("_n") * F.lit(default) + F.coalesce(n, F.lit(0.0))).alias(n) for n in names]
    own = roots.join(sums, group, "left").select(F.col("piece_id").alias("reach_id"), *keys, *whole)
    totals = store(accumulate(own, pieces.forest, keys, names).withColumnRenamed("reach_id", "piece_id"), "piece-totals")
    entering = totals.join(pieces.exits, "piece_id").select(F.col("to_piece").alias("piece_id"), *keys, F.col("at").alias("pos"), *names)
    skeleton = spread(pieces.order.select("piece_id", "pos", "reach_id", "span")).withColumns({n: F.lit(float(default)) for n in names})
    rows = skeleton.unionByName(placed.unionByName(entering), allowMissingColumns=True)
    upto = Window.partitionBy(*group).orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumns({n: F.sum(n).over(upto) for n in names}).filter("reach_id is not null")
    held = run.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("pos", "span", "reach_id", *names))).alias("_held"))
    held_at = lambda i, n: F.coalesce(F.get("_held", i).getField(n), F.lit(0.0))
    out = F.transform("_held", lambda x: F.struct(x["reach_id"].alias("reach_id"), *[(held_at(x["pos"] + x["span"] - 1, n) - held_at(x["pos"] - 1, n)).alias(n) for n in names]))
    return held.select(*keys, F.inline(out)).select("reach_id", *keys, *names)


def intervals(order: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` with ``lo`` and ``hi``, the numbers of everything at or above their reach; unknown reaches are left out."""
    numbers = order.select("reach_id", F.col("pre").alias("lo"), (F.col("pre") + F.col("size") - 1).alias("hi"))
    return points.join(by_key(numbers), "reach_id")


def inside(ranges: DataFrame, rows: DataFrame, number: str = "pre") -> DataFrame:
    """Every row of ``rows`` with every range (``lo`` to ``hi``) that its number lies in, joined by bins of numbers."""
    bins = F.sequence(F.floor(F.col("lo") / BIN), F.floor(F.col("hi") / BIN))
    dealt = ranges.withColumn("_bin", F.explode(bins))
    return rows.withColumn("_bin", F.floor(F.col(number) / BIN)).join(by_key(dealt), "_bin").filter(F.col(number).between(F.col("lo"), F.col("hi"))).drop("_bin")
