"""Structure of a drainage forest by pointer doubling.

A reach has at most one downstream reach, so "everything upstream" and "the way
to the outlet" can both be computed in log2(depth) rounds of equi-joins, each on
as many rows as there are reaches. No closure is built, no level is walked alone
and no basin is gathered in one task, however large it is.

Input of every function: ``flow(reach_id BIGINT, down_id BIGINT NULL)`` with one
row per reach and ids >= 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rillflow.scratch import by_key, store


class CycleError(ValueError):
    """The flow table does not describe a forest."""


def check_dendritic(flow: DataFrame) -> DataFrame:
    """Reaches that list more than one downstream reach (must be empty)."""
    return flow.groupBy("reach_id").agg(F.count("*").alias("n_down")).filter("n_down > 1")


def _double(flow: DataFrame) -> tuple[DataFrame, int, bool]:
    """Run the rounds; returns the last state, their number, and whether all paths ended."""
    state, seen = _store_counted(
        flow.select(
            F.col("reach_id").cast("long"),
            F.col("down_id").cast("long"),
            F.col("down_id").cast("long").alias("jump"),
            F.col("reach_id").cast("long").alias("tip"),
            F.lit(0).cast("long").alias("hops"),
            F.lit(1).cast("long").alias("size"),
            F.lit(0).cast("long").alias("level"),
            F.array().cast("array<bigint>").alias("jumps"),
        )
    )
    limit = max(1, math.ceil(math.log2(max(2, seen["rows"])))) + 1
    for r in range(limit):
        if not seen["live"]:
            return state, r, True
        state, seen = _store_counted(_round(state, r))
    return state, limit, not seen["live"]


def _store_counted(state: DataFrame) -> tuple[DataFrame, dict]:
    """Write a state; rows and live pointers are counted while it is written."""
    watch = Observation()
    counted = state.observe(
        watch, F.count(F.lit(1)).alias("rows"), F.count("jump").alias("live")
    )
    return store(counted, "topology"), watch.get


def _round(state: DataFrame, r: int) -> DataFrame:
    reach = 1 << r
    # what lies exactly one jump upstream, combined before the shuffle
    above = (
        state.filter(F.col("jump").isNotNull())
        .groupBy(F.col("jump").alias("reach_id"))
        .agg(F.sum("size").alias("more"), (F.max("level") + F.lit(reach)).alias("far"))
    )
    ahead = state.select(
        F.col("reach_id").alias("_to"),
        F.lit(True).alias("_live"),
        F.col("jump").alias("_jump"),
        F.col("tip").alias("_tip"),
        F.col("hops").alias("_hops"),
    )
    # finished reaches keep their own id as key, so NULL pointers do not pile up in one partition
    return (
        state.join(by_key(above), "reach_id", "left")
        .withColumn("_key", F.coalesce("jump", "reach_id"))
        .withColumn("_on", F.col("jump").isNotNull())
        .join(by_key(ahead), (F.col("_key") == F.col("_to")) & (F.col("_on") == F.col("_live")), "left")
        .select(
            "reach_id",
            "down_id",
            F.col("_jump").alias("jump"),
            F.when(F.col("_on"), F.col("_tip")).otherwise(F.col("tip")).alias("tip"),
            F.when(F.col("_on"), F.col("_hops") + F.lit(reach)).otherwise(F.col("hops")).alias("hops"),
            (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"),
            F.greatest("level", "far").alias("level"),
            F.array_append("jumps", F.col("jump")).alias("jumps"),
        )
    )


def topology(flow: DataFrame) -> DataFrame:
    """``reach_id, down_id, outlet, hops, size, level, jumps`` of a forest.

    ``size`` counts the reach and everything upstream, ``level`` is the longest way
    from a headwater, ``hops`` the way to ``outlet``; ``jumps[r]`` is the reach 2^r
    steps downstream.
    """
    state, _, ended = _double(flow)
    if not ended:
        raise CycleError("the flow table contains a cycle; call drop_cycles first")
    return state.select("reach_id", "down_id", F.col("tip").alias("outlet"), "hops", "size", "level", "jumps")


def topology_without_cycles(flow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The flow table without its cycles (see ``drop_cycles``) and its topology.

    The rounds that look for cycles have found the topology as well if there are none.
    """
    state, _, ended = _double(flow)
    if ended:
        topo = state.select("reach_id", "down_id", F.col("tip").alias("outlet"), "hops", "size", "level", "jumps")
        return topo.select("reach_id", "down_id"), topo
    kept = store(_without(flow, _members(state)), "flow")
    return kept, topology(kept)


def _members(state: DataFrame) -> DataFrame:
    return state.filter(F.col("jump").isNotNull()).select(F.col("jump").alias("reach_id")).distinct()


def cycle_members(flow: DataFrame) -> DataFrame:
    """Reaches that lie on a cycle.

    After N or more steps a path that never ended is on its cycle, and every reach of
    the cycle is hit by some path, so the surviving pointers are exactly the members.
    """
    state, _, ended = _double(flow)
    if ended:
        return state.select("reach_id").limit(0)
    return _members(state)


def join_link(df: DataFrame, link: str, own: str, other: DataFrame) -> DataFrame:
    """Left join on ``link``, the key of ``other`` too; rows without a link are spread by their own id.

    A join on NULL keys would send every outlet and isolated reach to one partition.
    """
    left = df.withColumns({"_linked": F.col(link).isNotNull(), "_link": F.coalesce(link, own)})
    right = other.withColumnRenamed(link, "_link").withColumn("_linked", F.lit(True))
    return left.join(by_key(right), ["_linked", "_link"], "left").drop("_linked", "_link")


def drop_cycles(flow: DataFrame) -> DataFrame:
    """Remove reaches on cycles together with every link that touches them."""
    return _without(flow, cycle_members(flow))


def _without(flow: DataFrame, gone: DataFrame) -> DataFrame:
    kept = flow.join(by_key(gone), "reach_id", "left_anti")
    marked = join_link(kept, "down_id", "reach_id", gone.select(F.col("reach_id").alias("down_id"), F.lit(True).alias("_gone")))
    return marked.select("reach_id", F.when(F.col("_gone").isNull(), F.col("down_id")).alias("down_id"))


def cut(flow: DataFrame, where: Column) -> DataFrame:
    """Forest in which the links that satisfy ``where`` are removed."""
    return flow.withColumn("down_id", F.when(~where, F.col("down_id")))


def nearest_marked(flow: DataFrame, marked: DataFrame) -> DataFrame:
    """``reach_id, marked_id``: the first marked reach at or below each reach (NULL if none).

    Cutting the forest below every marked reach turns the question into "which outlet".
    """
    flags = marked.select(F.col("reach_id").cast("long")).distinct().withColumn("_hit", F.lit(True))
    split = flow.select("reach_id", "down_id").join(by_key(flags), "reach_id", "left")
    tips = topology(cut(split, F.col("_hit").isNotNull()).select("reach_id", "down_id"))
    hits = flags.select(F.col("reach_id").alias("outlet"), "_hit")
    return (
        tips.select("reach_id", "outlet")
        .join(by_key(hits), "outlet", "left")
        .select("reach_id", F.when(F.col("_hit"), F.col("outlet")).alias("marked_id"))
    )


def accumulate(
    values: DataFrame, topo: DataFrame, keys: list[str], value: str | list[str], rounds: int | None = None
) -> DataFrame:
    """Sum values over each reach and everything upstream, separately per ``keys``.

    ``values`` holds one row per (reach, keys) for *every* reach of ``topo``. Each round
    sends a running sum 2^r steps downstream; sums are combined before each shuffle.
    Several value columns move in one row, which costs far less than a key column.
    """
    names = [value] if isinstance(value, str) else list(value)
    if rounds is None:
        rounds = topo.agg(F.max(F.size("jumps"))).head()[0] or 0
    ahead = [F.get("jumps", F.lit(r)).alias(f"_j{r}") for r in range(rounds)]
    state = values.select("reach_id", *keys, *[F.col(n).cast("double").alias(n) for n in names]).join(
        by_key(topo.select("reach_id", *ahead)), "reach_id"
    )
    for r in range(rounds):
        later = [f"_j{k}" for k in range(r + 1, rounds)]
        stay = F.struct(F.col("reach_id").alias("reach_id"), *later)
        move = F.struct(
            F.col(f"_j{r}").alias("reach_id"), *[F.lit(None).cast("long").alias(name) for name in later]
        )
        out = F.when(F.col(f"_j{r}").isNotNull(), F.array(stay, move)).otherwise(F.array(stay))
        # plain long columns keep this a hash aggregate; a moved row brings no pointers of its own
        state = (
            state.select(F.explode(out).alias("_e"), *keys, *names)
            .groupBy(F.col("_e.reach_id").alias("reach_id"), *keys)
            .agg(*[F.sum(n).alias(n) for n in names], *[F.max(f"_e.{name}").alias(name) for name in later])
        )
    return state.select("reach_id", *keys, *names)


def sum_to_outlet(values: DataFrame, topo: DataFrame, value: str) -> DataFrame:
    """``reach_id, value``: sum over each reach and everything on its way to the outlet; one row per reach in ``values``."""
    rounds = topo.agg(F.max(F.size("jumps"))).head()[0] or 0
    state = values.select("reach_id", value).join(by_key(topo.select("reach_id", "jumps")), "reach_id")
    for r in range(rounds):
        state = store(state.withColumn("_to", F.get("jumps", F.lit(r))), "way")
        ahead = state.select(F.col("reach_id").alias("_to"), F.col(value).alias("_more"))
        state = join_link(state, "_to", "reach_id", ahead).select("reach_id", (F.col(value) + F.coalesce("_more", F.lit(0))).alias(value), "jumps")
    return state.select("reach_id", value)


def upstream_of(flow: DataFrame, targets: DataFrame) -> DataFrame:
    """Reaches at or above any target; a target that is not in the network yields itself."""
    inside = nearest_marked(flow, targets).filter(F.col("marked_id").isNotNull()).select("reach_id")
    unknown = targets.select(F.col("reach_id").cast("long")).distinct().join(by_key(flow), "reach_id", "left_anti")
    return inside.unionByName(unknown.select("reach_id"))
