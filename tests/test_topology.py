"""Pointer doubling against plain walks, and the invariants of a network."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from rillflow.operators import network as net
from rillflow.operators import topology as top
from rillflow.operators.baseline import gauge_structure, summed_inflow
from rillflow.operators import pieces as pcs
from rillflow.operators.layout import layout
from rillflow.operators.pieces import numbered_pieces
from rillflow.operators.ranking import average_rank, quantiles, row_numbers


def make(spark, down):
    return spark.createDataFrame(sorted(down.items()), "reach_id bigint, down_id bigint")


def random_forest(m, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(10 * m), m)
    return {r: (None if i == 0 or rng.random() < 0.1 else ids[rng.randrange(max(0, i - 9), i)]) for i, r in enumerate(ids)}


def walk(down, r):
    path = [r]
    while down[path[-1]] is not None:
        path.append(down[path[-1]])
    return path


def expected(down):
    size, level = dict.fromkeys(down, 0), dict.fromkeys(down, 0)
    for r in down:
        for k, at in enumerate(walk(down, r)):
            size[at] += 1
            level[at] = max(level[at], k)
    return size, level


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(m=st.integers(1, 70), seed=st.integers(0, 10_000))
def test_topology_equals_walks(spark, m, seed):
    down = random_forest(m, seed)
    size, level = expected(down)
    for r in top.topology(make(spark, down)).collect():
        path = walk(down, r.reach_id)
        assert (r.size, r.level, r.outlet, r.hops) == (size[r.reach_id], level[r.reach_id], path[-1], len(path) - 1)


def test_long_chain(spark):
    m = 700  # deeper than the default limit of recursive queries
    down = {i: (i - 1 if i else None) for i in range(m)}
    rows = {r.reach_id: r for r in top.topology(make(spark, down)).collect()}
    assert rows[0].size == m and rows[0].level == m - 1 and rows[m - 1].hops == m - 1


def test_accumulation_chain_and_sandbox(spark):
    down = {0: 1, 1: 2, 2: 3, 3: 4, 4: None}
    topo = top.topology(make(spark, down))
    values = spark.createDataFrame([(i, 2.0) for i in range(5)], "reach_id bigint, v double")
    got = {r.reach_id: r.v for r in top.accumulate(values, topo, [], "v").collect()}
    assert got == {0: 2, 1: 4, 2: 6, 3: 8, 4: 10}
    down = {10: 30, 20: 30, 40: 50, 30: 50, 50: None}
    topo = top.topology(make(spark, down))
    values = spark.createDataFrame([(10, 9.0), (20, 9.0), (30, 9.0), (40, 18.0), (50, 18.0)], "reach_id bigint, v double")
    got = {r.reach_id: r.v for r in top.accumulate(values, topo, [], "v").collect()}
    assert got == {10: 9, 20: 9, 30: 27, 40: 18, 50: 63}


def test_cycles(spark):
    down = {1: 2, 2: 3, 3: 1, 4: 1, 5: 4, 6: 6, 7: 6, 8: None, 9: 8}
    flow = make(spark, down)
    with pytest.raises(top.CycleError):
        top.topology(flow)
    assert {r.reach_id for r in top.cycle_members(flow).collect()} == {1, 2, 3, 6}
    assert {(r.reach_id, r.down_id) for r in top.drop_cycles(flow).collect()} == {(4, None), (5, 4), (7, None), (8, None), (9, 8)}


def test_order_is_lower_triangular_and_ends_with_isolated(spark):
    down = {**random_forest(40, 3), 9001: None, 9000: None}
    order = net.ordered(make(spark, down))
    pairs = net.adjacency(order)
    assert net.not_lower_triangular(pairs).isEmpty()
    index = {r.reach_id: r.topo_idx for r in order.collect()}
    assert sorted(index.values()) == list(range(42)) and index[9000] < index[9001] == 41
    first = min(index, key=index.get)
    assert first not in down.values()
    assert pairs.count() == sum(d is not None for d in down.values())


def test_empty_and_single_networks(spark):
    empty = make(spark, {1: None}).limit(0)
    assert net.adjacency(net.ordered(empty)).isEmpty()
    assert [tuple(r) for r in net.ordered(make(spark, {7: None})).select("reach_id", "topo_idx").collect()] == [(7, 0)]


def test_nearest_gauge_bridge_and_unknown_gauge(spark):
    down = random_forest(50, 11)
    marked = sorted(down)[::6]
    flow = make(spark, down)
    gauges = spark.createDataFrame([(f"{i:08d}", r) for i, r in enumerate([*marked, marked[0], 99999])], "staid string, reach_id bigint")
    near = {r.reach_id: r.marked_id for r in top.nearest_marked(flow, gauges).collect()}
    for r in down:
        assert near[r] == next((at for at in walk(down, r) if at in marked), None)
    order = numbered_pieces(top.topology(flow), 7).order
    got = {(r.staid, r.reach_id) for r in net.gauge_reaches(order, gauges).collect()}
    want = {(g.staid, r) for g in gauges.collect() for r in down if g.reach_id in walk(down, r)} | {(f"{len(marked) + 1:08d}", 99999)}
    assert got == want
    up = {r.reach_id for r in top.upstream_of(flow, gauges.filter("reach_id = 99999").select("reach_id")).collect()}
    assert up == {99999}


def test_summed_inflow_equals_brute_force(spark):
    from datetime import date, timedelta

    down = random_forest(40, 5)
    rng = random.Random(1)
    marked = rng.sample(sorted(down), 7)
    marked.append(marked[0])  # two stations on one reach
    gauges = spark.createDataFrame([(f"{i:08d}", r) for i, r in enumerate(marked)], "staid string, reach_id bigint")
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(4)]
    series = {(r, d): (float("nan") if rng.random() < 0.2 else rng.random()) for r in down for d in days if rng.random() < 0.6}
    inflow = spark.createDataFrame([(r, d, q) for (r, d), q in series.items()], "reach_id bigint, d date, qr double")
    calendar = spark.createDataFrame([(d,) for d in days], "d date")
    topo, segment = gauge_structure(make(spark, down), gauges)
    got = {(r.staid, r.d): r.pred for r in summed_inflow(inflow, gauges, calendar, topo, segment).collect()}
    assert len(got) == len(marked) * len(days)
    for i, g in enumerate(marked):
        for d in days:
            want = sum(q for (r, day), q in series.items() if day == d and q == q and g in walk(down, r))
            assert got[f"{i:08d}", d] == pytest.approx(want)


def test_ghosts_are_shared(spark):
    flowpaths = spark.createDataFrame([("wb-1", "nex-1"), ("wb-2", "nex-1")], "id string, toid string")
    network = spark.createDataFrame([("nex-1", None)], "id string, toid string")
    with_ghost = {(r.id, r.down) for r in net.link_flowpaths(flowpaths, network, ghost=True).collect()}
    assert with_ghost == {("wb-1", "ghost-nex-1"), ("wb-2", "ghost-nex-1"), ("ghost-nex-1", None)}
    assert {r.down for r in net.link_flowpaths(flowpaths, network).collect()} == {None}


def test_pieces_stay_bounded_for_a_main_stem(spark):
    down = {i: (i - 1 if i else None) for i in range(60)}
    down.update({100 + i: i for i in range(60)})
    plan = layout(top.topology(make(spark, down)), 10)
    assert plan.groupBy("piece_id").count().agg({"count": "max"}).head()[0] <= 10
    assert plan.filter("out_down IS NOT NULL AND to_stage <= stage").isEmpty()


def test_ranks_with_hot_group_and_ties(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randrange(20), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = {(r.g, r.id): (r.rn, r.rn_total) for r in row_numbers(df, [df.v, df.id], ["g"]).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((v, i) for gg, v, i in rows if gg == g)
        for pos, (_, i) in enumerate(own, 1):
            assert got[g, i] == (pos, len(own))
    ranks = {r.id: r.rk for r in average_rank(df, ["g"], "v", ["id"], "rk").collect()}
    hot = [v for g, v, _ in rows if g == "hot"]
    for g, v, i in rows[:200]:
        if g == "hot":
            below, same = sum(x < v for x in hot), hot.count(v)
            assert ranks[i] == below + (same + 1) / 2


def test_quantiles_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"big": rng.normal(size=400), "few": rng.normal(size=4), "one": rng.normal(size=1)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.95}, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert (got[g].a, got[g].b, got[g].c) == pytest.approx(tuple(np.quantile(vs, [0.1, 0.5, 0.95])))


@pytest.mark.parametrize(("m", "limit", "seed"), [(1, 4, 0), (60, 5, 1), (90, 8, 2), (80, 4096, 3)])
def test_numbers_and_upstream_sums_equal_walks(spark, m, limit, seed):
    down = random_forest(m, seed)
    size, _ = expected(down)
    above = {r: {x for x in down if r in walk(down, x)} for r in down}
    made = numbered_pieces(top.topology(make(spark, down)), limit)
    rows = {r.reach_id: r for r in made.order.collect()}
    assert sorted(r.pre for r in rows.values()) == list(range(m))
    for r in down:
        assert rows[r].size == size[r]
        assert {x for x in down if rows[r].pre <= rows[x].pre < rows[r].pre + size[r]} == above[r]
        inside = {x for x in above[r] if rows[x].piece_id == rows[r].piece_id}
        assert {x for x in inside if rows[r].pos <= rows[x].pos < rows[r].pos + rows[r].span} == inside and len(inside) == rows[r].span
    rng = random.Random(seed)
    values = {(r, k): (None if rng.random() < 0.2 else rng.random()) for r in down for k in (0, 1, 2) if rng.random() < 0.7}
    df = spark.createDataFrame([(r, k, v, 1.0) for (r, k), v in values.items()], "reach_id bigint, k int, v double, w double")
    keys = F.array(*[F.lit(k) for k in (0, 1, 2)])
    got = pcs.upstream_sums(df, made, ["v", "w"], 0.5, ["k"], lambda x: x.withColumn("k", F.explode(keys))).collect()
    assert len(got) == 3 * m
    for r in got:
        v = sum(0.5 if values.get((x, r.k)) is None else values[x, r.k] for x in above[r.reach_id])
        w = sum(1.0 if (x, r.k) in values else 0.5 for x in above[r.reach_id])
        assert (r.v, r.w) == pytest.approx((v, w))


def test_grid_of_the_sums_is_shuffled_once(spark):
    from datetime import date

    from rillflow.operators.resample import daily_calendar
    from rillflow.plans.accumulation import daily_discharge

    made = numbered_pieces(top.topology(make(spark, random_forest(60, 4))), 6)
    inflow = spark.createDataFrame([(1, date(2024, 1, 1), 1.0)], "reach_id bigint, d date, qr double")
    daily = daily_discharge(inflow, made, daily_calendar(spark, date(2024, 1, 1), date(2024, 2, 9)))
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(piece_id") <= 1 and "Window" in plan


def test_one_subset_reads_few_files(spark, tmp_path):
    from rillflow.sources import readers, sinks

    down = {i: (i - 1 if i else None) for i in range(300)} | {1000 + i: i for i in range(300)}
    order = net.ordered(make(spark, down))
    pairs = net.adjacency(order)
    numbers = numbered_pieces(top.topology(make(spark, down)), 50).order
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    sinks.write_labelled_pairs(pairs, numbers, str(tmp_path))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    gauges = spark.createDataFrame([("00000001", 290), ("00000002", 0)], "staid string, reach_id bigint")
    assert sinks.write_gauge_subsets(gauges, numbers, order, str(tmp_path)) == 2
    files = spark.read.parquet(f"{tmp_path}/labelled_pairs").select(F.input_file_name()).distinct().count()
    far = readers.read_gauge_subset(spark, str(tmp_path), "00000001")
    assert far.count() == 19 and readers.read_gauge_subset(spark, str(tmp_path), "00000002").count() == 599
    assert far.select(F.input_file_name()).distinct().count() <= 2 < files
    assert "GreaterThanOrEqual(pre" in far._jdf.queryExecution().executedPlan().toString()
    both = readers.read_gauge_subsets(spark, str(tmp_path)).groupBy("staid").count().collect()
    assert {tuple(r) for r in both} == {("00000001", 19), ("00000002", 599)}


def test_reach_tables_meet_by_key(spark):
    """Small tables with a row per reach are not broadcast: the rounds of a large network would pass them all through the driver."""
    flow = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2)], "reach_id long, down_id long")
    pairs = flow.filter("down_id is not null").select(F.col("down_id").alias("dn_id"), F.col("reach_id").alias("up_id"), "reach_id")
    order = flow.select("reach_id", F.col("reach_id").alias("pre"), F.lit(1).alias("size"), F.col("reach_id").alias("topo_idx"))
    state = flow.select("*", F.col("down_id").alias("jump"), F.col("reach_id").alias("tip"), *[F.lit(0).cast("long").alias(c) for c in ("hops", "size", "level")], F.array().cast("array<bigint>").alias("jumps"))
    ranges = pcs.intervals(order, flow.select("reach_id"))
    plans = {
        "round": top._round(state, 0),
        "link": top.join_link(flow, "down_id", "reach_id", flow.select(F.col("reach_id").alias("down_id"), F.lit(1).alias("v"))),
        "ranges": ranges,
        "inside": pcs.inside(ranges.select("lo", "hi"), order),
        "labelled": net.labelled_pairs(pairs, order),
    }
    for name, df in plans.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name
