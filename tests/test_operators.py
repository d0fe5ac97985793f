"""Filters, cleaning, time steps, gauge tables, linear routing and identifiers."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from rillflow.functions import hydraulics as hyd
from rillflow.functions import ids
from rillflow.functions import values as val
from rillflow.operators import cleaning, gauges, lti, network, references, resample, summaries
from rillflow.operators.kernel import Scheme
from rillflow.operators.layout import layout
from rillflow.operators.routing import hourly, route
from rillflow.operators.topology import topology
from rillflow.plans import problem as prob
from rillflow.sources import readers, sinks

NAN = float("nan")


def column(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_identifiers(spark):
    assert column(spark, ["123", "01234567", "123456789"], ids.zero_filled, "string") == ["00000123", "01234567", "123456789"]
    assert column(spark, ["wb-12", "nex-7.0"], ids.number_of, "string") == [12, 7]
    conv = ids.converter_for("lynker")
    assert column(spark, ["wb-12", "ghost-3"], lambda c: conv.from_number(conv.to_number(c)), "string") == ["wb-12", "wb-3"]
    with pytest.raises(ValueError, match="hydrofabric_v2.2, lynker, merit"):
        ids.converter_for("unknown")
    ids.register_converter("plain", ids.converter_for("merit"))
    assert "plain" in ids.registered()
    assert ids.bucket_and_prefix("s3://some-bucket/a/b") == ("some-bucket", "a/b")
    with pytest.raises(ValueError):
        prob.source_for("absent")


def test_flow_scale(spark):
    cases = [
        (90.0, 100.0, 20.0, 0.5), (95.0, 100.0, 20.0, 0.75), (80.0, 100.0, 20.0, 1.0), (110.0, 100.0, 20.0, 1.0), (100.0, 100.0, 20.0, 1.0),
        (90.0, 100.0, 0.0, 1.0), (90.0, 100.0, -5.0, 1.0), (70.0, 100.0, 20.0, 1.0), (99.9, 100.0, 20.0, 0.995), (80.0, 100.0, 50.0, 0.6),
        (NAN, 100.0, 20.0, 1.0), (90.0, None, 20.0, 1.0),
    ]
    df = spark.createDataFrame(cases, "d double, r double, u double, want double")
    for row in df.select(val.flow_scale(F.col("d"), F.col("r"), F.col("u")).alias("f"), "want").collect():
        assert row.f == pytest.approx(row.want)


def test_area_validity(spark):
    df = spark.createDataFrame([(60.0, 30.0), (150.0, 30.0), (150.0, 200.0), (10.0, None), (NAN, 5.0)], "g double, u double")
    assert [r[0] for r in df.select(val.area_gap_valid(F.col("g"), F.col("u"))).collect()] == [True, False, True, False, False]


def test_cleaning_values(spark):
    got = column(spark, [NAN, None, -2.0, 0.0, 3.0], val.floored_flow)
    assert got == [1e-6, 1e-6, 1e-6, 1e-6, 3.0]
    got = column(spark, [NAN, float("inf"), -2.0, 0.0, 3.0], val.patched_flow)
    assert got == [1e-6, 1e-6, -2.0, 1e-6, 3.0]
    assert column(spark, [35.3147], val.ft3_to_m3)[0] == pytest.approx(1.0, rel=1e-4)
    assert column(spark, [8.64], lambda c: val.mm_day_to_m3s(c, F.lit(10.0)))[0] == pytest.approx(1.0)


def test_clamps_keep_null(spark):
    assert column(spark, [None, 0.5, 2.0], lambda c: hyd.at_least(c, 1.0)) == [None, 1.0, 2.0]
    assert column(spark, [None, -1.0, 9.0], lambda c: hyd.between(c, 0.0, 5.0)) == [None, 0.0, 5.0]
    got = column(spark, [0.0, 1.0], lambda c: hyd.denormalize(c, (1.0, 200.0), True))
    assert got == pytest.approx([1.000001, 200.0])


def test_statistics_fill_and_adapters(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 10.0), (5, NAN)], "reach_id bigint, a double")
    s = cleaning.attribute_statistics(df, ["a"]).head()
    assert (s.min, s.max, s.mean) == (1.0, 10.0, 4.0) and s.p10 == pytest.approx(1.3)
    assert s["std"] == pytest.approx(np.std([1, 2, 3, 10]))
    scores = cleaning.fill_and_standardize(df, cleaning.attribute_statistics(df, ["a"]), ["a"])
    assert {r.reach_id: r.a for r in scores.collect()}[5] == 0.0
    filled = {r.reach_id: r.a for r in cleaning.fill_with_finite_mean(df, ["a"]).collect()}
    assert filled[5] == 4.0
    atlas = spark.createDataFrame([(1, *[100.0] * 10)], "reach_id bigint, " + ", ".join(f"{n} double" for _, n in cleaning.NATIVE_AND_HYDROATLAS))
    row = cleaning.adapt_attributes(atlas).head()
    assert list(row.asDict())[1:] == list(cleaning.NATIVE_ATTRIBUTES)
    assert row.log10_uparea == pytest.approx(2.0) and row.aridity == 100.0
    with pytest.raises(ValueError):
        cleaning.adapt_attributes(df)
    with pytest.raises(ValueError, match="missing"):
        cleaning.adapt_attributes(atlas.drop("por_pc_sav"), "hydroatlas")
    with pytest.raises(KeyError):
        cleaning.require_all(df, df.filter("reach_id > 2"), "reach_id")


def test_gauge_filters(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "staid string")
    g = spark.createDataFrame([("a", 5.0, True), ("b", 80.0, True), ("c", NAN, False)], "staid string, abs_diff double, da_valid boolean")
    names = lambda df: sorted(r.staid for r in df.collect())
    assert names(gauges.within_area_gap(wanted, g, 50.0)) == ["a"]
    assert names(gauges.with_valid_area(wanted, g)) == ["a", "b"]
    assert gauges.removed_count(wanted, gauges.with_valid_area(wanted, g)).head()[0] == 2
    with pytest.raises(KeyError):
        gauges.within_area_gap(wanted, g.drop("abs_diff"), 1.0)
    links = spark.createDataFrame([("b",), ("c",)], "staid string")
    assert names(gauges.training_gauges(wanted, g, links, 50.0)) == ["b"]
    assert names(gauges.training_gauges(wanted, g.drop("da_valid"), links, 50.0)) == []
    assert names(gauges.training_gauges(wanted, g.drop("da_valid"), links, None)) == ["b", "c"]
    many = spark.createDataFrame([(f"{i:08d}",) for i in range(23)], "staid string")
    batches = gauges.sample_batches(many, 5, 1).groupBy("batch").count().collect()
    assert {r["count"] for r in batches} == {5} and len(batches) == 4
    obs = spark.createDataFrame([("a", 1.0), ("a", NAN), ("b", 2.0)], "staid string, streamflow double")
    assert names(gauges.complete_gauges(obs)) == ["b"]


def test_calendars(spark):
    first, last = date(2020, 1, 1), date(2020, 1, 10)
    assert resample.daily_calendar(spark, first, last).count() == 10
    assert resample.hourly_calendar(spark, first, last).count() == 216
    assert resample.hourly_calendar(spark, first, date(2020, 1, 5)).count() == 96
    df = spark.createDataFrame([(date(1980, 1, 1),), (date(1981, 1, 1),)], "d date")
    assert [r[0] for r in df.select(resample.day_number(F.col("d"))).collect()] == [0, 366]
    with pytest.raises(ValueError):
        resample.check_rho(11, 10)
    a, b = resample.random_window(first, 10, 4, seed=3)
    assert (b - a).days == 3 and first <= a and b <= last
    windows = resample.tumbling_windows(resample.daily_calendar(spark, first, last), 10, 4).groupBy("window_no").count().collect()
    assert {(r.window_no, r["count"]) for r in windows} == {(0, 4), (1, 4)}
    chunks = resample.chunks_with_lead(resample.daily_calendar(spark, first, last), 4)
    got = {r.chunk: sorted(r.days) for r in chunks.groupBy("chunk").agg(F.collect_list("day_idx").alias("days")).collect()}
    assert got == {0: [0, 1, 2, 3], 1: [3, 4, 5, 6, 7], 2: [7, 8, 9]}


@pytest.mark.parametrize("length,bins", [(216, 9), (50, 7), (147, 6), (10, 10)])
def test_area_downsample_equals_definition(spark, length, bins):
    v = np.random.default_rng(length).normal(size=length)
    df = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate(v)], "k string, i int, v double")
    got = {r.bin: r.v for r in resample.area_downsample(df, "k", "i", "v", length, bins).collect()}
    for b in range(bins):
        lo, hi = b * length // bins, -(-(b + 1) * length // bins)
        assert got[b] == pytest.approx(v[lo:hi].mean())


def test_daily_runoff_lengths(spark):
    for hours, tau, days in ((240, 3, 9), (72, 3, 2)):
        df = spark.range(hours).select(F.lit("g").alias("g"), F.col("id").alias("i"), F.lit(1.0).alias("q"))
        assert resample.daily_runoff(df, "g", "i", "q", hours, tau).count() == days
    assert resample.trimmed_slice(240, 11) == (24, 24)  # an end at zero leaves nothing


def test_interpolation_keeps_the_phase_of_the_samples(spark):
    rows = [("k", datetime(2024, 1, 1, 1) + timedelta(hours=3 * i), float(v)) for i, v in enumerate([0, 3, 9])]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    got = {r.ts: r.v for r in resample.interpolate(df, "k", "ts", "v", 3).collect()}
    want = [0, 1, 2, 3, 5, 7]
    assert got == {datetime(2024, 1, 1, 1 + i): pytest.approx(v) for i, v in enumerate(want)}


def _with_gaps(spark):
    """Three reaches (one without rows, one listed twice) over four days, as given rows with gaps and as the full grid."""
    start, n = datetime(2024, 1, 1), 96
    given = [(1, h, float(h * h % 17)) for h in (0, 1, 30, 31, 57, 95)] + [(1, 5, None), (1, -1, 9.0), (1, 96, 9.0)] + [(3, h, h / 7) for h in range(3, 90)]
    rows = [(k, start + timedelta(hours=h), h, v) for k, h, v in [*given, (7, 4, 1.0), (None, 4, 1.0)]]
    schema = "k long, ts timestamp_ntz, i long, v double"
    keys = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "k long")
    known = {(k, h): v for k, h, v in given if v is not None}
    grid = [(k, start + timedelta(hours=h), h, known.get((k, h), 0.5)) for k in (1, 2, 3, 3, None) for h in range(n)]
    return spark.createDataFrame(rows, schema), spark.createDataFrame(grid, schema), resample.Gaps(keys, start, n, 0.5)


def test_gaps_equal_the_full_grid(spark):
    given, grid, gaps = _with_gaps(spark)
    pairs = [
        (resample.hourly_to_daily(df, "k", "ts", "v", **g), resample.hourly_to_daily(df, "k", "ts", "v", False, **g),
         resample.area_downsample(df, "k", "i", "v", 96, 7, **g), resample.daily_runoff(df, "k", "i", "v", 96, 3, **g),
         resample.daily_runoff(df, "k", "i", "v", 96, 0, 13, **g), resample.daily_runoff(df, "k", "i", "v", 30, 3, **g),
         resample.interpolate(df if g else df.filter("i % 3 = 0"), "k", "ts", "v", 3, **g))
        for df, g in ((given, {"gaps": gaps}), (grid, {}))
    ]
    for a, b in zip(*pairs, strict=True):
        assert a.dtypes == b.dtypes
        a, b = ({(r[0], r[1]): r[2] for r in x.collect()} for x in (a, b))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in b)


def test_gaps_shuffle_no_grid(spark):
    """No exchange, sort or aggregate stands above the rows that are made for the missing hours."""
    given, _, gaps = _with_gaps(spark)
    for out in (
        resample.hourly_to_daily(given, "k", "ts", "v", gaps=gaps), resample.area_downsample(given, "k", "i", "v", 96, 7, gaps),
        resample.daily_runoff(given, "k", "i", "v", 96, 3, gaps=gaps), resample.interpolate(given, "k", "ts", "v", 3, gaps),
    ):
        plan = out._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("Generate")]
        assert not any(step in above for step in ("Exchange", "Sort", "Aggregate", "Join"))


def test_coverage_errors(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 1),), (datetime(2020, 2, 1),)], "ts timestamp_ntz")
    resample.check_coverage(df, "ts", datetime(2020, 1, 1), datetime(2020, 1, 31))
    # the last value stands for its whole hour, or day
    resample.check_coverage(df, "ts", datetime(2020, 1, 1), datetime(2020, 2, 1, 1))
    resample.check_coverage(df, "ts", datetime(2020, 1, 1), datetime(2020, 2, 2), timedelta(days=1))
    with pytest.raises(ValueError):
        resample.check_coverage(df, "ts", datetime(2020, 1, 1), datetime(2020, 2, 1, 2))
    with pytest.raises(ValueError):
        resample.check_coverage(df, "ts", datetime(2019, 12, 31), datetime(2020, 1, 31))
    with pytest.raises(ValueError):
        resample.check_coverage(df, "ts", datetime(2020, 1, 1), datetime(2020, 3, 1))


def test_reference_tables(spark):
    g = spark.createDataFrame([("00000001", 80.0, 1), ("00000002", 80.0, 2), ("000000003", 80.0, None)], "staid string, drain_sqkm double, reach_id bigint")
    rivers = spark.createDataFrame([(1, 100.0)], "reach_id bigint, uparea double")
    units = spark.createDataFrame([(1, 50.0)], "reach_id bigint, unitarea double")
    rows = {r.staid: r for r in references.with_reach_areas(g, rivers, units).collect()}
    assert rows["00000001"].abs_diff == 20 and rows["00000001"].da_valid and rows["00000001"].flow_scale == pytest.approx(0.6)
    assert rows["00000002"].abs_diff is None and not rows["00000002"].da_valid and rows["00000002"].flow_scale == 1.0
    assert references.usable_gauges(g).count() == 2


def test_points_in_polygons(spark):
    rings = {1: [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], 2: [(5, 0), (9, 0), (7, 6)]}
    polys = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in r]) for k, r in rings.items()], "poly_id int, ring array<struct<x:double,y:double>>")
    points = {1: (1.0, 1.0), 2: (2.0, 3.0), 3: (7.0, 2.0), 4: (8.9, 3.0), 5: (-1.0, 1.0)}
    df = spark.createDataFrame([(k, *p) for k, p in points.items()], "point_id int, lon double, lat double")
    got = {r.point_id: r.poly_id for r in references.points_in_polygons(df, polys, cell=1.5).collect()}
    assert got == {1: 1, 2: None, 3: 2, 4: None, 5: None}


@pytest.mark.parametrize("kind", lti.RESPONSES)
def test_unit_responses_conserve_mass(kind):
    h = lti.unit_response(kind, 0.2, 0.2, 400, 1 / 24)
    assert h.sum() == pytest.approx(1.0) and len(h) == 400
    if kind == "pure_lag":
        assert h.argmax() in (4, 5)


@pytest.mark.parametrize("kind", lti.RESPONSES)
def test_no_response_is_cut_short(kind):
    with pytest.raises(ValueError, match="steps"):
        lti.unit_response(kind, 10.0, 0.2, 96, 1 / 24)
    whole, longer = lti.unit_response(kind, 10.0, 0.2, None, 1 / 24), lti.unit_response(kind, 10.0, 0.2, 20_000, 1 / 24)
    assert np.allclose(whole, longer[: len(whole)]) and longer[len(whole) :].sum() < 1e-9


def test_linear_routing_equals_convolution(spark):
    start, hours = datetime(2024, 1, 1), 60
    down = {0: None, 1: 0, 2: 0, 3: 1, 4: 3}
    rng = np.random.default_rng(0)
    inflow = rng.gamma(1.0, 2.0, (hours, 5))
    rows = [(i, start + timedelta(hours=t), float(inflow[t, i])) for i in range(5) for t in range(hours)]
    flow = spark.createDataFrame(list(down.items()), "reach_id bigint, down_id bigint")
    series = spark.createDataFrame(rows, "reach_id bigint, ts timestamp_ntz, qr double")
    scheme = Scheme(n_hours=hours, chunk=17)
    routed = route(layout(topology(flow), 2), lti.lti_parameters(flow, 0.2, 0.2), series, start, scheme, stepper=lti.lti_stepper("nash_cascade"))
    got = {(r.reach_id, r.hour_idx): r.q for r in hourly(routed, start, scheme).collect()}
    h = lti.unit_response("nash_cascade", 0.2, 0.2, None, 1 / 24)
    out = {}
    for i in (4, 3, 2, 1, 0):
        total = inflow[:, i] + sum((out[j] for j in down if down[j] == i), np.zeros(hours))
        out[i] = np.convolve(total, h)[:hours]
        np.testing.assert_allclose([got[i, t] for t in range(hours)], out[i], rtol=1e-9, atol=1e-9)


def test_linear_parameter_table(spark):
    reaches = spark.createDataFrame([(1,)], "reach_id bigint")
    row = lti.parameter_table(reaches, k=F.lit(9000.0), x=F.lit(0.25)).head()
    assert row.k == pytest.approx(9000 / 86400) == row.tau == row.delay and row.x == 0.25
    assert lti.parameter_table(reaches).head().x == 0.3
    with pytest.raises(ValueError):
        lti.unit_response("magic", 1, 0.3, 3, 1)


def test_summaries(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)] + [(9, NAN)], "k int, v double")
    assert [r.cdf for r in summaries.cumulative_distribution(df, "v", "k").orderBy("v").collect()] == [0, 0.25, 0.5, 0.75, 1]
    areas = spark.createDataFrame([(0.0,), (1000.0,), (1000.1,), (60000.0,)], "a double")
    assert [r[0] for r in areas.select(summaries.area_class(F.col("a"))).collect()] == [None, "0-1000", "1000-5000", None]
    q = spark.createDataFrame([(1, 2.0), (2, 5.0), (3, 5.0)], "reach_id bigint, q double")
    assert summaries.plotted_reaches(q, None).head()[0] == 2
    assert summaries.plotted_reaches(q, q.filter("reach_id = 1").select("reach_id")).head()[0] == 1
    assert summaries.color_limit(spark.createDataFrame([(0.05,), (-0.02,)], "delta double")).head()[0] == pytest.approx(0.1)
    bins = summaries.log_histogram(spark.createDataFrame([(0.1,), (1000.0,), (5000.0,)], "v double"), "v").collect()
    assert {(r.bin, r.n) for r in bins} == {(0, 1), (49, 1)}


def test_ties_do_not_gather_in_one_partition(spark, tmp_path):
    """Nine of ten rows hold the floor value; the ranked table has one row for it."""
    from rillflow.operators import ranking

    df = spark.range(40_000).select(F.lit(1).alias("g"), F.when(F.col("id") % 10 > 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    row = ranking.quantiles(df, "v", {"low": 0.5, "high": 0.95, "top": 1.0}, ["g"]).head()
    values = np.sort([0.0 if i % 10 else float(i) for i in range(40_000)])
    assert (row.low, row.high, row.top) == tuple(pytest.approx(np.quantile(values, p)) for p in (0.5, 0.95, 1.0))
    counted = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    placed = ranking.running_counts(counted, [F.col("v")], "n", ["g"])
    assert placed.filter("v = 0").count() == 1 and placed.agg(F.max(F.col("_before") + F.col("n"))).head()[0] == 40_000


def test_inflow_reads_only_its_months(spark, tmp_path):
    from rillflow.sources import readers, sinks

    rows = [(i % 5, datetime(2024, 1 + i // 24, 1 + i % 24), float(i)) for i in range(24 * 6)]
    sinks.write_by_month(spark.createDataFrame(rows, "reach_id bigint, ts timestamp_ntz, qr double"), str(tmp_path / "store"))
    got = readers.read_period(spark, str(tmp_path / "store"), datetime(2024, 3, 2), datetime(2024, 4, 5))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan
    assert got.count() == sum(datetime(2024, 3, 2) <= ts < datetime(2024, 4, 5) for _, ts, _ in rows)


def test_disjoint_attributes_absent_reaches_and_doubled_hours_fail(spark):
    from rillflow.operators import kan
    from rillflow.operators.routing import pack_inflow

    reaches = spark.createDataFrame([(1,), (2,)], "reach_id bigint")
    other = spark.createDataFrame([(9, 1.0)], "reach_id bigint, a double")
    with pytest.raises(ValueError, match="no reach has catchment attributes"):
        cleaning.join_attributes(reaches, other, ["a"])
    shape = kan.KanShape(("a",), ("n",), hidden=2, layers=1, grid=2, k=1)
    missing = spark.createDataFrame([(1, None)], "reach_id bigint, a double")
    with pytest.raises(Exception, match="no value of a"):
        kan.predict(missing, shape, kan.initial_weights(shape, 1)).collect()
    twice = spark.createDataFrame([(1, datetime(2024, 1, 1, 3), 1.0), (1, datetime(2024, 1, 1, 3), 2.0)], "reach_id bigint, ts timestamp_ntz, qr double")
    with pytest.raises(Exception, match="two values for one time"):
        pack_inflow(twice, datetime(2024, 1, 1), Scheme(n_hours=24, chunk=12)).collect()


def test_parameters_of_absent_reaches_are_filled_after_the_join(spark):
    from dataclasses import replace

    from rillflow.functions.hydraulics import Physics
    from rillflow.plans import problem as prob

    chain = spark.createDataFrame([(1, 2), (2, 3), (3, None)], "reach_id bigint, down_id bigint")
    known = spark.createDataFrame([(1, 100.0, 0.01), (3, 300.0, 0.03)], "reach_id bigint, length_m double, slope double")
    unit = spark.createDataFrame([(i, 0.5, 0.5) for i in (1, 2, 3)], "reach_id bigint, n double, q_spatial double")
    one = prob.RoutingProblem(chain, chain, 0, known, Scheme(1, 1), datetime(2024, 1, 1))
    got = {r.reach_id: r for r in prob.channel_parameters(one, unit).collect()}
    assert got[2].length_m == pytest.approx(200.0) and got[2].slope == pytest.approx(0.02)
    wide = replace(one, physics=Physics(ranges={"n": (0.0, 1.0), "q_spatial": (0.0, 4.0)}, log_space=(), defaults={"p_spatial": 7.0}))
    row = prob.channel_parameters(wide, unit).filter("reach_id = 1").head()
    assert (row.n, row.q_spatial, row.p_spatial) == (0.5, 2.0, 7.0)


def test_changed_minimums_are_refused():
    from rillflow.config import Config, Params

    Config().check()
    with pytest.raises(ValueError, match="attribute_minimums"):
        Config(params=Params(attribute_minimums={"depth": 1.0})).check()


def test_gauges_without_a_flowpath_fail(spark):
    from rillflow.operators import network

    gauges = spark.createDataFrame([("00000001", 5.0), ("00000002", 5.0)], "staid string, drain_sqkm double")
    rows = spark.createDataFrame([("wb-7", "gages-00000001", 4.0)], "id string, hl_uri string, tot_drainage_areasqkm double")
    assert [r.staid for r in network.gauges_without_origin(gauges, rows).collect()] == ["00000002"]
    with pytest.raises(Exception, match="no flowpath carries gauge 00000002"):
        network.gauge_origin(gauges, rows, rows).collect()


def test_batch_pairs_of_nested_gauges(spark):
    pairs = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("b", 2, 1), ("c", 9, 8)], "staid string, dn_idx long, up_idx long")
    batch = spark.createDataFrame([("a",), ("b",), ("missing",)], "staid string")
    assert sorted(map(tuple, network.batch_pairs(pairs, batch).collect())) == [(1, 0), (2, 1)]


def test_first_and_last_day_are_dropped(spark):
    days = spark.createDataFrame([(date(2001, 1, d),) for d in range(1, 6)], "d date")
    out = resample.without_ends(days, "d", date(2001, 1, 1), date(2001, 1, 5))
    assert sorted(r["d"].day for r in out.collect()) == [2, 3, 4]


def test_stored_baseline_and_gauge_tables(spark, tmp_path):
    gauge = spark.createDataFrame([("02", 1.5), ("01", 2.5)], "STAID string, q double")
    path = str(tmp_path / "summed")
    assert readers.read_summed(spark, path, gauge.select(F.col("STAID").alias("staid"))) is None
    gauge.select(F.col("STAID").alias("staid"), "q").write.parquet(path)
    known, unknown = (spark.createDataFrame([(x,)], "staid string") for x in ("01", "99"))
    assert [tuple(r) for r in readers.read_summed(spark, path, known).collect()] == [("01", 2.5)]
    assert readers.read_summed(spark, path, unknown) is None
    sinks.write_gauge_tables({"all": gauge, "one": gauge.filter("STAID = '02'")}, str(tmp_path / "csv"))
    texts = {k: ["".join(f.read_text() for f in (tmp_path / "csv" / k).glob("part-*"))] for k in ("all", "one")}
    assert texts == {"all": ["STAID,q\n01,2.5\n02,1.5\n"], "one": ["STAID,q\n02,1.5\n"]}


def test_two_values_for_one_time_are_an_error(spark):
    from rillflow.sources.readers import single_values

    t = datetime(2024, 1, 1)
    good = spark.createDataFrame([(1, t, 2.0), (1, t + timedelta(hours=1), 3.0), (2, t, None)], "reach_id bigint, ts timestamp_ntz, qr double")
    assert sorted(map(tuple, single_values(good).collect()), key=repr) == sorted(map(tuple, good.collect()), key=repr)
    with pytest.raises(Exception, match="two inflow values for reach 1 at"):
        single_values(good.unionByName(good.limit(1))).collect()


def test_balance_summary_and_statistics(spark):
    from rillflow.plans.comparison import balance_summary, located

    df = spark.createDataFrame([("a", 0.1), ("b", 0.5), ("c", 0.3), ("d", None)], "staid string, mass_error double")
    row = balance_summary(df).head()
    assert (row.mean_error, row.median_error) == (pytest.approx(0.3), pytest.approx(0.3))
    where = spark.createDataFrame([("a", 1.0, 2.0), ("z", 3.0, 4.0)], "staid string, lat double, lon double")
    assert [tuple(r) for r in located(df, where).collect()] == [("a", 0.1, 1.0, 2.0)]
    stats = {r.g: r for r in summaries.histogram_statistics(df.withColumn("g", F.lit("x")), "mass_error", ["g"]).collect()}
    assert stats["x"].n == 3 and stats["x"].median == pytest.approx(0.3) and stats["x"].std == pytest.approx(np.std([0.1, 0.5, 0.3]))
