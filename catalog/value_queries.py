"""Cleaning, time-step and hydraulics queries."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.stand_in import flow, table, with_tables
from rillflow.functions import hydraulics as hyd
from rillflow.functions import values as val
from rillflow.operators import cleaning, resample
from rillflow.operators.cleaning import NATIVE_ATTRIBUTES

FIRST, LAST = date(2024, 1, 1), date(2024, 1, 30)
NATIVE_SQL = {
    "SoilGrids1km_clay": "cly_pc_sav",
    "aridity": "ari_ix_sav",
    "meanelevation": "ele_mt_sav",
    "meanP": "pre_mm_syr",
    "NDVI": "ndv_ix_sav",
    "meanslope": "slp_dg_sav",
    "log10_uparea": "log10(greatest(upa_sk_smx, 0.000001))",
    "SoilGrids1km_sand": "snd_pc_sav",
    "ETPOT_Hargr": "pet_mm_syr",
    "Porosity": "por_pc_sav",
}
NATIVE = ", native AS (SELECT reach_id, " + ", ".join(f"{e} AS {n}" for n, e in NATIVE_SQL.items()) + " FROM attributes)\n"


def _native(spark, sf_dir):
    return cleaning.adapt_attributes(table(spark, sf_dir, "attributes"))


def rounded(df, digits, keep, names):
    return df.select(*keep, *[(F.round(n, digits) + 0.0).alias(n) for n in names])


@query(
    "a_adapt",
    with_tables("attributes", body=NATIVE + "SELECT reach_id, " + ", ".join(f"round({n}, 8) + 0.0 AS {n}" for n in NATIVE_ATTRIBUTES) + " FROM native"),
)
def a_adapt(spark, sf_dir):
    return rounded(_native(spark, sf_dir), 8, ["reach_id"], NATIVE_ATTRIBUTES)


@query(
    "a_stats",
    with_tables(
        "attributes",
        body=NATIVE + " UNION ALL ".join(
            f"""SELECT '{n}' AS attr, round(min({n}), 6) AS min, round(max({n}), 6) AS max, round(avg({n}), 6) AS mean,
            round(stddev_pop({n}), 6) AS std, round(quantile_cont({n}, 0.1), 6) AS p10, round(quantile_cont({n}, 0.9), 6) AS p90 FROM native"""
            for n in NATIVE_ATTRIBUTES
        ),
    ),
)
def a_stats(spark, sf_dir):
    stats = cleaning.attribute_statistics(_native(spark, sf_dir), list(NATIVE_ATTRIBUTES))
    return stats.select("attr", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std", "p10", "p90")])


@query(
    "a_fill_zscore",
    with_tables(
        "attributes",
        body=NATIVE + "SELECT r.reach_id, "
        + ", ".join(f"round((coalesce({n}, m_{n}) - m_{n}) / s_{n}, 6) + 0.0 AS {n}" for n in NATIVE_ATTRIBUTES)
        + " FROM native r, (SELECT "
        + ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in NATIVE_ATTRIBUTES)
        + " FROM native) s",
    ),
)
def a_fill_zscore(spark, sf_dir):
    native = _native(spark, sf_dir)
    names = list(NATIVE_ATTRIBUTES)
    joined = cleaning.join_attributes(flow(spark, sf_dir).select("reach_id"), native, names)
    scores = cleaning.fill_and_standardize(joined, cleaning.attribute_moments(native, names), names)
    return rounded(scores, 6, ["reach_id"], names)


@query(
    "a_physical_fill",
    with_tables(
        "reach",
        body="""SELECT reach_id, round(coalesce(top_width, tw), 6) AS top_width, round(coalesce(side_slope, ss), 6) AS side_slope
          FROM reach, (SELECT avg(top_width) AS tw, avg(side_slope) AS ss FROM reach) m""",
    ),
)
def a_physical_fill(spark, sf_dir):
    r = table(spark, sf_dir, "reach").select("reach_id", "top_width", "side_slope")
    return rounded(cleaning.fill_with_finite_mean(r, ["top_width", "side_slope"]), 6, ["reach_id"], ["top_width", "side_slope"])


@query(
    "a_units",
    with_tables(
        "gauge",
        body="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 0.0283168, 9) AS m3s,
            round(l_quantity * (l_extendedprice / 100e0) * 1000e0 / 86400e0, 10) AS from_mm_day FROM lineitem""",
    ),
)
def a_units(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(val.ft3_to_m3(F.col("l_quantity")), 9).alias("m3s"),
        F.round(val.mm_day_to_m3s(F.col("l_quantity"), F.col("l_extendedprice") / 100.0), 10).alias("from_mm_day"),
    )


RAW = """, raw AS (SELECT event_id, user_id % 10 AS zone, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 0.0
    WHEN event_id % 13 = 0 THEN -value ELSE value END AS q FROM events)
"""


def _raw(spark, sf_dir):
    e, v = F.col("event_id"), F.col("value")
    q = F.when(e % 7 == 0, F.lit(float("nan"))).when(e % 11 == 0, F.lit(0.0)).when(e % 13 == 0, -v).otherwise(v)
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("zone"), q.alias("q"))


@query(
    "a_clean",
    "WITH base AS (SELECT 1)" + RAW + """SELECT event_id, greatest(coalesce(q, 0.000001), 0.000001) AS floored,
      CASE WHEN q IS NULL OR q = 0 THEN 0.000001 ELSE q END AS patched FROM raw""",
)
def a_clean(spark, sf_dir):
    q = F.col("q")
    return _raw(spark, sf_dir).select("event_id", val.floored_flow(q).alias("floored"), val.patched_flow(q).alias("patched"))


@query(
    "a_report",
    "WITH base AS (SELECT 1)" + RAW + """SELECT zone, count(*) FILTER (q IS NULL) AS n_missing, count(*) FILTER (q < 0.000001) AS n_below_floor,
      count(*) FILTER (q < 0) AS n_negative, min(q) AS min, round(quantile_cont(q, 0.5), 6) AS median, max(q) AS max FROM raw GROUP BY zone""",
)
def a_report(spark, sf_dir):
    r = cleaning.flow_report(_raw(spark, sf_dir), "q", ["zone"])
    return r.withColumn("median", F.round("median", 6))


@query(
    "a_flow_scale",
    with_tables(
        "gauge",
        body="""SELECT staid, round(CASE WHEN comid_unitarea_sqkm > 0 AND drain_sqkm - comid_drain_sqkm < 0
            AND abs(drain_sqkm - comid_drain_sqkm) < comid_unitarea_sqkm
          THEN (comid_unitarea_sqkm - abs(drain_sqkm - comid_drain_sqkm)) / comid_unitarea_sqkm ELSE 1.0 END, 9) AS flow_scale FROM gauge""",
    ),
)
def a_flow_scale(spark, sf_dir):
    cols = [F.col(c) for c in ("drain_sqkm", "comid_drain_sqkm", "comid_unitarea_sqkm")]
    return table(spark, sf_dir, "gauge").select("staid", F.round(val.flow_scale(*cols), 9).alias("flow_scale"))


@query(
    "a_da_valid",
    with_tables(
        "gauge",
        body="""SELECT staid, round(abs(drain_sqkm - comid_drain_sqkm * 3), 6) AS gap,
          coalesce(abs(drain_sqkm - comid_drain_sqkm * 3) <= CASE WHEN comid_unitarea_sqkm IS NULL THEN NULL ELSE greatest(comid_unitarea_sqkm * 90, 100.0) END, false) AS ok FROM gauge""",
    ),
)
def a_da_valid(spark, sf_dir):
    gap = val.area_gap(F.col("drain_sqkm"), F.col("comid_drain_sqkm") * 3)
    ok = val.area_gap_valid(gap, F.col("comid_unitarea_sqkm") * 90)
    return table(spark, sf_dir, "gauge").select("staid", F.round(gap, 6).alias("gap"), ok.alias("ok"))


@query(
    "o_ood_counts",
    with_tables(
        "attributes",
        body=NATIVE + " UNION ALL ".join(
            f"""SELECT '{n}' AS attr, count(*) FILTER ({n} < lo) AS n_below, count(*) FILTER ({n} > hi) AS n_above
              FROM native, (SELECT quantile_cont({n}, 0.1) AS lo, quantile_cont({n}, 0.9) AS hi FROM native WHERE reach_id IN (SELECT DISTINCT l_partkey FROM lineitem))"""
            for n in NATIVE_ATTRIBUTES
        ),
    ),
)
def o_ood_counts(spark, sf_dir):
    """Statistics of one set of catchments (parts that were sold) applied to all of them."""
    names = list(NATIVE_ATTRIBUTES)
    native = _native(spark, sf_dir)
    known = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("reach_id"))
    stats = cleaning.attribute_statistics(native.join(known, "reach_id", "left_semi"), names)
    return cleaning.out_of_distribution(native, stats, names)


# ---------------------------------------------------------------- time


@query(
    "t_calendar",
    with_tables(
        "observed",
        body="""SELECT o.staid, o.d, c.day_no, c.day_idx FROM observed o JOIN (
          SELECT CAST(DATE '2024-01-01' + CAST(i AS INT) AS DATE) AS d, CAST(date_diff('day', DATE '1980-01-01', DATE '2024-01-01') + i AS INT) AS day_no, i AS day_idx
          FROM range(30) t(i)) c ON c.d = o.d""",
    ),
)
def t_calendar(spark, sf_dir):
    return table(spark, sf_dir, "observed").select("staid", "d").join(resample.daily_calendar(spark, FIRST, LAST), "d").select(
        "staid", "d", "day_no", "day_idx"
    )


@query(
    "t_day_index",
    """SELECT o_orderkey, CAST(date_diff('day', DATE '1980-01-01', CAST(o_orderdate AS DATE)) AS INT) AS day_no,
      strftime(o_orderdate, '%Y/%m/%d') AS label FROM orders""",
)
def t_day_index(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", resample.day_number(d).alias("day_no"), F.date_format(d, "yyyy/MM/dd").alias("label")
    )


@query(
    "t_windows",
    with_tables(
        "inflow_daily",
        body="""SELECT reach_id, CAST(floor(date_diff('day', DATE '2024-01-01', d) / 7) AS BIGINT) AS window_no, count(*) AS n_days, round(sum(qr), 6) AS volume
          FROM inflow_daily WHERE floor(date_diff('day', DATE '2024-01-01', d) / 7) < 4 GROUP BY 1, 2""",
    ),
)
def t_windows(spark, sf_dir):
    days = resample.tumbling_windows(resample.daily_calendar(spark, FIRST, LAST), 30, 7)
    joined = table(spark, sf_dir, "inflow_daily").join(days.select("d", "window_no"), "d")
    return joined.groupBy("reach_id", "window_no").agg(F.count("*").alias("n_days"), F.round(F.sum("qr"), 6).alias("volume"))


@query(
    "t_chunks_with_lead",
    with_tables(
        "inflow_daily",
        body=""", c AS (SELECT i AS day_idx, CAST(floor(i / 7) AS BIGINT) AS chunk FROM range(30) t(i)
            UNION ALL SELECT i, CAST(floor(i / 7) AS BIGINT) + 1 FROM range(30) t(i) WHERE (i + 1) % 7 = 0 AND i < 28)
          SELECT c.chunk, count(*) AS n_rows, count(DISTINCT f.d) AS n_days, round(sum(f.qr), 5) AS volume FROM c
          JOIN inflow_daily f ON date_diff('day', DATE '2024-01-01', f.d) = c.day_idx GROUP BY 1""",
    ),
)
def t_chunks_with_lead(spark, sf_dir):
    chunks = resample.chunks_with_lead(resample.daily_calendar(spark, FIRST, LAST), 7)
    joined = table(spark, sf_dir, "inflow_daily").join(chunks.select("d", "chunk"), "d")
    return joined.groupBy("chunk").agg(
        F.count("*").alias("n_rows"), F.count_distinct("d").alias("n_days"), F.round(F.sum("qr"), 5).alias("volume")
    )


DENSE = """, dense AS (SELECT r.reach_id, h AS hour_idx, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(h AS INT)) AS ts, coalesce(i.qr, 0.001) AS qr
    FROM reach r CROSS JOIN range(720) t(h) LEFT JOIN inflow_hourly i ON i.reach_id = r.reach_id
      AND i.ts = TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(h AS INT)))
"""


def _hourly(spark, sf_dir):
    """The hours that have inflow, numbered, and the gaps around them: every reach has 720 hours, missing ones at the default."""
    gaps = resample.Gaps(flow(spark, sf_dir).select("reach_id"), datetime(2024, 1, 1), 720, val.MISSING_INFLOW)
    given = table(spark, sf_dir, "inflow_hourly")
    return given.withColumn("hour_idx", resample.hour_index(F.col("ts"), gaps.start)), gaps


@query(
    "r_hourly_to_daily",
    with_tables(
        "reach", "inflow_hourly", body=DENSE + "SELECT reach_id, CAST(ts AS DATE) AS d, round(avg(qr), 7) AS qr FROM dense GROUP BY 1, 2"
    ),
)
def r_hourly_to_daily(spark, sf_dir):
    given, gaps = _hourly(spark, sf_dir)
    daily = resample.hourly_to_daily(given, "reach_id", "ts", "qr", gaps=gaps)
    return daily.withColumn("qr", F.round("qr", 7))


@query(
    "r_daily_to_hourly",
    with_tables(
        "inflow_daily",
        body="""SELECT reach_id, CAST(d AS TIMESTAMP) + to_hours(CAST(h AS INT)) AS ts, round(qr, 8) AS qr
          FROM inflow_daily CROSS JOIN range(24) t(h)""",
    ),
)
def r_daily_to_hourly(spark, sf_dir):
    return resample.daily_to_hourly(table(spark, sf_dir, "inflow_daily"), "reach_id", "d", "qr").withColumn("qr", F.round("qr", 8))


@query(
    "r_downsample",
    with_tables(
        "reach",
        "inflow_hourly",
        body=DENSE + """, bins AS (SELECT CAST(b AS BIGINT) AS bin, CAST(floor(b * 720 / 7) AS BIGINT) AS lo, CAST(ceil((b + 1) * 720 / 7) AS BIGINT) AS hi FROM range(7) t(b))
          SELECT reach_id, bin, round(avg(qr), 7) AS qr FROM dense JOIN bins ON hour_idx >= lo AND hour_idx < hi GROUP BY 1, 2""",
    ),
)
def r_downsample(spark, sf_dir):
    given, gaps = _hourly(spark, sf_dir)
    out = resample.area_downsample(given, "reach_id", "hour_idx", "qr", 720, 7, gaps)
    return out.withColumn("qr", F.round("qr", 7))


@query(
    "r_runoff_tau",
    with_tables(
        "reach",
        "inflow_hourly",
        body=DENSE + """SELECT reach_id, CAST(floor((hour_idx - 16) / 24) AS BIGINT) AS day, round(avg(qr), 7) AS qr
          FROM dense WHERE hour_idx >= 16 AND hour_idx < 712 GROUP BY 1, 2""",
    ),
)
def r_runoff_tau(spark, sf_dir):
    given, gaps = _hourly(spark, sf_dir)
    out = resample.daily_runoff(given, "reach_id", "hour_idx", "qr", 720, 3, gaps=gaps)
    return out.withColumn("qr", F.round("qr", 7))


@query(
    "r_interp_linear",
    with_tables(
        "reach",
        "inflow_hourly",
        body=DENSE + """, s AS (SELECT reach_id, ts, hour_idx, qr, lead(qr) OVER (PARTITION BY reach_id ORDER BY hour_idx) AS nx FROM dense WHERE hour_idx % 3 = 0)
          SELECT reach_id, ts + to_hours(CAST(h AS INT)) AS ts, round((1 - h / 3.0) * qr + h / 3.0 * nx, 7) AS qr FROM s CROSS JOIN range(3) t(h) WHERE nx IS NOT NULL""",
    ),
)
def r_interp_linear(spark, sf_dir):
    """Three-hourly samples back to hourly values."""
    given, gaps = _hourly(spark, sf_dir)
    out = resample.interpolate(given, "reach_id", "ts", "qr", 3, gaps)
    return out.withColumn("qr", F.round("qr", 7))


@query(
    "r_substeps",
    with_tables(
        "inflow_daily",
        body=""", prev AS (SELECT a.reach_id, a.d, a.qr, b.qr AS before FROM inflow_daily a
            LEFT JOIN inflow_daily b ON b.reach_id = a.reach_id AND b.d = a.d - 1)
          SELECT reach_id, d, CAST(k AS INT) AS step, round(CASE WHEN before IS NULL THEN qr ELSE (1 - k / 4.0) * before + k / 4.0 * qr END, 8) AS inflow
          FROM prev CROSS JOIN range(1, 5) t(k)""",
    ),
)
def r_substeps(spark, sf_dir):
    now = table(spark, sf_dir, "inflow_daily")
    before = now.select("reach_id", F.date_add("d", 1).alias("d"), F.col("qr").alias("before"))
    out = resample.substeps(now.join(before, ["reach_id", "d"], "left"), "qr", "before", 4, linear=True)
    return out.select("reach_id", "d", "step", F.round("inflow", 8).alias("inflow"))


@query(
    "t_period",
    with_tables(
        "inflow_hourly",
        body="SELECT reach_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM inflow_hourly WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22' GROUP BY 1",
    ),
)
def t_period(spark, sf_dir):
    part = resample.in_period(table(spark, sf_dir, "inflow_hourly"), "ts", datetime(2024, 1, 8), datetime(2024, 1, 22))
    return part.groupBy("reach_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# ---------------------------------------------------------------- hydraulics

PHYSICAL = """, phys AS (SELECT reach_id, length_m, greatest(slope, 0.001) AS slope, x, top_width AS obs_width, side_slope AS obs_side,
    n_unit * (0.25 - 0.015) + 0.015 AS n, q_unit AS q, exp(p_unit * (ln(200.0) - ln(1.000001)) + ln(1.000001)) AS p,
    0.5 + 0.01 * (reach_id % 400) AS flow FROM reach)
, d0 AS (SELECT *, greatest(power(flow * n * ((q + 0.000001) + 1) / (p * sqrt(slope) + 0.00000001), 3.0 / (5.0 + 3.0 * (q + 0.000001))), 0.01) AS depth FROM phys)
, d1 AS (SELECT *, p * power(depth, q + 0.000001) AS top_width FROM d0)
, d2 AS (SELECT *, least(greatest(top_width * (q + 0.000001) / (2 * depth), 0.5), 50.0) AS side_slope FROM d1)
, d3 AS (SELECT *, greatest(top_width - 2 * side_slope * depth, 0.01) AS bottom_width FROM d2)
, d4 AS (SELECT *, (top_width + bottom_width) * depth / 2 AS cross_sectional_area, bottom_width + 2 * depth * sqrt(1 + side_slope * side_slope) AS wetted_perimeter FROM d3)
, d5 AS (SELECT *, cross_sectional_area / wetted_perimeter AS hydraulic_radius FROM d4)
, geo AS (SELECT *, 1 / n * power(hydraulic_radius, 2.0 / 3.0) * sqrt(slope) AS velocity FROM d5)
, cel AS (SELECT *, least(greatest(velocity, 0.01), 15.0) * 5.0 / 3.0 AS celerity FROM geo)
, mk AS (SELECT *, length_m / celerity AS k FROM cel)
"""
GEO_COLUMNS = ("depth", "top_width", "bottom_width", "side_slope", "cross_sectional_area", "wetted_perimeter", "hydraulic_radius", "velocity")


def _physical(spark, sf_dir):
    p = hyd.physical_parameters(F.col("n_unit"), F.col("q_unit"), F.col("p_unit"))
    return table(spark, sf_dir, "reach").select(
        "reach_id",
        "length_m",
        hyd.at_least(F.col("slope"), hyd.MINIMUMS["slope"]).alias("slope"),
        "x",
        F.col("top_width").alias("obs_width"),
        F.col("side_slope").alias("obs_side"),
        p["n"].alias("n"),
        p["q_spatial"].alias("q"),
        p["p_spatial"].alias("p"),
        (F.lit(0.5) + F.lit(0.01) * (F.col("reach_id") % 400)).alias("flow"),
    )


def _geometry():
    return hyd.trapezoid(F.col("n"), F.col("p"), F.col("q"), F.col("flow"), F.col("slope"))


@query("m_denorm", with_tables("reach", body=PHYSICAL + "SELECT reach_id, round(n, 8) AS n, round(q, 8) AS q, round(p, 6) AS p FROM phys"))
def m_denorm(spark, sf_dir):
    return _physical(spark, sf_dir).select("reach_id", F.round("n", 8).alias("n"), F.round("q", 8).alias("q"), F.round("p", 6).alias("p"))


@query(
    "m_trapezoid",
    with_tables("reach", body=PHYSICAL + "SELECT reach_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in GEO_COLUMNS) + " FROM geo"),
)
def m_trapezoid(spark, sf_dir):
    geo = _geometry()
    return _physical(spark, sf_dir).select("reach_id", *[F.round(geo[c], 6).alias(c) for c in GEO_COLUMNS])


@query(
    "m_observed_geometry",
    with_tables(
        "reach",
        body=PHYSICAL + "SELECT reach_id, round(coalesce(obs_width, top_width), 6) AS top_width, round(coalesce(obs_side, side_slope), 6) AS side_slope FROM geo",
    ),
)
def m_observed_geometry(spark, sf_dir):
    geo = _geometry()
    return _physical(spark, sf_dir).select(
        "reach_id",
        F.round(hyd.observed_or(F.col("obs_width"), geo["top_width"]), 6).alias("top_width"),
        F.round(hyd.observed_or(F.col("obs_side"), geo["side_slope"]), 6).alias("side_slope"),
    )


@query("m_celerity", with_tables("reach", body=PHYSICAL + "SELECT reach_id, round(celerity, 7) AS celerity FROM cel"))
def m_celerity(spark, sf_dir):
    return _physical(spark, sf_dir).select("reach_id", F.round(hyd.celerity(_geometry()["velocity"]), 7).alias("celerity"))


@query(
    "m_muskingum",
    with_tables(
        "reach",
        body=PHYSICAL + """SELECT reach_id, round((3600 - 2 * k * x) / (2 * k * (1 - x) + 3600), 7) AS c1, round((3600 + 2 * k * x) / (2 * k * (1 - x) + 3600), 7) AS c2,
          round((2 * k * (1 - x) - 3600) / (2 * k * (1 - x) + 3600), 7) AS c3, round(2 * 3600 / (2 * k * (1 - x) + 3600), 7) AS c4 FROM mk""",
    ),
)
def m_muskingum(spark, sf_dir):
    c = hyd.muskingum(F.col("length_m"), hyd.celerity(_geometry()["velocity"]), F.col("x"))
    return _physical(spark, sf_dir).select("reach_id", *[F.round(c[k], 7).alias(k) for k in ("c1", "c2", "c3", "c4")])


@query("m_log_base", "SELECT o_orderkey, round(ln(o_totalprice) / ln(1.5), 8) AS y FROM orders")
def m_log_base(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(hyd.log_base(F.col("o_totalprice"), 1.5), 8).alias("y"))


@query(
    "r_runoff_training",
    with_tables(
        "reach",
        "inflow_hourly",
        body=DENSE + """SELECT reach_id, CAST(floor((hour_idx - 13) / 24) AS BIGINT) AS day, round(avg(qr), 7) AS qr
          FROM dense WHERE hour_idx >= 13 AND hour_idx < 709 GROUP BY 1, 2""",
    ),
)
def r_runoff_training(spark, sf_dir):
    """The cut that training uses: it starts at hour 13 and ends 11 hours early, whatever the lag at the front."""
    given, gaps = _hourly(spark, sf_dir)
    out = resample.daily_runoff(given, "reach_id", "hour_idx", "qr", 720, 0, start_offset=13, gaps=gaps)
    return out.withColumn("qr", F.round("qr", 7))
