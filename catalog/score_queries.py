"""Score and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import ORACLES, query
from catalog.stand_in import network, table, with_tables
from catalog.value_queries import PHYSICAL
from rillflow.functions import values as val
from rillflow.operators import metrics as met
from rillflow.operators import summaries

PAIR = """, pair AS (SELECT gauge, step, pred AS p, target AS t FROM series WHERE target IS NOT NULL)
"""


def _series(spark, sf_dir):
    return table(spark, sf_dir, "series")


def _round(df, keep, digits=6):
    return df.select(*keep, *[(F.round(c, digits) + 0.0).alias(c) for c in df.columns if c not in keep])


@query(
    "e_basic",
    with_tables(
        "series",
        body="""SELECT gauge, round(avg(pred - target), 6) + 0.0 AS bias, round(avg(abs(pred - target)), 6) AS mae,
          round(sqrt(avg((pred - target) * (pred - target))), 6) AS rmse FROM series GROUP BY gauge""",
    ),
)
def e_basic(spark, sf_dir):
    return _round(met.moment_scores(_series(spark, sf_dir)).select("gauge", "bias", "mae", "rmse"), ["gauge"])


@query(
    "e_ub_rmse",
    with_tables(
        "series",
        body=""", m AS (SELECT gauge, avg(pred) AS mp, avg(target) AS mt FROM series GROUP BY gauge)
          SELECT gauge, round(sqrt(avg(((pred - mp) - (target - mt)) * ((pred - mp) - (target - mt)))), 6) AS ub_rmse FROM series JOIN m USING (gauge) GROUP BY gauge""",
    ),
)
def e_ub_rmse(spark, sf_dir):
    return _round(met.moment_scores(_series(spark, sf_dir)).select("gauge", "ub_rmse"), ["gauge"])


@query(
    "e_nse_kge",
    with_tables(
        "series",
        body=PAIR + """, m AS (SELECT gauge, avg(p) AS mp, avg(t) AS mt, stddev_pop(p) AS sp, stddev_pop(t) AS st, corr(p, t) AS r FROM pair GROUP BY gauge)
        , e AS (SELECT gauge, 1 - sum((t - p) * (t - p)) / sum((t - mt) * (t - mt)) AS nse, sum(p - t) / sum(t) * 100 AS pbias FROM pair JOIN m USING (gauge) GROUP BY gauge)
        SELECT gauge, round(nse, 6) AS nse, round(nse, 6) AS r2, round(pbias, 6) AS pbias, round(r, 6) + 0.0 AS corr,
          round(1 - sqrt((r - 1) * (r - 1) + power(sp / st - 1, 2) + power(mp / mt - 1, 2)), 6) AS kge,
          round(1 - sqrt((r - 1) * (r - 1) + power(sp * mt / (st * mp) - 1, 2) + power(mp / mt - 1, 2)), 6) AS kge_12 FROM m JOIN e USING (gauge)""",
    ),
)
def e_nse_kge(spark, sf_dir):
    s = met.moment_scores(_series(spark, sf_dir))
    return _round(s.select("gauge", "nse", "r2", "pbias", "corr", "kge", "kge_12"), ["gauge"])


@query(
    "e_spearman",
    with_tables(
        "series",
        body=PAIR + """, r AS (SELECT gauge, rank() OVER (PARTITION BY gauge ORDER BY p) + (count(*) OVER (PARTITION BY gauge, p) - 1) / 2e0 AS rp,
            rank() OVER (PARTITION BY gauge ORDER BY t) + (count(*) OVER (PARTITION BY gauge, t) - 1) / 2e0 AS rt FROM pair)
          SELECT gauge, round(corr(rp, rt), 6) + 0.0 AS corr_spearman FROM r GROUP BY gauge""",
    ),
)
def e_spearman(spark, sf_dir):
    return _round(met.rank_correlation(_series(spark, sf_dir)), ["gauge"])


@query(
    "e_fdc",
    with_tables(
        "series",
        body=""", rp AS (SELECT gauge, pred AS v, row_number() OVER (PARTITION BY gauge ORDER BY pred DESC) - 1 AS pos, count(*) OVER (PARTITION BY gauge) AS n FROM series)
        , rt AS (SELECT gauge, target AS v, row_number() OVER (PARTITION BY gauge ORDER BY target DESC) - 1 AS pos, count(*) OVER (PARTITION BY gauge) AS n FROM series WHERE target IS NOT NULL)
        , fp AS (SELECT gauge, i, v FROM rp JOIN range(100) t(i) ON pos = floor(i / 100e0 * n))
        , ft AS (SELECT gauge, i, v FROM rt JOIN range(100) t(i) ON pos = floor(i / 100e0 * n))
        SELECT gauge, round(sqrt(avg((fp.v - ft.v) * (fp.v - ft.v))), 6) AS fdc_rmse FROM fp JOIN ft USING (gauge, i) GROUP BY gauge""",
    ),
)
def e_fdc(spark, sf_dir):
    return _round(met.duration_score(_series(spark, sf_dir)), ["gauge"])


@query(
    "e_splits",
    with_tables(
        "series",
        body=PAIR + """, a AS (SELECT gauge, p, row_number() OVER (PARTITION BY gauge ORDER BY p) AS rn, count(*) OVER (PARTITION BY gauge) AS n FROM pair)
        , b AS (SELECT gauge, t, row_number() OVER (PARTITION BY gauge ORDER BY t) AS rn FROM pair)
        , j AS (SELECT gauge, p, t, rn - 1 AS i, round_even(n * 0.3e0, 0) AS lo, round_even(n * 0.98e0, 0) AS hi FROM a JOIN b USING (gauge, rn))
        , k AS (SELECT gauge, p, t, CASE WHEN i < lo THEN 'low' WHEN i >= hi THEN 'high' ELSE 'mid' END AS part FROM j)
        SELECT gauge, """
        + ", ".join(
            f"round(sum(p - t) FILTER (part = '{part}') / sum(t) FILTER (part = '{part}') * 100, 6) + 0.0 AS {bias}, "
            f"round(sqrt(avg((p - t) * (p - t)) FILTER (part = '{part}')), 6) AS rmse_{part}"
            for part, bias in (("low", "flv"), ("high", "fhv"), ("mid", "pbias_mid"))
        )
        + " FROM k GROUP BY gauge",
    ),
)
def e_splits(spark, sf_dir):
    return _round(met.split_scores(_series(spark, sf_dir)), ["gauge"])


SCORES = PAIR + """, m AS (SELECT gauge, avg(p) AS mp, avg(t) AS mt, stddev_pop(p) AS sp, stddev_pop(t) AS st, corr(p, t) AS r, avg(p - t) AS bias FROM pair GROUP BY gauge)
, scores AS (SELECT gauge, m.bias, 1 - sum((t - p) * (t - p)) / sum((t - mt) * (t - mt)) AS nse,
    1 - sqrt((any_value(r) - 1) * (any_value(r) - 1) + power(any_value(sp / st) - 1, 2) + power(any_value(mp / mt) - 1, 2)) AS kge
  FROM pair JOIN m USING (gauge) GROUP BY gauge, m.bias)
"""


@query(
    "e_all_scores",
    "SELECT gauge, " + ", ".join(sorted(met.ALL_SCORES)) + " FROM "
    + " JOIN ".join(f"({ORACLES[n]}) AS {n} USING (gauge)" for n in ("e_basic", "e_ub_rmse", "e_nse_kge", "e_spearman", "e_fdc", "e_splits")).replace(" USING (gauge)", "", 1),
)
def e_all_scores(spark, sf_dir):
    """All 18 scores in one table."""
    return _round(met.all_scores(_series(spark, sf_dir)).drop("n"), ["gauge"])


SUMMARY_SQL = "WITH scores AS (" + ORACLES["e_all_scores"] + ") "


@query(
    "e_summary",
    SUMMARY_SQL + " UNION ALL ".join(
        f"""SELECT '{n}' AS metric, round(quantile_cont({n}, 0.5), 4) AS median, round(avg({n}), 4) AS mean,
          round(quantile_cont({n}, 0.25), 4) AS q25, round(quantile_cont({n}, 0.75), 4) AS q75, count({n}) AS valid FROM scores"""
        for n in met.SUMMARY_SCORES
    ),
)
def e_summary(spark, sf_dir):
    """Every score of the summary over all gauges."""
    return _round(met.summarize(_round(met.all_scores(_series(spark, sf_dir)), ["gauge"])), ["metric", "valid"], 4)


@query(
    "e_score_log",
    SUMMARY_SQL + "SELECT " + ", ".join(f"round(avg({n}), 4) AS mean_{n}, round(quantile_cont({n}, 0.5), 4) AS median_{n}" for n in ("nse", "rmse", "kge")) + " FROM scores",
)
def e_score_log(spark, sf_dir):
    return _round(summaries.score_log(_round(met.all_scores(_series(spark, sf_dir)), ["gauge"])), [], 4)


@query(
    "e_cdf",
    with_tables(
        "series",
        body="""SELECT step, target, round(coalesce((row_number() OVER (ORDER BY target, step) - 1) / nullif(count(*) OVER () - 1, 0), 0.0), 9) AS cdf
          FROM series WHERE target IS NOT NULL""",
    ),
)
def e_cdf(spark, sf_dir):
    out = summaries.cumulative_distribution(_series(spark, sf_dir), "target", "step")
    return out.withColumn("cdf", F.round("cdf", 9))


@query(
    "e_box",
    with_tables(
        "series",
        body="SELECT gauge, " + ", ".join(
            f"round(quantile_cont(least(greatest(target / 100e0 - 2e0, -1e0), 1e0), {q}), 7) + 0.0 AS {n}"
            for q, n in ((0.05, "p05"), (0.25, "q25"), (0.5, "median"), (0.75, "q75"), (0.95, "p95"))
        ) + ", count(target) AS n FROM series WHERE target IS NOT NULL GROUP BY gauge",
    ),
)
def e_box(spark, sf_dir):
    s = _series(spark, sf_dir).select("gauge", (F.col("target") / 100.0 - 2.0).alias("score"))
    return _round(summaries.box_statistics(s, "score", ["gauge"], (-1.0, 1.0)), ["gauge", "n"], 7)


@query(
    "e_bins",
    with_tables(
        "gauge",
        body="SELECT area_class, count(v) AS n, "
        + ", ".join(f"round(quantile_cont(v, {p}), 6) AS {n}" for n, p in summaries.BOX.items())
        + " FROM (SELECT v, CASE "
        + " ".join(f"WHEN v > {lo} AND v <= {hi} THEN '{lo}-{hi}'" for lo, hi in ((0, 1000), (1000, 5000), (5000, 10000), (10000, 30000), (30000, 50000)))
        + " END AS area_class FROM (SELECT drain_sqkm * (1 + CAST(staid AS BIGINT) % 7) AS v FROM gauge)) WHERE area_class IS NOT NULL GROUP BY 1",
    ),
)
def e_bins(spark, sf_dir):
    """All five classes: the areas of the stand-in gauges are spread by a factor of one to seven."""
    area = F.col("drain_sqkm") * (F.lit(1) + F.col("staid").cast("long") % 7)
    g = table(spark, sf_dir, "gauge").withColumn("drain_sqkm", area)
    g = g.withColumn("area_class", summaries.area_class(F.col("drain_sqkm"))).filter("area_class IS NOT NULL")
    return _round(summaries.box_statistics(g, "drain_sqkm", ["area_class"]), ["area_class", "n"], 6)


@query(
    "e_score_change",
    with_tables(
        "series",
        body=SCORES + "SELECT gauge, round(least(greatest(kge - nse, -1.0), 1.0), 5) + 0.0 AS delta FROM scores",
    ),
)
def e_score_change(spark, sf_dir):
    s = met.moment_scores(_series(spark, sf_dir))
    left = s.select("gauge", F.col("kge").alias("score"))
    right = s.select("gauge", F.col("nse").alias("score"))
    return _round(summaries.score_change(left, right, "gauge", "score"), ["gauge"], 5)


@query(
    "e_histogram",
    with_tables(
        "gauge",
        body="""SELECT CAST(least(floor((log10(v) + 1) / (4e0 / 50)), 49) AS BIGINT) AS bin, count(*) AS n
          FROM (SELECT l_extendedprice / 97.3e0 AS v FROM lineitem) WHERE v >= 0.1 AND v <= 1000 GROUP BY 1""",
    ),
)
def e_histogram(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 97.3).alias("v"))
    return summaries.log_histogram(v, "v")


@query(
    "e_mass_balance",
    with_tables(
        "series",
        body="SELECT gauge, round(CASE WHEN sum(t) = 0 THEN 1.0 ELSE abs(sum(p) - sum(t)) / sum(t) END, 8) AS mass_error FROM (SELECT gauge, pred AS p, coalesce(target, 0.0) AS t FROM series) GROUP BY gauge",
    ),
)
def e_mass_balance(spark, sf_dir):
    s = _series(spark, sf_dir).select("gauge", "pred", F.coalesce("target", F.lit(0.0)).alias("base"))
    return _round(met.mass_balance(s, "gauge", "pred", "base"), ["gauge"], 8)


@query(
    "e_value_summary",
    with_tables(
        "reach",
        body=PHYSICAL + " UNION ALL ".join(
            f"SELECT '{c}' AS name, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.5), 6) AS median, round(max({c}), 6) AS max FROM phys"
            for c in ("n", "q", "p")
        ),
    ),
)
def e_value_summary(spark, sf_dir):
    from catalog.value_queries import _physical

    return _round(summaries.value_summary(_physical(spark, sf_dir), ["n", "q", "p"]), ["name"], 6)


@query(
    "e_wettest",
    with_tables(
        "inflow_daily",
        body="""SELECT arg_max(reach_id, (m, -reach_id)) AS reach_id, round(max(m), 6) AS mean_q FROM (
          SELECT reach_id, avg(qr) AS m FROM inflow_daily GROUP BY reach_id)""",
    ),
)
def e_wettest(spark, sf_dir):
    out = summaries.wettest(table(spark, sf_dir, "inflow_daily"), "reach_id", "qr")
    return out.withColumn("mean_q", F.round("mean_q", 6))


@query(
    "e_series_mass",
    with_tables("series", body="SELECT gauge, round(sum(pred), 4) AS mass FROM series GROUP BY gauge"),
)
def e_series_mass(spark, sf_dir):
    return _round(summaries.series_mass(_series(spark, sf_dir), "gauge", "pred"), ["gauge"], 4)


@query(
    "j_common_days",
    with_tables(
        "observed",
        "inflow_daily",
        body="SELECT o.staid, o.d, round(o.streamflow, 10) AS streamflow, round(i.qr, 8) AS qr FROM observed o JOIN inflow_daily i ON i.reach_id = CAST(o.staid AS BIGINT) AND i.d = o.d",
    ),
)
def j_common_days(spark, sf_dir):
    """Inner alignment of two result sets on (gauge, day)."""
    from rillflow.functions.ids import zero_filled

    left = table(spark, sf_dir, "observed")
    right = table(spark, sf_dir, "inflow_daily").select(zero_filled(F.col("reach_id")).alias("staid"), "d", "qr")
    return left.join(right, ["staid", "d"]).select("staid", "d", F.round("streamflow", 10).alias("streamflow"), F.round("qr", 8).alias("qr"))


GEO_DAILY = """, days AS (SELECT CAST(DATE '2024-01-01' + CAST(i AS INT) AS DATE) AS d FROM range(30) t(i))
, walk AS (SELECT reach_id, reach_id AS below_id FROM reach UNION ALL
  SELECT w.reach_id, r.down_id FROM walk w JOIN reach r ON r.reach_id = w.below_id WHERE r.down_id IS NOT NULL)
, filled AS (SELECT r.reach_id, days.d, greatest(coalesce(i.qr, 0.001e0), 0.0001e0) AS q FROM reach r CROSS JOIN days LEFT JOIN inflow_daily i ON i.reach_id = r.reach_id AND i.d = days.d)
, daily AS (SELECT w.below_id AS reach_id, f.d, sum(f.q) AS q FROM walk w JOIN filled f ON f.reach_id = w.reach_id GROUP BY 1, 2)
, phys AS (SELECT r.reach_id, d, greatest(slope, 0.001) AS slope, n_unit * (0.25 - 0.015) + 0.015 AS n, q_unit + 0.000001 AS qe,
    exp(p_unit * (ln(200.0) - ln(1.000001)) + ln(1.000001)) AS p, daily.q AS discharge FROM reach r JOIN daily ON daily.reach_id = r.reach_id)
, d0 AS (SELECT *, greatest(power(discharge * n * (qe + 1) / (p * sqrt(slope) + 0.00000001), 3.0 / (5.0 + 3.0 * qe)), 0.01) AS depth FROM phys)
, d1 AS (SELECT *, p * power(depth, qe) AS top_width FROM d0)
, d2 AS (SELECT *, least(greatest(top_width * qe / (2 * depth), 0.5), 50.0) AS side_slope FROM d1)
, d3 AS (SELECT *, greatest(top_width - 2 * side_slope * depth, 0.01) AS bottom_width FROM d2)
, geo AS (SELECT *, ((top_width + bottom_width) * depth / 2) / (bottom_width + 2 * depth * sqrt(1 + side_slope * side_slope)) AS hydraulic_radius FROM d3)
"""


@query(
    "geo_stats",
    with_tables(
        "reach",
        "inflow_daily",
        recursive=True,
        body=GEO_DAILY + "SELECT reach_id, " + ", ".join(
            f"round(min({g}), 5) AS {g}_min, round(max({g}), 5) AS {g}_max, round(quantile_cont({g}, 0.5), 5) AS {g}_median, round(avg({g}), 5) AS {g}_mean"
            for g in summaries.GEOMETRY
        ) + " FROM geo GROUP BY reach_id",
    ),
)
def geo_stats(spark, sf_dir):
    from datetime import date

    from catalog.value_queries import _physical
    from rillflow.operators.resample import daily_calendar
    from rillflow.plans.accumulation import daily_discharge

    days = daily_calendar(spark, date(2024, 1, 1), date(2024, 1, 30))
    daily = daily_discharge(table(spark, sf_dir, "inflow_daily"), network(spark, sf_dir)["pieces"], days)
    params = _physical(spark, sf_dir).select("reach_id", "n", F.col("p").alias("p_spatial"), F.col("q").alias("q_spatial"), "slope")
    return _round(summaries.geometry_statistics(daily, params), ["reach_id"], 5)


@query("f_finite", with_tables("series", body="SELECT gauge, count(target) AS n FROM series WHERE target IS NOT NULL GROUP BY gauge"))
def f_finite(spark, sf_dir):
    s = _series(spark, sf_dir).filter(val.is_finite(F.col("target")))
    return s.groupBy("gauge").agg(F.count("target").alias("n"))


@query(
    "e_histogram_statistics",
    with_tables(
        "gauge",
        body="""SELECT l_returnflag AS name, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_pop(v), 6) AS std, count(v) AS n
          FROM (SELECT l_returnflag, l_extendedprice / 97.3e0 AS v FROM lineitem) GROUP BY 1""",
    ),
)
def e_histogram_statistics(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("name"), (F.col("l_extendedprice") / 97.3).alias("v"))
    return _round(summaries.histogram_statistics(v, "v", ["name"]), ["name", "n"], 6)


@query(
    "e_located_scores",
    with_tables(
        "series",
        "gauge",
        body="""SELECT lpad(CAST(s.gauge AS VARCHAR), 8, '0') AS staid, count(target) AS n, round(avg(pred - target), 4) + 0.0 AS bias, any_value(g.name) AS name,
          any_value(g.reach_id) AS reach_id FROM series s JOIN gauge g ON g.staid = lpad(CAST(s.gauge AS VARCHAR), 8, '0') WHERE target IS NOT NULL GROUP BY 1""",
    ),
)
def e_located_scores(spark, sf_dir):
    """Scores next to where their gauges are."""
    from rillflow.plans.comparison import located

    scores = met.moment_scores(_series(spark, sf_dir), "gauge").select(F.lpad(F.col("gauge").cast("string"), 8, "0").alias("staid"), "n", (F.round("bias", 4) + 0.0).alias("bias"))
    return located(scores, table(spark, sf_dir, "gauge"), ("name", "reach_id"))


@query(
    "t_midnight",
    with_tables("inflow_hourly", body="SELECT reach_id, date_trunc('day', ts)::TIMESTAMP AS ts, count(*) AS n FROM inflow_hourly GROUP BY 1, 2"),
)
def t_midnight(spark, sf_dir):
    from rillflow.operators.resample import at_midnight

    return at_midnight(table(spark, sf_dir, "inflow_hourly"), "ts").groupBy("reach_id", "ts").agg(F.count("*").alias("n"))
