"""Hydrologic scores per gauge from a long table ``gauge, pred, target``.

Moment-based scores need one hash aggregation. Scores that depend on sorted series use
distributed ranks, so one gauge with a very long series is spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.values import null_if_nan
from rillflow.operators.ranking import quantiles, row_numbers
from rillflow.scratch import by_key

MOMENT_SCORES = ("bias", "mae", "rmse", "ub_rmse", "corr", "nse", "r2", "pbias", "kge", "kge_12")
SPLIT_SCORES = ("flv", "fhv", "pbias_mid", "rmse_low", "rmse_high", "rmse_mid")
ALL_SCORES = (*MOMENT_SCORES, *SPLIT_SCORES, "fdc_rmse", "corr_spearman")
FDC_POINTS = 100


def check_predictions(df: DataFrame, pred: str = "pred") -> DataFrame:
    """Pass rows on, failing the job at the first missing prediction."""
    bad = F.col(pred).isNull() | F.isnan(pred)
    return df.withColumn(
        pred, F.when(bad, F.raise_error(F.lit("predictions contain NaN"))).otherwise(F.col(pred).cast("double"))
    )


def _series(df: DataFrame, gauge: str) -> DataFrame:
    return df.select(
        F.col(gauge).alias("_g"), null_if_nan(F.col("pred")).alias("p"), null_if_nan(F.col("target")).alias("t")
    )


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r, NULL when either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _pbias(gap: Column, target: Column) -> Column:
    return F.try_divide(F.sum(gap), F.sum(target)) * 100.0


def moment_scores(df: DataFrame, gauge: str = "gauge") -> DataFrame:
    """Scores that follow from sums and central moments: one pass, partial sums before the shuffle.

    Anomaly errors use that the mean of (d - c)^2 is var(d) + (mean(d) - c)^2, with d the
    paired difference and c the difference of the two series' own means.
    """
    s = _series(df, gauge)
    paired = F.col("p").isNotNull() & F.col("t").isNotNull()
    p = F.when(paired, F.col("p"))
    t = F.when(paired, F.col("t"))
    d = F.col("p") - F.col("t")
    sums = s.groupBy("_g").agg(
        F.avg(d).alias("bias"),
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.var_pop(d).alias("_vd"),
        F.avg("p").alias("_mp"),
        F.avg("t").alias("_mt"),
        F.count(d).alias("n"),
        F.avg(p).alias("_pp"),
        F.avg(t).alias("_tt"),
        F.stddev_pop(p).alias("_sp"),
        F.stddev_pop(t).alias("_st"),
        correlation(p, t).alias("_r"),
        (F.var_pop(t) * F.count(t)).alias("_sst"),
        F.sum(d * d).alias("_sse"),
        _pbias(d, t).alias("pbias"),
    )
    several = F.col("n") > 1
    skill = F.when(several, F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst")))
    r = F.when(several, F.col("_r"))
    spread = F.try_divide(F.col("_sp"), F.col("_st"))
    spread_cv = F.try_divide(F.col("_sp") * F.col("_tt"), F.col("_st") * F.col("_pp"))
    level = F.try_divide(F.col("_pp"), F.col("_tt"))

    def efficiency(variability: Column) -> Column:
        return F.lit(1.0) - F.sqrt(F.pow(r - 1, F.lit(2.0)) + F.pow(variability - 1, F.lit(2.0)) + F.pow(level - 1, F.lit(2.0)))

    offset = F.col("bias") - (F.col("_mp") - F.col("_mt"))
    return sums.select(
        F.col("_g").alias(gauge),
        "n",
        "bias",
        "mae",
        "rmse",
        F.sqrt(F.col("_vd") + offset * offset).alias("ub_rmse"),
        r.alias("corr"),
        skill.alias("nse"),
        skill.alias("r2"),
        "pbias",
        efficiency(spread).alias("kge"),
        efficiency(spread_cv).alias("kge_12"),
    )


def _pairs_with_id(df: DataFrame, gauge: str, order: str) -> DataFrame:
    s = df.select(
        F.col(gauge).alias("_g"),
        F.col(order).alias("_o"),
        null_if_nan(F.col("pred")).alias("p"),
        null_if_nan(F.col("target")).alias("t"),
    )
    return s.filter(F.col("p").isNotNull() & F.col("t").isNotNull())


def paired_ranks(df: DataFrame, gauge: str = "gauge", order: str = "step") -> dict[str, DataFrame]:
    """Positions of predictions and of targets among the usable pairs of each gauge."""
    pairs = _pairs_with_id(df, gauge, order)
    return {
        c: row_numbers(pairs.select("_g", "_o", F.col(c).alias("_v")), [F.col("_v"), F.col("_o")], ["_g"], "_pos")
        for c in ("p", "t")
    }


def split_scores(df: DataFrame, gauge: str = "gauge", order: str = "step", ranks: dict[str, DataFrame] | None = None) -> DataFrame:
    """Low, middle and high flow errors on independently sorted series.

    Low is the first round(0.3 n), high starts at round(0.98 n), halves rounding to even.
    """
    ranks = ranks or paired_ranks(df, gauge, order)
    sides = [
        ranks[c].select("_g", "_pos", F.col("_pos_total").alias("_n"), F.col("_v").alias(c)) for c in ("p", "t")
    ]
    ranked = sides[0].join(by_key(sides[1].drop("_n")), ["_g", "_pos"])
    low_end = F.bround(F.col("_n") * F.lit(0.3))
    high_start = F.bround(F.col("_n") * F.lit(0.98))
    idx = F.col("_pos") - 1
    is_low, is_high = idx < low_end, idx >= high_start
    parts = {"low": is_low, "high": is_high, "mid": ~is_low & ~is_high}
    d = F.col("p") - F.col("t")
    names = {"low": "flv", "high": "fhv", "mid": "pbias_mid"}
    aggs = []
    for part, cond in parts.items():
        aggs.append(_pbias(F.when(cond, d), F.when(cond, F.col("t"))).alias(names[part]))
        aggs.append(F.sqrt(F.avg(F.when(cond, d * d))).alias(f"rmse_{part}"))
    return ranked.groupBy(F.col("_g").alias(gauge)).agg(*aggs)


def duration_points(df: DataFrame, gauge: str, value: str, order: str, points: int = FDC_POINTS) -> DataFrame:
    """Flow-duration curve: value at position floor(i/points*n) of the descending series."""
    s = df.select(F.col(gauge).alias("_g"), F.col(order).alias("_o"), null_if_nan(F.col(value)).alias("_v"))
    ranked = row_numbers(s.filter(F.col("_v").isNotNull()), [F.col("_v").desc(), F.col("_o")], ["_g"], "_pos")
    sizes = s.groupBy("_g").agg(F.count("_v").alias("_n"))
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    wanted = sizes.select("_g", "_n", i).withColumn(
        "_pos", F.floor(F.col("i") / F.lit(float(points)) * F.col("_n")) + 1
    )
    picked = wanted.join(by_key(ranked.select("_g", "_pos", "_v")), ["_g", "_pos"], "left")
    # a series without any value counts as zero flow
    return picked.select(
        F.col("_g").alias(gauge), "i", F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(F.col("_v")).alias(value)
    )


def duration_score(df: DataFrame, gauge: str = "gauge", order: str = "step") -> DataFrame:
    p = duration_points(df, gauge, "pred", order)
    t = duration_points(df, gauge, "target", order)
    d = F.col("pred") - F.col("target")
    return p.join(by_key(t), [gauge, "i"]).groupBy(gauge).agg(F.sqrt(F.avg(d * d)).alias("fdc_rmse"))


def rank_correlation(df: DataFrame, gauge: str = "gauge", order: str = "step", ranks: dict[str, DataFrame] | None = None) -> DataFrame:
    """Spearman's r; tied values share the mean of their positions."""
    ranks = ranks or paired_ranks(df, gauge, order)
    sides = []
    for c in ("p", "t"):
        ties = ranks[c].groupBy("_g", "_v").agg(F.avg("_pos").alias(f"_r{c}"))
        sides.append(ranks[c].join(by_key(ties), ["_g", "_v"]).select("_g", "_o", f"_r{c}"))
    return sides[0].join(by_key(sides[1]), ["_g", "_o"]).groupBy(F.col("_g").alias(gauge)).agg(
        F.when(F.count("*") > 1, correlation(F.col("_rp"), F.col("_rt"))).alias("corr_spearman")
    )


def all_scores(df: DataFrame, gauge: str = "gauge", order: str = "step") -> DataFrame:
    """All 18 scores; gauges without a usable pair keep a row of NULLs."""
    checked = check_predictions(df)
    ranks = paired_ranks(checked, gauge, order)
    parts = [
        split_scores(checked, gauge, order, ranks),
        duration_score(checked, gauge, order),
        rank_correlation(checked, gauge, order, ranks),
    ]
    joined = reduce(lambda left, right: left.join(by_key(right), gauge, "left"), parts, moment_scores(checked, gauge))
    return joined.select(gauge, "n", *ALL_SCORES)


SUMMARY_SCORES = ("bias", "flv", "fhv", "kge", "nse")


def summarize(scores: DataFrame, names: tuple[str, ...] = SUMMARY_SCORES) -> DataFrame:
    """Median, mean, quartiles and number of valid gauges per score."""
    long = scores.select(*[null_if_nan(F.col(n)).alias(n) for n in names]).unpivot([], list(names), "metric", "v")
    counts = long.groupBy("metric").agg(F.avg("v").alias("mean"), F.count("v").alias("valid"))
    ends = quantiles(long, "v", {"median": 0.5, "q25": 0.25, "q75": 0.75}, ["metric"])
    return counts.join(ends, "metric", "left").select("metric", "median", "mean", "q25", "q75", "valid")


def mass_balance(df: DataFrame, gauge: str, pred: str, base: str) -> DataFrame:
    """Relative mass error per gauge; 1 where the baseline carries no mass."""
    sums = df.groupBy(gauge).agg(F.sum(pred).alias("_p"), F.sum(base).alias("_b"))
    error = F.when(F.col("_b") == 0, F.lit(1.0)).otherwise(F.abs(F.col("_p") - F.col("_b")) / F.col("_b"))
    return sums.select(gauge, error.alias("mass_error"))
