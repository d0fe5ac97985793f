"""Scores against direct numpy formulas and the known special cases."""

import math

import numpy as np
import pytest
from rillflow.operators import metrics as met

NAN = float("nan")


def scores(spark, series):
    rows = [(g, i, float(p), float(t)) for g, (ps, ts) in series.items() for i, (p, t) in enumerate(zip(ps, ts, strict=True))]
    df = spark.createDataFrame(rows, "gauge string, step int, pred double, target double")
    return {r.gauge: r for r in met.all_scores(df).collect()}


def ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def direct(p, t):
    ok = ~np.isnan(t)
    d = (p - t)[ok]
    pa, ta = p - p.mean(), t - np.nanmean(t)
    pp, tt = p[ok], t[ok]
    r = np.corrcoef(pp, tt)[0, 1]
    n = len(pp)
    lo, hi = round(0.3 * n), round(0.98 * n)
    ps, ts = np.sort(pp), np.sort(tt)

    def pb(a, b):
        return (a - b).sum() / b.sum() * 100 if len(b) else NAN

    def rm(a, b):
        return math.sqrt(((a - b) ** 2).mean()) if len(b) else NAN

    def curve(v):
        v = np.sort(v[~np.isnan(v)])[::-1]
        return v[(np.arange(100) / 100 * len(v)).astype(int)]

    return {
        "bias": d.mean(), "mae": np.abs(d).mean(), "rmse": math.sqrt((d * d).mean()),
        "ub_rmse": math.sqrt(np.nanmean((pa - ta) ** 2)), "fdc_rmse": rm(curve(p), curve(t)),
        "corr": r, "corr_spearman": np.corrcoef(ranks(pp), ranks(tt))[0, 1],
        "nse": 1 - (d * d).sum() / ((tt - tt.mean()) ** 2).sum(), "pbias": pb(pp, tt),
        "kge": 1 - math.sqrt((r - 1) ** 2 + (pp.std() / tt.std() - 1) ** 2 + (pp.mean() / tt.mean() - 1) ** 2),
        "kge_12": 1 - math.sqrt((r - 1) ** 2 + (pp.std() * tt.mean() / (tt.std() * pp.mean()) - 1) ** 2 + (pp.mean() / tt.mean() - 1) ** 2),
        "flv": pb(ps[:lo], ts[:lo]), "fhv": pb(ps[hi:], ts[hi:]), "pbias_mid": pb(ps[lo:hi], ts[lo:hi]),
        "rmse_low": rm(ps[:lo], ts[:lo]), "rmse_high": rm(ps[hi:], ts[hi:]), "rmse_mid": rm(ps[lo:hi], ts[lo:hi]),
    }


def test_all_scores_equal_numpy(spark):
    rng = np.random.default_rng(0)
    series = {}
    for k, n in enumerate((120, 37, 25, 5)):
        t = np.round(rng.gamma(2, 5, n), 1)
        p = np.round(t * rng.uniform(0.5, 1.5, n) + 0.1, 1)
        t[rng.random(n) < 0.15] = NAN
        series[f"g{k}"] = (p, t)
    got = scores(spark, series)
    for g, (p, t) in series.items():
        for name, want in direct(p, t).items():
            have = got[g][name]
            if math.isnan(want):
                assert have is None
            else:
                assert have == pytest.approx(want, rel=1e-9, abs=1e-9), (g, name)


def test_special_cases(spark):
    x = np.array([1.0, 2, 3, 4, 5])
    got = scores(
        spark,
        {
            "same": (x, x), "mean": (np.full(5, 3.0), x), "off": (np.array([1.0, 2, 3]), np.array([4.0, 5, 6])),
            "over": (np.array([120.0, 120]), np.array([100.0, 100])), "double": (2 * x, x), "empty": (x, np.full(5, NAN)), "one": ([2.0], [1.0]),
        },
    )
    assert got["same"].nse == pytest.approx(1) and got["same"].kge == pytest.approx(1) and got["same"].rmse == 0 and got["same"].corr == pytest.approx(1)
    assert got["mean"].nse == pytest.approx(0) and got["mean"].corr is None
    assert (got["off"].rmse, got["off"].mae) == (3, 3)
    assert got["over"].pbias == pytest.approx(20)
    assert got["double"].kge == pytest.approx(1 - math.sqrt(2))
    assert all(got["empty"][c] is None for c in ("bias", "nse", "kge", "corr_spearman", "flv"))
    assert got["empty"].fdc_rmse == pytest.approx(math.sqrt(sum((np.sort(x)[::-1][int(i / 100 * 5)]) ** 2 for i in range(100)) / 100))
    assert got["one"].nse is None and got["one"].pbias == pytest.approx(100)


def test_missing_prediction_is_an_error(spark):
    with pytest.raises(Exception, match="NaN"):
        scores(spark, {"g": ([1.0, NAN], [1.0, 2.0])})


def test_summary_and_mass(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", NAN), ("d", None)], "g string, nse double")
    row = met.summarize(df, ("nse",)).head()
    assert (row.median, row.mean, row.q25, row.q75, row.valid) == (2.0, 2.0, 1.5, 2.5, 2)
    m = spark.createDataFrame([("a", 11.0, 10.0), ("b", 4.0, 0.0)], "g string, p double, b double")
    got = {r.g: r.mass_error for r in met.mass_balance(m, "g", "p", "b").collect()}
    assert got == {"a": pytest.approx(0.1), "b": 1.0}
