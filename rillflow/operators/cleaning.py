"""Attribute joins, imputation, statistics and adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.values import finite_or_null, null_if_nan, zscore
from rillflow.operators.ranking import quantiles
from rillflow.scratch import by_key, store


def join_attributes(reaches: DataFrame, attributes: DataFrame, names: list[str]) -> DataFrame:
    """Attributes of each reach, NULL where there are none; fails when nothing matches."""
    require_match(reaches, attributes)
    values = attributes.select("reach_id", *[null_if_nan(F.col(n)).alias(n) for n in names])
    return reaches.join(by_key(values), "reach_id", "left")


def require_match(reaches: DataFrame, attributes: DataFrame) -> None:
    if reaches.join(by_key(attributes.select("reach_id")), "reach_id", "left_semi").isEmpty():
        raise ValueError("no reach has catchment attributes")


def attribute_statistics(attributes: DataFrame, names: list[str]) -> DataFrame:
    """One row per attribute: min, max, mean, population std, 10th and 90th percentile.

    The percentiles come from distributed ranks of all attributes at once, as an exact
    percentile aggregate would gather every value.
    """
    long = attributes.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("attr"), null_if_nan(F.col(n)).alias("v")) for n in names]))
    )
    ends = quantiles(long, "v", {"p10": 0.1, "p90": 0.9}, ["attr"])
    return store(attribute_moments(attributes, names).join(ends, "attr", "left"), "statistics")


def attribute_moments(attributes: DataFrame, names: list[str]) -> DataFrame:
    """One row per attribute: min, max, mean and population std, in one pass over the wide table."""
    moments = []
    for n in names:
        v = null_if_nan(F.col(n))
        moments.append(
            F.struct(
                F.lit(n).alias("attr"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")
            )
        )
    return attributes.agg(F.array(*moments).alias("_s")).select(F.inline("_s"))


def statistics_row(stats: DataFrame, names: list[str], fields: tuple[str, ...] = ("mean", "std")) -> DataFrame:
    """Statistics as a single wide row ``<attr>_<field>`` (one row per attribute comes in)."""
    aggs = [
        F.max(F.when(F.col("attr") == n, F.col(f))).alias(f"{n}_{f}") for n in names for f in fields
    ]
    return stats.agg(*aggs)


def with_statistics(df: DataFrame, stats: DataFrame, names: list[str], fields=("mean", "std")) -> DataFrame:
    """Attach ``_stats``, a struct of all statistics, by a scalar subquery that is evaluated once."""
    one = statistics_row(stats, names, fields)
    return df.withColumn("_stats", one.select(F.struct(*one.columns)).scalar())


def fill_and_standardize(df: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    """Missing attributes take the training-set mean; then z-scores."""
    wide = with_statistics(df, stats, names)
    out = [c for c in df.columns if c not in names]
    scores = [
        zscore(
            F.coalesce(null_if_nan(F.col(n)), F.col(f"_stats.{n}_mean")), F.col(f"_stats.{n}_mean"), F.col(f"_stats.{n}_std")
        ).alias(n)
        for n in names
    ]
    return wide.select(*out, *scores)


def fill_with_finite_mean(df: DataFrame, names: list[str]) -> DataFrame:
    """Missing values take the mean of all finite values of the column (stays NULL if none)."""
    means = df.agg(F.struct(*[F.avg(finite_or_null(F.col(n))).alias(n) for n in names]))
    wide = df.withColumn("_means", means.scalar())
    return wide.select(
        *[
            F.coalesce(null_if_nan(F.col(c)), F.col(f"_means.{c}")).alias(c) if c in names else F.col(c)
            for c in df.columns
        ]
    )


def require_values(df: DataFrame, names: list[str]) -> DataFrame:
    """Pass rows on, failing the job at the first missing value."""
    out = []
    for n in names:
        missing = F.raise_error(F.concat(F.lit(f"no value of {n} for reach "), F.col("reach_id").cast("string"))).cast("double")
        out.append(F.coalesce(null_if_nan(F.col(n).cast("double")), missing).alias(n))
    return df.select(*[c for c in df.columns if c not in names], *out)


def out_of_distribution(df: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    """Per attribute how many values fall below the 10th or above the 90th percentile."""
    wide = with_statistics(df, stats, names, ("p10", "p90"))
    items = [
        F.struct(
            F.lit(n).alias("attr"),
            F.count_if(F.col(n) < F.col(f"_stats.{n}_p10")).alias("n_below"),
            F.count_if(F.col(n) > F.col(f"_stats.{n}_p90")).alias("n_above"),
        )
        for n in names
    ]
    return wide.agg(F.array(*items).alias("_s")).select(F.inline("_s"))


def flow_report(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Counts of missing, tiny and negative values, and min, median, max."""
    v = null_if_nan(F.col(value))
    counts = df.groupBy(*group).agg(
        F.count_if(v.isNull()).alias("n_missing"),
        F.count_if(v < 1e-6).alias("n_below_floor"),
        F.count_if(v < 0).alias("n_negative"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    middle = quantiles(df, value, {"median": 0.5}, group)
    columns = [*group, "n_missing", "n_below_floor", "n_negative", "min", "median", "max"]
    return counts.join(middle, group, "left").select(*columns)


def require_all(df: DataFrame, lookup: DataFrame, key: str) -> None:
    """Raise, naming the first ten, when keys of ``df`` are missing from ``lookup``."""
    missing = [r[0] for r in df.select(key).distinct().join(lookup, key, "left_anti").orderBy(key).limit(10).collect()]
    if missing:
        raise KeyError(f"no {key} entry for {missing}")


# The network's attribute names and those of the second supported source
NATIVE_AND_HYDROATLAS = (
    ("SoilGrids1km_clay", "cly_pc_sav"),
    ("aridity", "ari_ix_sav"),
    ("meanelevation", "ele_mt_sav"),
    ("meanP", "pre_mm_syr"),
    ("NDVI", "ndv_ix_sav"),
    ("meanslope", "slp_dg_sav"),
    ("log10_uparea", "upa_sk_smx"),
    ("SoilGrids1km_sand", "snd_pc_sav"),
    ("ETPOT_Hargr", "pet_mm_syr"),
    ("Porosity", "por_pc_sav"),
)
NATIVE_ATTRIBUTES = tuple(native for native, _ in NATIVE_AND_HYDROATLAS)
# native name -> (source name, scale, offset, take log10)
ADAPTERS = {"hydroatlas": {native: (source, 1.0, 0.0, native == "log10_uparea") for native, source in NATIVE_AND_HYDROATLAS}}


def attribute_source(columns: list[str]) -> str | None:
    have = set(columns)
    if have.issuperset(NATIVE_ATTRIBUTES):
        return "merit"
    return next((s for s, m in ADAPTERS.items() if have.issuperset(v[0] for v in m.values())), None)


def adapt_attributes(df: DataFrame, source: str | None = None, key: str = "reach_id") -> DataFrame:
    """Rename, rescale and order the attributes of a known source as the network expects them."""
    source = source or attribute_source(df.columns)
    if source is None:
        raise ValueError(f"attributes match no known source: {sorted(df.columns)}")
    if source == "merit":
        mapping = {n: (n, 1.0, 0.0, False) for n in NATIVE_ATTRIBUTES}
    elif source in ADAPTERS:
        mapping = ADAPTERS[source]
    else:
        raise ValueError(f"unknown attribute source {source!r}; known: merit, {', '.join(sorted(ADAPTERS))}")
    lacking = sorted(v[0] for v in mapping.values() if v[0] not in df.columns)
    if lacking:
        raise ValueError(f"{source} attributes are missing: {lacking}")
    out = []
    for native, (name, scale, offset, log) in mapping.items():
        v = null_if_nan(F.col(name)) * F.lit(scale) + F.lit(offset)
        if log:
            v = F.when(v.isNotNull(), F.log10(F.greatest(v, F.lit(1e-6))))
        out.append(v.alias(native))
    return df.select(key, *out)
