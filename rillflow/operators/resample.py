"""Calendars, windows and changes of time step."""

from __future__ import annotations

import random
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = "1980-01-01"


def parse_day(text: str) -> date:
    return datetime.strptime(text, "%Y/%m/%d").date()


def daily_calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Days with both ends, and their number since the origin."""
    days = spark.range((end - start).days + 1)
    d = F.date_add(F.lit(start), F.col("id").cast("int"))
    return days.select(d.alias("d"), day_number(d).alias("day_no"), F.col("id").alias("day_idx"))


def hourly_calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Hours from the first midnight up to, without, the last one: N days give (N-1)*24 rows."""
    hours = spark.range((end - start).days * 24)
    ts = F.lit(datetime(start.year, start.month, start.day)).cast("timestamp_ntz") + F.make_dt_interval(
        hours=F.col("id").cast("int")
    )
    return hours.select(ts.alias("ts"), F.col("id").alias("hour_idx"))


def day_number(col: Column) -> Column:
    return F.date_diff(col.cast("date"), F.lit(ORIGIN).cast("date"))


def hour_index(ts: Column, start: datetime) -> Column:
    """Whole hours since ``start``."""
    begin = F.lit(start.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return F.timestamp_diff("HOUR", begin, ts.cast("timestamp_ntz")).cast("long")


def check_rho(rho: int | None, n_days: int) -> None:
    if rho is not None and rho > n_days:
        raise ValueError(f"a window of {rho} days does not fit {n_days} days")


def random_window(start: date, n_days: int, rho: int, seed: int) -> tuple[date, date]:
    """A run of ``rho`` days whose first day lies in [0, n_days - rho)."""
    check_rho(rho, n_days)
    first = random.Random(seed).randrange(max(1, n_days - rho))
    return start + timedelta(days=first), start + timedelta(days=first + rho - 1)


def tumbling_windows(days: DataFrame, n_days: int, rho: int) -> DataFrame:
    """Number the non-overlapping windows of ``rho`` days; the remainder is left out."""
    window = F.floor(F.col("day_idx") / F.lit(rho))
    return days.withColumn("window_no", window).filter(window < F.lit(n_days // rho))


def chunks_with_lead(days: DataFrame, size: int) -> DataFrame:
    """Consecutive chunks of days, each preceded by the last day of the one before."""
    own = days.withColumn("chunk", F.floor(F.col("day_idx") / F.lit(size)))
    last = F.pmod(F.col("day_idx") + 1, F.lit(size)) == 0
    lead = own.filter(last).withColumn("chunk", F.col("chunk") + 1)
    real = own.select("chunk").distinct()
    return own.unionByName(lead.join(real, "chunk", "left_semi").select(own.columns))


def in_period(df: DataFrame, ts: str, start: datetime | date, end: datetime | date) -> DataFrame:
    """Rows of [start, end); a plain comparison, so it prunes partitions and row groups."""
    low, high = (F.lit(str(x)).cast("timestamp_ntz") if isinstance(x, datetime) else F.lit(x) for x in (start, end))
    return df.filter((F.col(ts) >= low) & (F.col(ts) < high))


def check_coverage(df: DataFrame, ts: str, start: datetime, end: datetime, step: timedelta = timedelta(hours=1)) -> None:
    """Raise unless the stored series covers the period [start, end).

    A value stands for the ``step`` from its time on, so a store covers up to its last time plus one
    step. Of a store by month only the first and the last month are read.
    """
    if "month" in df.columns:
        first, last = df.agg(F.min("month"), F.max("month")).head()
        low, high = df.filter(F.col("month").isin(first, last)).agg(F.min(ts), F.max(ts)).head()
    else:
        low, high = df.agg(F.min(ts), F.max(ts)).head()
    if low is None or start < low:
        raise ValueError(f"period starts {start}, stored series starts {low}")
    if end > high + step:
        raise ValueError(f"period ends {end}, stored series ends {high + step}")


@dataclass(frozen=True)
class Gaps:
    """Hourly series of which only some rows exist: ``n_hours`` from ``start`` on for every row of ``keys``.

    A sample without a row, or without a value, counts ``default``; there is at most one row for a key
    and an hour. Only existing rows and keys move: what they give is held in one row per key, so
    the full grid is never shuffled.
    """

    keys: DataFrame
    start: datetime
    n_hours: int
    default: float


def _held(df: DataFrame, key: str, slot: str, held: Column, gaps: Gaps) -> DataFrame:
    """``key``, ``_rows``, the number of rows it has in the keys, and ``_held``, a map of its slots (NULL if it has none)."""
    maps = df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(slot), held))).alias("_held"))
    return gaps.keys.groupBy(key).agg(F.count("*").alias("_rows")).join(maps, key, "left")


def _gap_means(df: DataFrame, key: str, slot: str, value: str, n_slots: int, width: Column, gaps: Gaps) -> DataFrame:
    """``key``, ``_rows``, slot and the mean of each of ``n_slots`` slots, which have ``width`` samples."""
    given = df.groupBy(key, slot).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    full = _held(given, key, slot, F.struct("s", "n"), gaps)
    slots = full.select(key, "_rows", "_held", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_slots - 1).cast("long"))).alias(slot))
    at = F.element_at("_held", F.col(slot))
    total = F.coalesce(at["s"], F.lit(0.0)) + (width - F.coalesce(at["n"], F.lit(0))) * F.lit(gaps.default)
    return slots.select(key, "_rows", slot, (total / width).alias(value))


def hourly_to_daily(
    df: DataFrame, key: str, ts: str, value: str, whole_days: bool = True, gaps: Gaps | None = None
) -> DataFrame:
    """Daily means; with ``whole_days`` only of days that have all 24 hours.

    With ``gaps``, which start at midnight and cover whole days, a day has all hours of each row of its key:
    24 unless the key is repeated.
    """
    if gaps is not None:
        hours = df.withColumn("_at", hour_index(F.col(ts), gaps.start)).filter(F.col("_at").between(0, gaps.n_hours - 1))
        days = hours.select(key, F.floor(F.col("_at") / 24).alias("_day"), value)
        daily = _gap_means(days, key, "_day", value, gaps.n_hours // 24, F.lit(24), gaps)
        if whole_days:
            daily = daily.filter(F.col("_rows") == 1)
        return daily.select(key, F.date_add(F.lit(gaps.start.date()), F.col("_day").cast("int")).alias("d"), value)
    daily = df.groupBy(key, F.to_date(ts).alias("d")).agg(F.avg(value).alias(value), F.count("*").alias("_n"))
    if whole_days:
        daily = daily.filter(F.col("_n") == 24)
    return daily.select(key, "d", value)


def daily_to_hourly(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Hold each daily value for its 24 hours."""
    hour = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h")
    return df.select(key, day, value, hour).select(
        key, (F.col(day).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("h"))).alias("ts"), value
    )


def area_downsample(
    df: DataFrame, key: str, index: str, value: str, length: int, bins: int, gaps: Gaps | None = None
) -> DataFrame:
    """Adaptive mean of ``length`` samples in ``bins`` bins; with ``gaps`` missing samples are filled in.

    Bin b averages samples floor(b*length/bins) .. ceil((b+1)*length/bins)-1; when the
    bins do not divide the length neighbouring bins share a sample, which is then emitted twice.
    """
    if bins > length:
        raise ValueError(f"cannot spread {length} samples over {bins} bins")
    i = F.col(index).cast("long")
    first = F.floor(i * F.lit(bins) / F.lit(length))
    # the next bin starts at or before this sample when its own floor reaches back to it
    shared = F.floor((first + 1) * F.lit(length) / F.lit(bins)) <= i
    both = F.when(shared & (first + 1 < bins), F.array(first, first + 1)).otherwise(F.array(first))
    if gaps is not None:
        b = F.col("bin")
        width = F.ceil((b + 1) * F.lit(length) / F.lit(bins)) - F.floor(b * F.lit(length) / F.lit(bins))
        dealt = df.filter(i.between(0, length - 1)).select(key, F.explode(both).alias("bin"), value)
        return _gap_means(dealt, key, "bin", value, bins, width, gaps).drop("_rows")
    return (
        df.select(key, F.explode(both).alias("bin"), value).groupBy(key, "bin").agg(F.avg(value).alias(value))
    )


def trimmed_slice(n_hours: int, tau: int, start_offset: int | None = None) -> tuple[int, int]:
    """Hour range kept before daily means; a non-negative end counts from the front."""
    start = 13 + tau if start_offset is None else start_offset
    stop = -11 + tau
    low, high, _ = slice(start, stop).indices(n_hours)
    return low, max(low, high)


def daily_runoff(
    df: DataFrame,
    key: str,
    index: str,
    value: str,
    n_hours: int,
    tau: int,
    start_offset: int | None = None,
    gaps: Gaps | None = None,
) -> DataFrame:
    """Daily means of the trimmed hourly series: ``key, day, value``; with ``gaps`` missing hours are filled in."""
    low, high = trimmed_slice(n_hours, tau, start_offset)
    days = (high - low) // 24
    if days == 0:
        return df.select(key, F.lit(0).cast("long").alias("day"), F.col(value).cast("double")).limit(0)
    kept = df.filter((F.col(index) >= low) & (F.col(index) < high)).withColumn(index, F.col(index) - F.lit(low))
    return area_downsample(kept, key, index, value, high - low, days, gaps).withColumnRenamed("bin", "day")


def interpolate(df: DataFrame, key: str, ts: str, value: str, step_hours: int, gaps: Gaps | None = None) -> DataFrame:
    """Linear values at every hour between samples ``step_hours`` apart, whatever hour they start at.

    Each sample also travels to the slot before it, so that both ends meet by an
    aggregation and no series is ordered in a single task. With ``gaps`` the samples are those of
    every ``step_hours``-th hour from its start on, missing ones filled in, and both ends are looked up.
    """
    h = F.col("h").cast("double") / F.lit(float(step_hours))
    hours = F.explode(F.sequence(F.lit(0), F.lit(step_hours - 1))).alias("h")
    out = (F.col("t") + F.make_dt_interval(hours=F.col("h"))).alias("ts"), ((F.lit(1.0) - h) * F.col("a") + h * F.col("b")).alias(value)
    if gaps is not None:
        at = hour_index(F.col(ts), gaps.start)
        samples = df.filter(at.between(0, gaps.n_hours - 1) & (at % step_hours == 0)).select(key, (at / step_hours).cast("int").alias("slot"), value)
        slots = F.explode(F.sequence(F.lit(0), F.lit((gaps.n_hours - 1) // step_hours - 1))).alias("slot")
        full = _held(samples, key, "slot", F.col(value), gaps).select(key, "_held", slots)
        a, b = (F.coalesce(F.element_at("_held", F.col("slot") + i), F.lit(gaps.default)) for i in (0, 1))
        begin = F.lit(gaps.start.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
        t = begin + F.make_dt_interval(hours=F.col("slot") * step_hours)
        return full.select(key, t.alias("t"), a.alias("a"), b.alias("b"), hours).select(key, *out)
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    slot = F.floor(F.timestamp_diff("SECOND", start, F.col(ts).cast("timestamp_ntz")) / F.lit(step_hours * 3600))
    ends = df.select(
        key,
        F.explode(
            F.array(F.struct(slot.alias("slot"), F.lit(0).alias("side")), F.struct((slot - 1).alias("slot"), F.lit(1).alias("side")))
        ).alias("_e"),
        F.col(value).alias("_v"),
        F.col(ts).cast("timestamp_ntz").alias("_t"),
    )
    pairs = ends.groupBy(key, F.col("_e.slot").alias("slot")).agg(
        F.max(F.when(F.col("_e.side") == 0, F.col("_v"))).alias("a"),
        F.max(F.when(F.col("_e.side") == 0, F.col("_t"))).alias("t"),
        F.max(F.when(F.col("_e.side") == 1, F.col("_v"))).alias("b"),
    )
    return pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select(key, "t", "a", "b", hours).select(key, *out)


def substeps(df: DataFrame, current: str, previous: str, n: int, linear: bool) -> DataFrame:
    """Inflow of each of ``n`` sub-steps of an interval, held or interpolated.

    The first interval has no previous value and is held, as is a single step.
    """
    k = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")
    out = df.select("*", k)
    if not linear or n == 1:
        return out.withColumn("inflow", F.col(current))
    a = F.col("step") / F.lit(float(n))
    mixed = (F.lit(1.0) - a) * F.col(previous) + a * F.col(current)
    return out.withColumn("inflow", F.when(F.col(previous).isNull(), F.col(current)).otherwise(mixed))


def without_ends(df: DataFrame, day: str, first: date, last: date) -> DataFrame:
    """Drop the first and last day, which trimmed predictions do not cover."""
    return df.filter((F.col(day) > F.lit(first)) & (F.col(day) < F.lit(last)))


def after_warmup(df: DataFrame, day: str, first: date, warmup: int) -> DataFrame:
    return df.filter(F.col(day) >= F.lit(first + timedelta(days=warmup)))


def unmatched_days(calendar: DataFrame, series: DataFrame) -> DataFrame:
    """Days of the calendar for which a series has no row at all."""
    return calendar.select("d").join(series.select(F.to_date("d").alias("d")), "d", "left_anti")


def at_midnight(df: DataFrame, ts: str) -> DataFrame:
    """Timestamps moved to the start of their day, as daily stores with a time of day need it."""
    return df.withColumn(ts, F.date_trunc("DAY", F.col(ts)).cast("timestamp_ntz"))
