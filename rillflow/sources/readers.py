"""Readers: canonical tables, gauge lists, inflow, headerless routing parameters."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.ids import zero_filled
from rillflow.functions.values import ft3_to_m3, null_if_nan
from rillflow.operators.network import subset_pairs
from rillflow.operators.ranking import row_numbers
from rillflow.operators.resample import check_coverage, in_period
from rillflow.sources.schemas import GAUGE_NAMES, GAUGE_OPTIONAL, GAUGE_REQUIRED, INFLOW, OBSERVED, ZONES


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_table(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """Parquet table at one or several local, shared or object-store paths (``s3a://bucket/prefix``)."""
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        if not path_exists(spark, p):
            raise FileNotFoundError(p)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    """Order and adjacency tables of a stored network and the name of its data set."""
    order = read_table(spark, f"{path}/order")
    if "geodataset" not in order.columns:
        raise ValueError(f"{path} does not name its data set")
    first = order.select("geodataset").head()
    if first is None or first.geodataset is None:
        raise ValueError(f"{path} does not name its data set")
    return order.drop("geodataset"), read_table(spark, f"{path}/pairs"), first.geodataset


def read_gauge_subset(spark: SparkSession, path: str, staid: str) -> DataFrame:
    """Adjacency pairs of one gauge; its range of numbers is pushed to the scan and leaves most files unread."""
    found = read_table(spark, f"{path}/gauges").filter(F.col("staid") == staid).select("lo", "hi").head()
    if found is None:
        raise KeyError(staid)
    table = read_table(spark, f"{path}/labelled_pairs")
    return table.filter(F.col("pre").between(found.lo, found.hi)).drop("pre").withColumn("staid", F.lit(staid))


def read_gauge_subsets(spark: SparkSession, path: str) -> DataFrame:
    """``staid, dn_id, up_id, dn_idx, up_idx`` of all stored gauges; as many rows as the subsets have together."""
    return subset_pairs(read_table(spark, f"{path}/gauges"), read_table(spark, f"{path}/labelled_pairs"))


def read_gauges(spark: SparkSession, path: str) -> DataFrame:
    """Gauge CSV with checked header, zero-filled ids and a fallback for a missing name."""
    header = spark.read.option("header", True).csv(path).columns
    lacking = [c for c in GAUGE_REQUIRED if c not in header and c != "STANAME"]
    if lacking:
        raise KeyError(f"gauge table {path} lacks columns {lacking}")
    types = {**GAUGE_REQUIRED, **GAUGE_OPTIONAL}
    # ids stay text, so leading zeros survive
    schema = ", ".join(f"`{c}` {types[c] if types.get(c) in ('double',) else 'string'}" for c in header)
    raw = spark.read.option("header", True).schema(schema).csv(path)
    out = []
    for name in types:
        if name == "STAID":
            out.append(zero_filled(F.trim("STAID")).alias("staid"))
        elif name == "STANAME":
            source = F.col("STANAME") if "STANAME" in header else F.lit(None).cast("string")
            out.append(F.coalesce(source, F.trim("STAID")).alias("name"))
        elif name in header:
            value = F.col(name)
            if types[name] == "bigint":
                value = value.cast("double").cast("bigint")
            elif types[name] == "boolean":
                value = F.lower(F.trim(value)).isin("true", "1", "t", "yes")
            out.append(value.alias(GAUGE_NAMES[name]))
    return raw.select(*out)


def checked_gauges(gauges: DataFrame, with_reach: bool = False) -> DataFrame:
    """Pass gauges on, failing the job at the first record that breaks a rule."""
    rules = [
        (F.length("staid") >= 8, "station id shorter than 8 characters"),
        (F.col("drain_sqkm") > 0, "drainage area must be positive"),
        (F.col("lat").isNotNull() & F.col("lon").isNotNull(), "missing coordinates"),
    ]
    if with_reach:
        rules.append((F.col("reach_id").isNotNull(), "missing reach id"))
    out = F.col("staid")
    for ok, message in rules:
        text = F.concat(F.lit(f"{message}: "), F.coalesce("staid", F.lit("?")))
        out = F.when(F.coalesce(ok, F.lit(False)), out).otherwise(F.raise_error(text))
    return gauges.withColumn("staid", out)


def read_inflow(
    spark: SparkSession, path: str, wanted: DataFrame, start: datetime, end: datetime, value: str = "qr", step: timedelta = timedelta(hours=1)
) -> DataFrame:
    """Inflow of the wanted reaches in [start, end).

    The period prunes the monthly partitions and is pushed to the scan; a period that the
    store does not cover is an error.
    """
    check_coverage(read_table(spark, path), "ts", start, end, step)
    rows = read_period(spark, path, start, end, value)
    return single_values(rows.join(wanted.select("reach_id").distinct(), "reach_id", "left_semi"))


def read_period(spark: SparkSession, path: str, start: datetime | None, end: datetime | None, value: str = "qr") -> DataFrame:
    """``reach_id, ts, qr`` of [start, end), or of the whole store without a period.

    Months and timestamps are compared as they are stored, so partitions are pruned and the rest
    of the filter reaches the scan. Values are as stored; see ``single_values``.
    """
    table = read_table(spark, path)
    if start is not None and end is not None:
        if "month" in table.columns:
            table = table.filter((F.col("month") >= start.strftime("%Y-%m")) & (F.col("month") <= end.strftime("%Y-%m")))
        table = in_period(table, "ts", start, end)
    return table.select("reach_id", "ts", F.col(value).alias("qr"))


def single_values(inflow: DataFrame) -> DataFrame:
    """``reach_id, ts, qr``; a job that meets two rows for one reach and time fails.

    Rows are dealt by reach alone, which later steps per reach can use as it is.
    """
    counted = inflow.repartition("reach_id").groupBy("reach_id", "ts").agg(F.max("qr").alias("qr"), F.count("*").alias("_n"))
    text = F.concat(F.lit("two inflow values for reach "), F.col("reach_id").cast("string"), F.lit(" at "), F.col("ts").cast("string"))
    return counted.select("reach_id", "ts", F.when(F.col("_n") > 1, F.raise_error(text)).otherwise(F.col("qr")).alias("qr"))


def read_observations(
    spark: SparkSession, path: str, gauges: DataFrame, start, end, cubic_feet: bool = False
) -> DataFrame:
    rows = read_table(spark, path, OBSERVED).join(gauges.select("staid"), "staid", "left_semi")
    rows = rows.filter((F.col("d") >= F.lit(start)) & (F.col("d") <= F.lit(end)))
    flow = null_if_nan(F.col("streamflow"))
    return rows.select("staid", "d", (ft3_to_m3(flow) if cubic_feet else flow).alias("streamflow"))


def read_zones(spark: SparkSession, path: str, zones: tuple[str, ...] = ZONES) -> DataFrame:
    """One table from the folders of all zones."""
    parts = [read_table(spark, f"{path}/{z}", INFLOW) for z in zones]
    return reduce(DataFrame.unionByName, parts)


def read_station_ids(spark: SparkSession, path: str, separator: str = ",", column: str | None = None) -> DataFrame:
    """Station ids of a delimited list, names and values trimmed, zero-filled."""
    rows = spark.read.option("header", True).option("sep", separator).csv(path)
    rows = rows.toDF(*[c.strip() for c in rows.columns])
    return rows.select(zero_filled(F.trim(F.col(column or rows.columns[0]))).alias("staid")).distinct()


def read_aligned_columns(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Headerless one-value-per-line files whose lines belong together, as one table.

    A line's position follows from the start of its file block and its order within the
    block, so large files may be split over tasks.
    """
    out = None
    for name, path in files.items():
        lines = spark.read.text(path).select(
            F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), "value"
        )
        filled = lines.filter(F.trim("value") != "")
        placed = row_numbers(filled, [F.col("_block"), F.col("_line")], name="pos")
        column = placed.select("pos", F.trim("value").cast("double").alias(name))
        out = column if out is None else out.join(column, "pos", "full")
    return out


def read_linear_parameters(spark: SparkSession, k: str, x: str, ids: str) -> DataFrame:
    """``reach_id, k, x`` from three position-aligned files; unequal lengths are an error."""
    table = read_aligned_columns(spark, {"reach_id": ids, "k": k, "x": x})
    gap = F.col("reach_id").isNull() | F.col("k").isNull() | F.col("x").isNull()
    return table.select(
        F.when(gap, F.raise_error(F.lit("parameter files differ in length"))).otherwise(F.col("reach_id").cast("bigint")).alias("reach_id"),
        "k",
        "x",
    )


def read_connectivity(spark: SparkSession, path: str) -> DataFrame:
    """Flow table of a headerless ``id, downstream id, ...`` file; ids named only downstream are added."""
    rows = spark.read.csv(path)
    links = rows.select(F.trim(rows.columns[0]).cast("bigint").alias("reach_id"), F.trim(rows.columns[1]).cast("bigint").alias("down_id"))
    links = links.withColumn("down_id", F.when(F.col("down_id") > 0, F.col("down_id")))
    ends = links.filter("down_id IS NOT NULL").select(F.col("down_id").alias("reach_id")).distinct()
    missing = ends.join(links, "reach_id", "left_anti").withColumn("down_id", F.lit(None).cast("bigint"))
    return links.unionByName(missing)


def read_summed(spark: SparkSession, path: str, gauges: DataFrame) -> DataFrame | None:
    """Stored baseline of the given gauges; None if there is no store or no gauge in common."""
    if not path_exists(spark, path):
        return None
    rows = spark.read.parquet(path).join(gauges.select("staid"), "staid", "left_semi")
    return None if rows.isEmpty() else rows
