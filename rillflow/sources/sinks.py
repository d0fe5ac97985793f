"""Writers: networks, gauge subsets, attributes, results, reports and cleaned stores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.values import floored_flow, mm_day_to_m3s
from rillflow.operators import cleaning
from rillflow.operators.metrics import summarize
from rillflow.operators.network import gauge_intervals, labelled_pairs
from rillflow.scratch import by_key, store
from rillflow.sources.readers import path_exists

# Scores of the detailed report, under the names used there
DETAIL = {
    "bias": "bias",
    "flv": "flv_percent",
    "fhv": "fhv_percent",
    "kge": "kge",
    "nse": "nse",
    "mae": "mae",
    "rmse": "rmse",
    "corr": "corr",
    "pbias": "pbias",
}


def write_network(order: DataFrame, pairs: DataFrame, path: str, dataset: str) -> None:
    """Order and adjacency of a network; an existing network is never overwritten."""
    if path_exists(order.sparkSession, path):
        raise FileExistsError(path)
    order.withColumn("geodataset", F.lit(dataset)).write.mode("errorifexists").parquet(f"{path}/order")
    pairs.write.mode("errorifexists").parquet(f"{path}/pairs")


def write_labelled_pairs(pairs: DataFrame, pieces: DataFrame, path: str) -> None:
    """Adjacency pairs in the order of the numbers ``pre``, so that an upstream set is a run of rows in few files.

    The pairs are stored once, whatever the number of gauges.
    """
    labelled = labelled_pairs(pairs, pieces)
    labelled.repartitionByRange("pre").sortWithinPartitions("pre").write.mode("errorifexists").parquet(f"{path}/labelled_pairs")


def write_gauge_subsets(gauges: DataFrame, pieces: DataFrame, order: DataFrame, path: str) -> int:
    """Append the subsets of gauges that are not stored yet; returns how many were new.

    A subset is one row with the range of numbers of everything upstream (see ``write_labelled_pairs``).
    Gauges whose reach is not in the network are left out.
    """
    spark = gauges.sparkSession
    known = gauge_intervals(pieces, gauges).join(by_key(order.select("reach_id", F.col("topo_idx").alias("gauge_idx"))), "reach_id")
    if path_exists(spark, f"{path}/gauges"):
        known = known.join(spark.read.parquet(f"{path}/gauges"), "staid", "left_anti")
    new = store(known.select("staid", F.col("reach_id").alias("gauge_catchment"), "gauge_idx", "lo", "hi"), "new-gauges")
    new.write.mode("append").parquet(f"{path}/gauges")
    return new.count()


def reach_attributes(order: DataFrame, attributes: DataFrame, names: list[str]) -> DataFrame:
    """Attributes of every reach of the order, as 32-bit floats, NULL where unknown."""
    values = attributes.select("reach_id", *[F.col(n).cast("float").alias(n) for n in names])
    return order.select("reach_id", "topo_idx").join(values, "reach_id", "left")


def merit_attributes(order: DataFrame, reaches: DataFrame) -> DataFrame | None:
    """``length_m`` and ``slope`` from kilometre lengths; None when neither column exists."""
    have = [c for c in ("lengthkm", "slope") if c in reaches.columns]
    if not have:
        return None
    cols = {"lengthkm": (F.col("lengthkm") * 1000.0).alias("length_m"), "slope": F.col("slope")}
    rows = reaches.select(F.col("COMID").cast("long").alias("reach_id"), *[cols[c] for c in have])
    return reach_attributes(order, rows, ["length_m" if c == "lengthkm" else c for c in have])


# Columns of the attribute table of string-id flowpaths, and their stored names
FLOWPATH_ATTRIBUTES = {"Length_m": "length_m", "So": "slope", "TopWdth": "top_width", "ChSlp": "side_slope", "MusX": "muskingum_x"}


def flowpath_attributes(order: DataFrame, flowpaths: DataFrame, attributes: DataFrame) -> DataFrame:
    """``id, topo_idx``, five attributes as 32-bit floats (NULL where unknown) and ``toid`` (empty where unknown).

    Of several rows for one id the largest values count, so a reach keeps one row.
    """
    values = attributes.groupBy("id").agg(*[F.max(F.col(c).cast("float")).alias(n) for c, n in FLOWPATH_ATTRIBUTES.items()])
    targets = flowpaths.groupBy("id").agg(F.max("toid").alias("toid"))
    out = order.select("id", "topo_idx").join(by_key(values), "id", "left").join(by_key(targets), "id", "left")
    return out.withColumn("toid", F.coalesce("toid", F.lit("")))


def write_by_month(df: DataFrame, path: str, ts: str = "ts", mode: str = "errorifexists") -> None:
    """Long series partitioned by month.

    Rows are rebalanced by month: small months share a task, large ones are split into pieces of
    the session's advisory size, whatever the number of months or rows.
    """
    month = F.date_format(ts, "yyyy-MM")
    df.withColumn("month", month).hint("rebalance", "month").write.mode(mode).partitionBy("month").parquet(path)


def write_results(df: DataFrame, path: str, **notes: str) -> None:
    """Result table with its notes (version, period, model) as constant columns."""
    for name, text in notes.items():
        df = df.withColumn(name, F.lit(text))
    df.write.mode("overwrite").parquet(path)


def write_score_report(scores: DataFrame, path: str, start: str = "N/A", end: str = "N/A") -> str:
    """Summary as JSON and one CSV row per gauge; missing values stay empty. Returns the time stamp."""
    stamp = datetime.now().strftime("%Y%m%d_%H%M%S")
    summary = summarize(scores).withColumn("metric", F.coalesce(F.element_at(F.create_map(F.lit("flv"), F.lit("flv_percent"), F.lit("fhv"), F.lit("fhv_percent")), F.col("metric")), F.col("metric")))
    body = summary.agg(
        F.map_from_entries(F.collect_list(F.struct("metric", F.struct("median", "mean", "q25", "q75")))).alias("metrics_summary"),
        F.map_from_entries(F.collect_list(F.struct("metric", "valid"))).alias("valid_gauge_counts"),
    )
    total = scores.agg(F.count("*").alias("total_gauges"))
    row = body.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k").drop("_k")
    row = row.select(
        F.lit(stamp).alias("timestamp"),
        "total_gauges",
        F.struct(F.lit(start).alias("start"), F.lit(end).alias("end")).alias("evaluation_period"),
        "metrics_summary",
        "valid_gauge_counts",
    )
    row.coalesce(1).write.json(f"{path}/metrics_summary_{stamp}")
    detail = scores.select(F.col("staid").alias("STAID"), *[F.col(c).alias(n) for c, n in DETAIL.items()])
    detail.write.option("header", True).csv(f"{path}/detailed_metrics_{stamp}")
    return stamp


def scores_as_json(scores: DataFrame) -> DataFrame:
    """One JSON text per gauge, without the series themselves."""
    return scores.select(F.to_json(F.struct(*[c for c in scores.columns if c not in ("pred", "target")])).alias("body"))


def cached_statistics(attributes: DataFrame, names: list[str], path: str) -> DataFrame:
    """Attribute statistics from the store at ``path``, computed and written the first time."""
    spark: SparkSession = attributes.sparkSession
    if not path_exists(spark, path):
        cleaning.attribute_statistics(attributes, names).coalesce(1).write.parquet(path)
    stats = spark.read.parquet(path)
    lacking = set(names) - {r.attr for r in stats.filter(F.col("attr").isin(names)).select("attr").collect()}
    if lacking:
        raise KeyError(f"stored statistics lack {sorted(lacking)}")
    return stats


def clean_store(inflow: DataFrame, areas: DataFrame, path: str, version: str, dry_run: bool = False) -> DataFrame:
    """New version of an inflow store: runoff depth to volume, gaps and tiny values to the floor.

    Writes below ``path/version=...`` unless it is a dry run, and returns a report per month.
    """
    cleaning.require_all(inflow, areas, "reach_id")
    rows = inflow.join(areas.select("reach_id", "area_sqkm"), "reach_id")
    cleaned = rows.select("reach_id", "ts", floored_flow(mm_day_to_m3s(F.col("qr"), F.col("area_sqkm"))).alias("qr"))
    if not dry_run:
        write_by_month(cleaned, f"{path}/version={version}")
    return cleaning.flow_report(rows.withColumn("month", F.date_format("ts", "yyyy-MM")), "qr", ["month"])


def write_gauge_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Gauge lists as CSV with header; a gauge list is at most some ten thousand rows."""
    for name, df in tables.items():
        df.orderBy("STAID").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
