"""Chunked arrays of a Zarr v3 group as a Spark data source.

``spark.read.format("zarr").option("arrays", "indices_0,indices_1").load(group)`` gives one row
per element with its position(s) ``i0`` (``i1``) and a column per array; with
``.option("subgroups", True)`` the arrays of every sub-group, named in column ``group``. A task
reads the same chunk of all arrays. Plain, gzip and zstd chunks of numeric arrays with one or
two dimensions are understood; the store has to be reachable from every executor.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from rillflow.functions.ids import converter_for

# Element types of the format
TYPES = {
    "bool": ("?", BooleanType()),
    "int8": ("i1", ShortType()),
    "uint8": ("u1", ShortType()),
    "int16": ("i2", ShortType()),
    "int32": ("i4", IntegerType()),
    "int64": ("i8", LongType()),
    "float32": ("f4", FloatType()),
    "float64": ("f8", DoubleType()),
}


def metadata(path: str) -> dict:
    try:
        with open(os.path.join(path, "zarr.json")) as f:
            return json.load(f)
    except FileNotFoundError:
        raise FileNotFoundError(f"no array or group at {path}") from None


def _fill(value):
    return {"NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}.get(value, value) if isinstance(value, str) else value


def load_chunk(path: str, meta: dict, index: tuple[int, ...]):
    """One chunk as an array of the chunk's shape; an absent chunk holds the fill value."""
    import numpy as np

    shape = meta["chunk_grid"]["configuration"]["chunk_shape"]
    code = TYPES[meta["data_type"]][0]
    separator = meta.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
    name = os.path.join(path, *separator.join(["c", *map(str, index)]).split("/"))
    if not os.path.exists(name):
        return np.full(shape, _fill(meta["fill_value"]), dtype=code)
    with open(name, "rb") as f:
        raw = f.read()
    order = "<"
    for codec in reversed(meta["codecs"]):
        kind, conf = codec["name"], codec.get("configuration", {})
        if kind == "zstd":
            import zstandard

            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        elif kind == "gzip":
            import gzip

            raw = gzip.decompress(raw)
        elif kind == "bytes":
            order = ">" if conf.get("endian") == "big" else "<"
        else:
            raise ValueError(f"chunks of {path} use the unsupported codec {kind!r}")
    return np.frombuffer(raw, dtype=order + code).astype(code).reshape(shape)


class Chunk(InputPartition):
    def __init__(self, group: str, index: tuple[int, ...]):
        self.group, self.index = group, index


class ArrayReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.root = options["path"]
        self.arrays = [a.strip() for a in options["arrays"].split(",")]
        self.nested = options.get("subgroups", "false").lower() == "true"

    def groups(self) -> list[str]:
        if not self.nested:
            return [""]
        return sorted(d for d in os.listdir(self.root) if os.path.exists(os.path.join(self.root, d, "zarr.json")))

    def partitions(self):
        import itertools

        out = []
        for group in self.groups():
            metas = [metadata(os.path.join(self.root, group, a)) for a in self.arrays]
            grids = {(tuple(m["shape"]), tuple(m["chunk_grid"]["configuration"]["chunk_shape"])) for m in metas}
            if len(grids) > 1:
                raise ValueError(f"arrays {self.arrays} differ in shape or chunks")
            shape, chunk = grids.pop()
            out += [Chunk(group, ix) for ix in itertools.product(*[range(-(-n // c)) for n, c in zip(shape, chunk, strict=True)])]
        return out

    def read(self, partition: Chunk):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        folder = os.path.join(self.root, partition.group)
        metas = [metadata(os.path.join(folder, a)) for a in self.arrays]
        shape, chunk = metas[0]["shape"], metas[0]["chunk_grid"]["configuration"]["chunk_shape"]
        keep = tuple(slice(0, min(c, n - i * c)) for n, c, i in zip(shape, chunk, partition.index, strict=True))
        parts = [load_chunk(os.path.join(folder, a), m, partition.index)[keep] for a, m in zip(self.arrays, metas, strict=True)]
        axes = np.indices(parts[0].shape)
        columns = [(axes[d] + partition.index[d] * chunk[d]).ravel() for d in range(len(shape))] + [p.ravel() for p in parts]
        if self.nested:
            columns.insert(0, np.full(parts[0].size, partition.group, dtype=object))
        target = to_arrow_schema(self.schema)
        yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zarr"

    def schema(self) -> StructType:
        reader = ArrayReader(StructType(), self.options)
        groups = reader.groups()
        if not groups:
            raise ValueError(f"no sub-groups in {reader.root}")
        fields = [StructField("group", StringType())] if reader.nested else []
        metas = [metadata(os.path.join(reader.root, groups[0], a)) for a in reader.arrays]
        fields += [StructField(f"i{d}", LongType()) for d in range(len(metas[0]["shape"]))]
        for name, meta in zip(reader.arrays, metas, strict=True):
            if meta["data_type"] not in TYPES:
                raise ValueError(f"array {name} has the unsupported type {meta['data_type']!r}")
            fields.append(StructField(name, TYPES[meta["data_type"]][1]))
        return StructType(fields)

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrayReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArraySource)


def read_adjacency_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    """Order (``src_id, topo_idx``) and pairs (``dn_idx, up_idx``) of a stored matrix, and its data set."""
    register(spark)
    dataset = metadata(path).get("attributes", {}).get("geodataset")
    if not dataset:
        raise ValueError(f"{path} does not name its data set")
    order = spark.read.format("zarr").option("arrays", "order").load(path)
    pairs = spark.read.format("zarr").option("arrays", "indices_0,indices_1").load(path)
    source_id = converter_for(dataset).from_number(F.col("order"))
    return (
        order.select(source_id.alias("src_id"), F.col("order").cast("long").alias("reach_id"), F.col("i0").alias("topo_idx")),
        pairs.select(F.col("indices_0").cast("long").alias("dn_idx"), F.col("indices_1").cast("long").alias("up_idx")),
        dataset,
    )


def read_gauge_store(spark: SparkSession, path: str) -> DataFrame:
    """``staid, dn_idx, up_idx`` of all gauges of a store with one sub-group per gauge."""
    register(spark)
    rows = spark.read.format("zarr").option("arrays", "indices_0,indices_1").option("subgroups", True).load(path)
    return rows.select(
        F.col("group").alias("staid"), F.col("indices_0").cast("long").alias("dn_idx"), F.col("indices_1").cast("long").alias("up_idx")
    )
