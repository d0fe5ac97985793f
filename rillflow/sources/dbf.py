"""Attribute tables of shapefiles (dBASE files) as a Spark data source.

``spark.read.format("dbf").option("columns", "COMID,uparea").load("rivers.dbf")``. Records have
a fixed width, so each task seeks to its own range of them. Geometry is not read.
"""

from __future__ import annotations

import struct

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DateType, DoubleType, LongType, StringType, StructField, StructType


def table_layout(path: str) -> tuple[int, int, int, list[tuple[str, str, int, int, int]]]:
    """Record count, header size, record size and fields (name, type, offset, width, decimals)."""
    with open(path, "rb") as f:
        head = f.read(32)
        count, start, width = struct.unpack("<IHH", head[4:12])
        fields, offset = [], 1  # the first byte of a record marks deletion
        while True:
            raw = f.read(32)
            if len(raw) < 32 or raw[0] == 0x0D:
                break
            name = raw[:11].split(b"\0", 1)[0].decode("ascii")
            fields.append((name, chr(raw[11]), offset, raw[16], raw[17]))
            offset += raw[16]
    return count, start, width, fields


def _type(kind: str, decimals: int):
    if kind in "NF":
        return DoubleType() if decimals or kind == "F" else LongType()
    return {"L": BooleanType(), "D": DateType()}.get(kind, StringType())


def _value(raw: bytes, kind: str, decimals: int, encoding: str):
    text = raw.decode(encoding).strip().strip("\0")
    if not text or set(text) == {"*"}:
        return None
    if kind in "NF":
        return float(text) if decimals or kind == "F" else int(float(text))
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    if kind == "D":
        from datetime import date

        return date(int(text[:4]), int(text[4:6]), int(text[6:8]))
    return text


class Records(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class DbfReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.encoding = options["path"], options.get("encoding", "utf-8")
        self.rows = int(options.get("rowspertask", 500_000))
        self.names = schema.names

    def partitions(self):
        count = table_layout(self.path)[0]
        return [Records(a, min(a + self.rows, count)) for a in range(0, count, self.rows)]

    def read(self, partition: Records):
        _, start, width, fields = table_layout(self.path)
        known = {f[0]: f for f in fields}
        wanted = [known[n] for n in self.names]
        with open(self.path, "rb") as f:
            f.seek(start + partition.low * width)
            for _ in range(partition.low, partition.high):
                record = f.read(width)
                if record[:1] != b"*":
                    yield tuple(_value(record[o : o + w], k, d, self.encoding) for _, k, o, w, d in wanted)


class DbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbf"

    def schema(self) -> StructType:
        known = {f[0]: f for f in table_layout(self.options["path"])[3]}
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()] or list(known)
        unknown = [c for c in wanted if c not in known]
        if unknown:
            raise ValueError(f"unknown columns {unknown}")
        return StructType([StructField(n, _type(known[n][1], known[n][4])) for n in wanted])

    def reader(self, schema: StructType) -> DataSourceReader:
        return DbfReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DbfSource)
