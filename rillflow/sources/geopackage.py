"""Attribute tables of a GeoPackage (an SQLite file) as a Spark data source.

``spark.read.format("geopackage").option("table", t).option("columns", "id,toid").load(path)``.
Rows are read in ranges of the row id, one range per task; the file has to be reachable from
every executor. Geometry columns are left out.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str):
    import sqlite3

    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class GeoPackageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.path, self.table = options["path"], options["table"]
        self.rows = int(options.get("rowspertask", 500_000))

    def partitions(self):
        with _open(self.path) as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return []
        return [RowRange(a, min(a + self.rows, high + 1)) for a in range(low, high + 1, self.rows)]

    def read(self, partition: RowRange):
        columns = ", ".join(_quoted(n) for n in self.names)
        query = f"SELECT {columns} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?"
        with _open(self.path) as con:
            yield from con.execute(query, (partition.low, partition.high))


class GeoPackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> StructType:
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        with _open(self.options["path"]) as con:
            info = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not info:
            raise ValueError(f"no table {self.options['table']!r} in {self.options['path']}")
        declared = {row[1]: (row[2] or "").upper() for row in info}
        unknown = [c for c in wanted if c not in declared]
        if unknown:
            raise ValueError(f"unknown columns {unknown}")
        fields = []
        for name in wanted or [n for n, t in declared.items() if not _is_shape(t)]:
            kind = declared[name]
            if "INT" in kind:
                spark_type = LongType()
            elif any(k in kind for k in ("REAL", "FLOA", "DOUB")):
                spark_type = DoubleType()
            else:
                spark_type = StringType()
            fields.append(StructField(name, spark_type))
        return StructType(fields)

    def reader(self, schema: StructType) -> DataSourceReader:
        return GeoPackageReader(schema, self.options)


def _is_shape(kind: str) -> bool:
    return "BLOB" in kind or "POINT" in kind or "LINE" in kind or "POLYGON" in kind or "GEOM" in kind


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoPackageSource)
