"""Building gauge tables: areas of the reach at a gauge, flags, flow scale, point in polygon."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.values import area_gap, area_gap_valid, flow_scale


def with_reach_areas(gauges: DataFrame, rivers: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Add the upstream area of the gauge's reach, the mismatch, its validity and the flow scale.

    ``rivers`` is ``reach_id, uparea``; ``units`` is ``reach_id, unitarea``.
    """
    out = gauges.join(rivers.select("reach_id", F.col("uparea").alias("comid_drain_sqkm")), "reach_id", "left")
    if units is not None:
        out = out.join(units.select("reach_id", F.col("unitarea").alias("comid_unitarea_sqkm")), "reach_id", "left")
    elif "comid_unitarea_sqkm" not in out.columns:
        out = out.withColumn("comid_unitarea_sqkm", F.lit(None).cast("double"))
    drain, reach, unit = F.col("drain_sqkm"), F.col("comid_drain_sqkm"), F.col("comid_unitarea_sqkm")
    gap = area_gap(drain, reach)
    return out.withColumns(
        {"abs_diff": gap, "da_valid": area_gap_valid(gap, unit), "flow_scale": flow_scale(drain, reach, unit)}
    )


def usable_gauges(gauges: DataFrame) -> DataFrame:
    """Gauges with a reach and an id of at most eight characters."""
    return gauges.filter(F.col("reach_id").isNotNull() & (F.length("staid") <= 8))


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float = 0.25) -> DataFrame:
    """Left join of ``point_id, lon, lat`` with the polygon ``poly_id, ring ARRAY<STRUCT<x, y>>`` around it.

    Each polygon is listed under every grid cell its bounding box touches, so candidates meet by
    an equi-join on the cell; only candidates inside the box are tested, in Arrow batches. A
    point on several polygons takes the smallest id.
    """
    xs = F.transform("ring", lambda p: p["x"])
    ys = F.transform("ring", lambda p: p["y"])
    box = polygons.select(
        "poly_id", xs.alias("xs"), ys.alias("ys"),
        F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"),
    )

    def span(low, high):
        return F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))

    cells = box.select("*", span("x0", "x1").alias("cx")).select("*", span("y0", "y1").alias("cy"))
    located = points.select("point_id", "lon", "lat", F.floor(F.col("lon") / cell).alias("cx"), F.floor(F.col("lat") / cell).alias("cy"))
    near = located.join(cells, ["cx", "cy"]).filter(
        (F.col("lon") >= F.col("x0")) & (F.col("lon") <= F.col("x1")) & (F.col("lat") >= F.col("y0")) & (F.col("lat") <= F.col("y1"))
    )

    @F.pandas_udf("boolean")
    def inside(lon: pd.Series, lat: pd.Series, px: pd.Series, py: pd.Series) -> pd.Series:
        return pd.Series([_within(a, b, x, y) for a, b, x, y in zip(lon, lat, px, py, strict=True)], dtype=bool)

    hits = near.filter(inside("lon", "lat", "xs", "ys")).groupBy("point_id").agg(F.min("poly_id").alias("poly_id"))
    return points.join(hits, "point_id", "left")


def _within(x: float, y: float, px: np.ndarray, py: np.ndarray) -> bool:
    """Even-odd rule along a ray to the right."""
    qx, qy = np.roll(px, -1), np.roll(py, -1)
    crosses = (py > y) != (qy > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = px + (y - py) / (qy - py) * (qx - px)
    return bool((crosses & (x < at)).sum() % 2)
