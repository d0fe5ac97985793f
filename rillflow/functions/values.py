"""Row-wise cleaning, unit and scaling expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units and floors
FT3_TO_M3 = 0.0283168
MISSING_INFLOW = 0.001
FLOW_FLOOR = 1e-6
AREA_FLOOR_SQKM = 100.0


def null_if_nan(col: Column) -> Column:
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def is_finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def finite_or_null(col: Column) -> Column:
    return F.when(is_finite(col), col)


def ft3_to_m3(col: Column) -> Column:
    return col * F.lit(FT3_TO_M3)


def mm_day_to_m3s(depth: Column, area_sqkm: Column) -> Column:
    """Runoff depth over a catchment as a volume per second."""
    return depth * area_sqkm * F.lit(1000.0) / F.lit(86400.0)


def floored_flow(col: Column) -> Column:
    """Missing becomes the floor; everything else is clipped from below."""
    floor = F.lit(FLOW_FLOOR)
    return F.greatest(F.coalesce(null_if_nan(col), floor), floor)


def patched_flow(col: Column) -> Column:
    """Missing, infinite and zero become the floor; negatives stay."""
    return F.when(is_finite(col) & (col != 0), col).otherwise(F.lit(FLOW_FLOOR))


def inflow_or_default(col: Column) -> Column:
    return F.coalesce(col, F.lit(MISSING_INFLOW))


def flow_scale(drain: Column, reach_drain: Column, unit: Column) -> Column:
    """Share of the unit catchment that lies above the gauge, 1 where it cannot be told."""
    d, r, u = (null_if_nan(c) for c in (drain, reach_drain, unit))
    gap = d - r
    usable = gap.isNotNull() & (u > 0) & (gap < 0) & (F.abs(gap) < u)
    return F.when(usable, (u - F.abs(gap)) / u).otherwise(F.lit(1.0))


def area_gap(drain: Column, reach_drain: Column) -> Column:
    return F.abs(drain - reach_drain)


def area_gap_valid(gap: Column, unit: Column) -> Column:
    """True when the gap is within the larger of the unit area and 100 km2."""
    g, u = null_if_nan(gap), null_if_nan(unit)
    return F.coalesce(g <= F.when(u.isNotNull(), F.greatest(u, F.lit(AREA_FLOOR_SQKM))), F.lit(False))


def zscore(col: Column, mean: Column, std: Column) -> Column:
    return F.try_divide(col - mean, std)


def clip(col: Column, low: float, high: float) -> Column:
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(float(low))), F.lit(float(high))))
