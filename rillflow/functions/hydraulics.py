"""Channel geometry and routing coefficients as column expressions.

Everything here stays inside generated code: power-law channel width, Manning's
equation for depth and velocity, kinematic celerity and Muskingum coefficients.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical bounds of the scheme
MINIMUMS = {"discharge": 1e-4, "slope": 1e-3, "velocity": 0.01, "depth": 0.01, "bottom_width": 0.01}
PARAMETER_RANGES = {"n": (0.015, 0.25), "q_spatial": (0.0, 1.0), "p_spatial": (1.0, 200.0)}
LOG_SPACE = ("p_spatial",)
DEFAULT_P_SPATIAL = 21.0
MAX_VELOCITY = 15.0
SIDE_SLOPE_BOUNDS = (0.5, 50.0)
DEFAULT_X = 0.3
STEP_SECONDS = 3600.0


def at_least(col: Column, bound: float) -> Column:
    """Lower clamp that keeps NULL (``greatest`` alone would skip it)."""
    return F.when(col.isNotNull(), F.greatest(col, F.lit(float(bound))))


def between(col: Column, low: float, high: float) -> Column:
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(float(low))), F.lit(float(high))))


def denormalize(unit: Column, bounds: tuple[float, float], log_space: bool = False) -> Column:
    """Map a value in [0, 1] to its physical range, optionally in log space."""
    low, high = bounds
    if not log_space:
        return unit * F.lit(float(high - low)) + F.lit(float(low))
    base = math.log(low + 1e-6)
    return F.exp(unit * F.lit(math.log(high) - base) + F.lit(base))


@dataclass(frozen=True)
class Physics:
    """Ranges of the learned parameters, which of them live in log space, and defaults of those not learned."""

    ranges: dict = field(default_factory=lambda: dict(PARAMETER_RANGES))
    log_space: tuple[str, ...] = LOG_SPACE
    defaults: dict = field(default_factory=lambda: {"p_spatial": DEFAULT_P_SPATIAL})


def physical_parameters(n: Column, q_spatial: Column, p_spatial: Column | None, physics: Physics | None = None) -> dict[str, Column]:
    """Denormalise the three learned parameters; a missing ``p`` takes its default."""
    physics = physics or Physics()
    out = {}
    for name, unit in (("n", n), ("q_spatial", q_spatial), ("p_spatial", p_spatial)):
        if unit is None:
            out[name] = F.lit(float(physics.defaults[name]))
        else:
            out[name] = denormalize(unit, physics.ranges[name], name in physics.log_space)
    return out


def trapezoid(
    n: Column,
    p_spatial: Column,
    q_spatial: Column,
    discharge: Column,
    slope: Column,
    depth_min: float = MINIMUMS["depth"],
    bottom_min: float = MINIMUMS["bottom_width"],
) -> dict[str, Column]:
    """Cross-section of a trapezoidal channel carrying ``discharge``."""
    q = q_spatial + F.lit(1e-6)
    ratio = discharge * n * (q + 1) / (p_spatial * F.sqrt(slope) + F.lit(1e-8))
    depth = at_least(F.pow(ratio, F.lit(3.0) / (F.lit(5.0) + q * 3.0)), depth_min)
    top = p_spatial * F.pow(depth, q)
    side = between(top * q / (depth * 2.0), *SIDE_SLOPE_BOUNDS)
    return _section(n, slope, depth, top, side, bottom_min)


def _section(n: Column, slope: Column, depth: Column, top: Column, side: Column, bottom_min: float):
    bottom = at_least(top - side * depth * 2.0, bottom_min)
    area = (top + bottom) * depth / 2.0
    perimeter = bottom + depth * 2.0 * F.sqrt(side * side + 1.0)
    radius = area / perimeter
    velocity = F.lit(1.0) / n * F.pow(radius, F.lit(2.0 / 3.0)) * F.sqrt(slope)
    return {
        "depth": depth,
        "top_width": top,
        "bottom_width": bottom,
        "side_slope": side,
        "cross_sectional_area": area,
        "wetted_perimeter": perimeter,
        "hydraulic_radius": radius,
        "velocity": velocity,
    }


def observed_or(observed: Column, derived: Column) -> Column:
    """Measured geometry where it exists, derived geometry elsewhere."""
    return F.coalesce(F.nanvl(observed, F.lit(None).cast("double")), derived)


def flow_speed(
    n: Column, slope: Column, depth: Column, top: Column, side: Column, bottom_min: float = MINIMUMS["bottom_width"]
) -> Column:
    """Velocity of a section whose width and side slope are given, within [0, 15] m/s."""
    return between(_section(n, slope, depth, top, side, bottom_min)["velocity"], 0.0, MAX_VELOCITY)


def celerity(velocity: Column, velocity_min: float = MINIMUMS["velocity"]) -> Column:
    return between(velocity, velocity_min, MAX_VELOCITY) * F.lit(5.0) / F.lit(3.0)


def muskingum(length: Column, wave_speed: Column, x: Column, dt: float = STEP_SECONDS) -> dict[str, Column]:
    """Weights of upstream outflow now and before, own storage, and lateral inflow."""
    k = length / wave_speed
    dt_ = F.lit(float(dt))
    storage = k * 2.0 * (F.lit(1.0) - x)
    wedge = k * 2.0 * x
    total = storage + dt_
    return {
        "c1": (dt_ - wedge) / total,
        "c2": (dt_ + wedge) / total,
        "c3": (storage - dt_) / total,
        "c4": dt_ * 2.0 / total,
    }


def log_base(x: Column, base: float) -> Column:
    return F.ln(x) / F.lit(math.log(base))
