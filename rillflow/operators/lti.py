"""Linear time-invariant routing for comparison: one unit response per reach.

Uses the stages and pieces of the nonlinear router; only the arithmetic inside a piece
differs. A reach's outflow is the convolution of its response with lateral inflow plus
upstream outflow; what a chunk still has to deliver later is carried over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.operators.kernel import Bundle, Scheme
from rillflow.operators.routing import emit, read_boundary, read_inflow, route_rows

# Response families and their defaults
RESPONSES = ("muskingum", "linear_storage", "nash_cascade", "pure_lag", "hayami")
DEFAULT_K_DAYS = 0.1042
DEFAULT_X = 0.3


def parameter_table(reaches: DataFrame, k=None, x=None, tau=None, delay=None, k_units: str = "seconds") -> DataFrame:
    """``reach_id, k, x, tau, delay`` with times in days; tau and delay follow k when not given.

    Without any parameter the table holds zeros and the default weight.
    """
    if all(c is None for c in (k, x, tau, delay)):
        zero = F.lit(0.0)
        return reaches.select("reach_id", zero.alias("k"), F.lit(DEFAULT_X).alias("x"), zero.alias("tau"), zero.alias("delay"))
    days = None if k is None else (k / F.lit(86400.0) if k_units == "seconds" else k).cast("double")
    cols = {"k": days, "x": x, "tau": tau if tau is not None else days, "delay": delay if delay is not None else days}
    return reaches.select("reach_id", *[c.cast("double").alias(n) for n, c in cols.items() if c is not None])


#: Share of a response that may lie beyond its length.
MOST_BEYOND = 1e-14


def _raw_response(kind: str, k: float, x: float, steps: int, dt: float, stages: int = 2) -> np.ndarray:
    """First ``steps`` values of the response; ``k`` and ``dt`` in the same unit."""
    t = (np.arange(steps) + 0.5) * dt
    if kind == "muskingum":
        total = 2 * k * (1 - x) + dt
        c_now, c_before, c_own = (dt - 2 * k * x) / total, (dt + 2 * k * x) / total, (2 * k * (1 - x) - dt) / total
        h = np.zeros(steps)
        h[0] = c_now
        h[1:] = (c_before + c_own * c_now) * c_own ** np.arange(steps - 1)
    elif kind == "linear_storage":
        edge = np.exp(-np.arange(steps + 1) * dt / k) if k > 0 else np.r_[1.0, np.zeros(steps)]
        h = edge[:-1] - edge[1:]
    elif kind == "nash_cascade":
        scale = max(k / stages, 1e-12)
        h = (t / scale) ** (stages - 1) * np.exp(-t / scale) / (scale * math.gamma(stages)) * dt
    elif kind == "pure_lag":
        lag = k / dt
        h = np.zeros(steps)
        for at, share in ((int(lag), 1 - (lag - int(lag))), (int(lag) + 1, lag - int(lag))):
            if at < steps:
                h[at] += share
    elif kind == "hayami":
        # travel time k, dispersion from the weight x (x = 0.5 is pure translation)
        spread = max((1 - 2 * x), 1e-3) * k / 2
        h = np.sqrt(k * k / (4 * np.pi * spread * t**3)) * np.exp(-((t - k) ** 2) / (4 * spread * t)) * dt
    else:
        raise ValueError(f"unknown response {kind!r}; available: {', '.join(RESPONSES)}")
    return h


def response_steps(kind: str, k: float, x: float, dt: float, stages: int = 2) -> int:
    """Steps after which at most ``MOST_BEYOND`` of the response is left."""
    n = max(8, 2 * math.ceil(k / dt) + 2)
    while True:
        mass = np.abs(_raw_response(kind, k, x, 2 * n, dt, stages))
        if mass[n:].sum() <= MOST_BEYOND / 8 * max(mass.sum(), 1e-300):
            break
        n *= 2
    left = mass[::-1].cumsum()[::-1]
    return int(np.searchsorted(-left, -MOST_BEYOND * left[0], side="left")) or 1


def unit_response(kind: str, k: float, x: float, steps: int | None, dt: float, stages: int = 2) -> np.ndarray:
    """Discrete response that sums to one, as long as it needs to be or of ``steps`` values.

    Raises if ``steps`` would cut off more than ``MOST_BEYOND`` of it.
    """
    needed = response_steps(kind, k, x, dt, stages)
    if steps is None:
        steps = needed
    elif steps < needed:
        raise ValueError(f"{kind} response with k = {k} needs {needed} steps, got {steps}")
    h = _raw_response(kind, k, x, steps, dt, stages)
    mass = h.sum()
    return h / mass if mass else np.r_[1.0, np.zeros(steps - 1)]


class ChunkConvolution:
    """Same task-side interface as the nonlinear router."""

    def __init__(self, b: Bundle, scheme: Scheme, kind: str):
        self.b, self.scheme, self.next = b, scheme, 0
        pairs = list(zip(b.values["length_m"], b.values["x"], strict=True))
        dt_days = scheme.dt / 86400.0
        known = {p: unit_response(kind, *p, None, dt_days) for p in set(pairs)}
        self.memory = memory = max((len(h) for h in known.values()), default=1)
        self.tail = np.zeros((memory - 1, b.size))
        self.response = np.zeros((memory, b.size))
        for i, p in enumerate(pairs):
            self.response[: len(known[p]), i] = known[p]

    def step(self, part: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
        b, s, n = self.b, self.scheme, self.scheme.length(self.next)
        total = read_inflow(b, part, n, s) + read_boundary(b, part, n)[1]
        out = np.zeros((n, b.size))
        size = 1 << int(np.ceil(np.log2(n + self.memory - 1)))
        tail = np.zeros((self.memory - 1, b.size))
        top = int(b.level[-1]) if b.size else -1
        edges = np.searchsorted(b.level, np.arange(top + 2))
        for lev in range(top + 1):
            a, z = edges[lev], edges[lev + 1]
            i, j = np.searchsorted(b.down, (a, z))
            np.add.at(total.T, b.down[i:j], out.T[b.up[i:j]])
            full = np.fft.irfft(
                np.fft.rfft(total[:, a:z], size, axis=0) * np.fft.rfft(self.response[:, a:z], size, axis=0), size, axis=0
            )[: n + self.memory - 1]
            full[: self.memory - 1] += self.tail[:, a:z]
            out[:, a:z] = full[:n]
            tail[: len(full) - n, a:z] = full[n : n + self.memory - 1]
        self.tail = tail
        self.next += 1
        yield from emit(b, self.next - 1, out, out)


def lti_stepper(kind: str):
    """``stepper`` argument of ``route`` for linear routing (``length_m`` holds k in days)."""
    return partial(route_rows, router=partial(ChunkConvolution, kind=kind))


def lti_parameters(reaches: DataFrame, k_days: float = DEFAULT_K_DAYS, x: float = DEFAULT_X) -> DataFrame:
    """Parameter rows of a run with one k and x for all reaches."""
    one = F.lit(1.0)
    return reaches.select(
        "reach_id",
        one.alias("n"),
        one.alias("p_spatial"),
        one.alias("q_spatial"),
        F.lit(float(k_days)).alias("length_m"),
        one.alias("slope"),
        F.lit(float(x)).alias("x"),
    )
