"""Derivatives of the routing scheme, per piece, in reverse order of the forward pass."""

from __future__ import annotations

import numpy as np

from rillflow.operators.kernel import GEOMETRY_EPS, Bundle, Scheme, channel

DIRECTIONS = ("q", "n", "p_spatial", "q_spatial")


def weight_slopes(q, v, s: Scheme):
    """Weights and, per direction, their derivatives (zero where a bound is active)."""
    n, p, e, slope = v["n"], v["p_spatial"], v["q_spatial"] + GEOMETRY_EPS, v["slope"]
    root = np.sqrt(slope)
    depth, top, side, speed = channel(q, v, s)
    ratio = q * n * (e + 1) / (p * root + 1e-8)
    power = 3.0 / (5.0 + 3.0 * e)
    free_depth = (ratio**power > s.depth_min).astype(float)
    raw_side = top * e / (2 * depth)
    free_side = ((raw_side > s.side_bounds[0]) & (raw_side < s.side_bounds[1])).astype(float)
    free_bottom = (top - 2 * side * depth > s.bottom_min).astype(float)
    bottom = np.maximum(top - 2 * side * depth, s.bottom_min)
    slant = np.sqrt(1 + side * side)
    area, wet = (top + bottom) * depth / 2, bottom + 2 * depth * slant
    free_speed = ((speed > s.velocity_min) & (speed < s.velocity_max)).astype(float)
    wave = np.clip(speed, s.velocity_min, s.velocity_max) * 5.0 / 3.0

    k, x = v["length_m"] / wave, v["x"]
    store, wedge = 2 * k * (1 - x), 2 * k * x
    total = store + s.dt
    c = ((s.dt - wedge) / total, (s.dt + wedge) / total, (store - s.dt) / total, 2 * s.dt / total)
    keep = 2 * (1 - x)
    by_k = (
        (-2 * x * total - (s.dt - wedge) * keep) / total**2,
        (2 * x * total - (s.dt + wedge) * keep) / total**2,
        (keep * total - (store - s.dt) * keep) / total**2,
        -2 * s.dt * keep / total**2,
    )
    slopes = {}
    for name in DIRECTIONS:
        de = 1.0 if name == "q_spatial" else 0.0
        log_ratio = {
            "q": 1 / q,
            "n": 1 / n,
            "p_spatial": -root / (p * root + 1e-8),
            "q_spatial": 1 / (e + 1),
        }[name]
        # relative changes of depth and width, then absolute ones of the section
        r_depth = free_depth * (power * log_ratio + de * np.log(ratio) * (-9.0 / (5.0 + 3.0 * e) ** 2))
        r_top = (1 / p if name == "p_spatial" else 0.0) + e * r_depth + de * np.log(depth)
        d_depth, d_top = depth * r_depth, top * r_top
        d_side = free_side * side * (r_top - r_depth + de / e)
        d_bottom = free_bottom * (d_top - 2 * (d_side * depth + side * d_depth))
        d_area = ((d_top + d_bottom) * depth + (top + bottom) * d_depth) / 2
        d_wet = d_bottom + 2 * (d_depth * slant + depth * side * d_side / slant)
        r_speed = 2.0 / 3.0 * (d_area / area - d_wet / wet) - (1 / n if name == "n" else 0.0)
        d_k = -k / wave * free_speed * speed * r_speed * 5.0 / 3.0
        slopes[name] = tuple(b * d_k for b in by_k)
    return c, slopes


def pull_back(b: Bundle, inflow, above_x, above_q, x, q, grad_q, arrive_x, arrive_q, s: Scheme, carried: bool = False):
    """Gradients of a loss on the discharge of one chunk.

    ``grad_q`` is the derivative by the clamped discharge, ``arrive_*`` what later pieces
    send back. Returns derivatives by n, p and q per reach, and what each reach sends to
    its upstream reaches (unclamped, clamped), all as (K+1, reaches).
    """
    steps, m = inflow.shape[0] - 1, b.size
    gx, gq = np.array(arrive_x, dtype=float), grad_q + arrive_q
    send_x, send_q = np.zeros((steps + 1, m)), np.zeros((steps + 1, m))
    lateral = np.maximum(inflow, s.discharge_min)
    out = {name: np.zeros(m) for name in DIRECTIONS[1:]}
    fx, fq, flat = x.reshape(-1), q.reshape(-1), lateral.reshape(-1)
    ax, aq = above_x.reshape(-1), above_q.reshape(-1)
    ggx, ggq, sx, sq = gx.reshape(-1), gq.reshape(-1), send_x.reshape(-1), send_q.reshape(-1)
    here, link = np.arange(m) - b.level * m, b.up - b.level[b.down] * m
    top = int(b.level[-1]) if m else -1
    edges = np.searchsorted(b.level, np.arange(top + 2))
    for d in range(steps + top, 0, -1):
        a, z = edges[max(0, d - steps)], edges[min(top, d - 1) + 1]
        if a == z:
            continue
        i, j = np.searchsorted(b.down, (a, z))
        at, target = here[a:z] + d * m, b.down[i:j] - a
        before, up_at = at - m, link[i:j] + d * m
        terms = (
            np.bincount(target, fx[up_at], z - a) + ax[at],
            np.bincount(target, fq[up_at - m], z - a) + aq[before],
            fq[before],
            flat[before],
        )
        g = ggx[at] + np.where(fx[at] > s.discharge_min, ggq[at], 0.0)
        c, slopes = weight_slopes(fq[before], {k: w[a:z] for k, w in b.values.items()}, s)
        for name in DIRECTIONS[1:]:
            out[name][a:z] += g * sum(dc * t for dc, t in zip(slopes[name], terms, strict=True))
        ggq[before] += g * (c[2] + sum(dc * t for dc, t in zip(slopes["q"], terms, strict=True)))
        sx[at], sq[before] = g * c[0], sq[before] + g * c[1]
        ggx[up_at] += (g * c[0])[target]
        ggq[up_at - m] += (g * c[1])[target]
    if not carried:
        start = gx[0] + np.where(x[0] > s.discharge_min, gq[0], 0.0)
        for lev in range(top, 0, -1):
            a, z = edges[lev], edges[lev + 1]
            i, j = np.searchsorted(b.down, (a, z))
            start[b.up[i:j]] += start[b.down[i:j]]
        send_x[0] += start
    return out, send_x, send_q
