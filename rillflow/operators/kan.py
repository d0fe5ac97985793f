"""Small spline network that maps catchment attributes to channel parameters.

A linear layer, layers whose every connection is a learned function
``base * silu(x) + scale * sum(c_b * B_b(x))`` with B-splines B on a fixed grid, a linear
layer and a sigmoid (Liu et al. 2024). Evaluation runs as a vectorised UDF; the weights,
whose size depends on the network only, travel with the task.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class KanShape:
    inputs: tuple[str, ...]
    outputs: tuple[str, ...] = ("n", "q_spatial")
    hidden: int = 11
    layers: int = 1
    grid: int = 3
    k: int = 3


def knots(shape: KanShape) -> np.ndarray:
    """Uniform grid on [-1, 1], extended by k intervals on both sides."""
    h = 2.0 / shape.grid
    return -1.0 + h * np.arange(-shape.k, shape.grid + shape.k + 1)


def splines(x: np.ndarray, t: np.ndarray, k: int) -> np.ndarray:
    """Cox-de Boor recursion; the last axis holds the basis functions."""
    x = x[..., None]
    basis = ((x >= t[:-1]) & (x < t[1:])).astype(float)
    for p in range(1, k + 1):
        left = (x - t[: -p - 1]) / (t[p:-1] - t[: -p - 1]) * basis[..., :-1]
        right = (t[p + 1 :] - x) / (t[p + 1 :] - t[1:-p]) * basis[..., 1:]
        basis = left + right
    return basis


def spline_slopes(x: np.ndarray, t: np.ndarray, k: int) -> np.ndarray:
    if k == 0:
        return np.zeros((*x.shape, len(t) - 1))
    low = splines(x, t, k - 1)
    h = t[1] - t[0]
    return (low[..., :-1] - low[..., 1:]) / h


def initial_weights(shape: KanShape, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    n_in, h, n_out, nb = len(shape.inputs), shape.hidden, len(shape.outputs), shape.grid + shape.k
    w = {
        "in_w": rng.normal(0, np.sqrt(2.0 / n_in), (h, n_in)),
        "in_b": np.zeros(h),
        "out_w": rng.normal(0, 0.1 * np.sqrt(2.0 / (h + n_out)), (n_out, h)),
        "out_b": np.zeros(n_out),
    }
    for i in range(shape.layers):
        w[f"base_{i}"] = rng.normal(0, 1.0 / np.sqrt(h), (h, h))
        w[f"scale_{i}"] = np.ones((h, h)) / np.sqrt(h)
        w[f"coef_{i}"] = rng.uniform(-0.5, 0.5, (h, h, nb)) * 0.3 / shape.grid
    return w


def _silu(x):
    s = 1.0 / (1.0 + np.exp(-x))
    return x * s, s * (1.0 + x * (1.0 - s))


def forward(shape: KanShape, w: dict[str, np.ndarray], x: np.ndarray):
    """Outputs in (0, 1), one column per learned parameter, and what the gradient needs."""
    t = knots(shape)
    a = x @ w["in_w"].T + w["in_b"]
    tape = []
    for i in range(shape.layers):
        act, slope = _silu(a)
        basis = splines(a, t, shape.k)
        mix = w[f"scale_{i}"][..., None] * w[f"coef_{i}"]
        tape.append((a, act, slope, basis))
        a = act @ w[f"base_{i}"].T + np.einsum("nib,oib->no", basis, mix)
    y = 1.0 / (1.0 + np.exp(-(a @ w["out_w"].T + w["out_b"])))
    return y, (x, tape, a)


def backward(shape: KanShape, w: dict[str, np.ndarray], x: np.ndarray, grad_y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of sum(grad_y * outputs) with respect to every weight."""
    y, (x, tape, last) = forward(shape, w, x)
    t = knots(shape)
    g = grad_y * y * (1.0 - y)
    out = {"out_w": g.T @ last, "out_b": g.sum(axis=0)}
    g = g @ w["out_w"]
    for i in reversed(range(shape.layers)):
        a, act, slope, basis = tape[i]
        scale, coef = w[f"scale_{i}"], w[f"coef_{i}"]
        out[f"base_{i}"] = g.T @ act
        by_basis = np.einsum("no,nib->oib", g, basis)
        out[f"scale_{i}"] = (by_basis * coef).sum(axis=-1)
        out[f"coef_{i}"] = by_basis * scale[..., None]
        bent = np.einsum("nib,oib->noi", spline_slopes(a, t, shape.k), scale[..., None] * coef)
        g = (g @ w[f"base_{i}"]) * slope + np.einsum("no,noi->ni", g, bent)
    out["in_w"] = g.T @ x
    out["in_b"] = g.sum(axis=0)
    return out


def predict(df: DataFrame, shape: KanShape, weights: dict[str, np.ndarray], key: str = "reach_id") -> DataFrame:
    """``key`` and one column in (0, 1) per learned parameter, from standardised attributes."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in shape.outputs])

    @F.pandas_udf(schema)
    def evaluate(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({n: pd.Series(dtype=float) for n in shape.outputs})
        y, _ = forward(shape, weights, np.stack(x.to_numpy()).astype(float))
        return pd.DataFrame(y, columns=list(shape.outputs))

    # a missing input is an error: 0 would silently be the mean of the training set
    lack = lambda n: F.raise_error(F.concat(F.lit(f"no value of {n} for "), F.col(key).cast("string"))).cast("double")
    values = F.array(*[F.coalesce(F.col(n).cast("double"), lack(n)) for n in shape.inputs])
    return df.select(key, evaluate(values).alias("_y")).select(key, "_y.*")


def weight_gradients(df: DataFrame, shape: KanShape, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Summed gradient of the loss over all reaches.

    ``df`` has the attributes and, per output, ``g_<output>`` = derivative of the loss by that
    output. Each task adds up its reaches; what reaches the driver is as large as the weights.
    """
    names = sorted(weights)

    def partial_sums(batches):
        total = None
        for pdf in batches:
            if not len(pdf):
                continue
            x = pdf[list(shape.inputs)].fillna(0.0).to_numpy(float)
            g = pdf[[f"g_{n}" for n in shape.outputs]].to_numpy(float)
            grads = backward(shape, weights, x, g)
            flat = np.concatenate([grads[n].ravel() for n in names])
            total = flat if total is None else total + flat
        if total is not None:
            yield pd.DataFrame({"pos": np.arange(len(total)), "g": total})

    wanted = df.select(*shape.inputs, *[f"g_{n}" for n in shape.outputs])
    sums = wanted.mapInPandas(partial_sums, "pos bigint, g double").groupBy("pos").agg(F.sum("g").alias("g")).collect()
    flat = np.zeros(sum(weights[n].size for n in names))
    for r in sums:
        flat[r.pos] = r.g
    out, at = {}, 0
    for n in names:
        out[n] = flat[at : at + weights[n].size].reshape(weights[n].shape)
        at += weights[n].size
    return out


@dataclass
class Adam:
    """Adam with the usual constants; the state is as large as the weights."""

    rate: float = 1e-3
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    t: int = 0
    m: dict | None = None
    v: dict | None = None

    def step(self, weights, grads):
        if self.m is None:
            self.m = {k: np.zeros_like(g) for k, g in grads.items()}
            self.v = {k: np.zeros_like(g) for k, g in grads.items()}
        self.t += 1
        out = {}
        for k, g in grads.items():
            self.m[k] = self.beta1 * self.m[k] + (1 - self.beta1) * g
            self.v[k] = self.beta2 * self.v[k] + (1 - self.beta2) * g * g
            m, v = self.m[k] / (1 - self.beta1**self.t), self.v[k] / (1 - self.beta2**self.t)
            out[k] = weights[k] - self.rate * m / (np.sqrt(v) + self.eps)
        return out


def clip_norm(grads: dict[str, np.ndarray], limit: float = 1.0) -> dict[str, np.ndarray]:
    norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
    factor = min(1.0, limit / (norm + 1e-6))
    return {k: g * factor for k, g in grads.items()}


def save_checkpoint(spark: SparkSession, path: str, shape: KanShape, weights, adam: Adam, epoch: int, batch: int, seed: int):
    """One-row parquet with weights, optimiser state and position in the training run."""

    def plain(d):
        return None if d is None else {k: v.tolist() for k, v in d.items()}

    body = {
        "shape": {**shape.__dict__},
        "weights": plain(weights),
        "adam": {"rate": adam.rate, "t": adam.t, "m": plain(adam.m), "v": plain(adam.v)},
        "seed": seed,
    }
    row = spark.createDataFrame([(epoch, batch, json.dumps(body))], "epoch int, mini_batch int, body string")
    row.coalesce(1).write.mode("errorifexists").parquet(path)


def load_checkpoint(spark: SparkSession, path: str):
    """``(shape, weights, adam, epoch, mini_batch, seed)``."""
    row = spark.read.parquet(path).head()
    body = json.loads(row.body)

    def arrays(d):
        return None if d is None else {k: np.array(v) for k, v in d.items()}

    s = body["shape"]
    shape = KanShape(tuple(s["inputs"]), tuple(s["outputs"]), s["hidden"], s["layers"], s["grid"], s["k"])
    a = body["adam"]
    adam = Adam(rate=a["rate"], t=a["t"], m=arrays(a["m"]), v=arrays(a["v"]))
    return shape, arrays(body["weights"]), adam, row.epoch, row.mini_batch, body["seed"]


def latest_checkpoint(spark: SparkSession, folder: str) -> str:
    """Most recently written checkpoint below ``folder``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    if not len(found):
        raise FileNotFoundError(folder)
    return max((f.getModificationTime(), f.getPath().toString()) for f in found)[1]


def learning_rate(schedule: dict[int, float], epoch: int) -> float:
    """Rate of the epoch, else of the nearest earlier entry, else the first one."""
    earlier = [e for e in schedule if e <= epoch]
    return schedule[max(earlier)] if earlier else schedule[min(schedule)]
