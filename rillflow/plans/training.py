"""Training of the parameter network through the routing scheme.

Forward pass, loss and backward pass are Spark jobs over the same pieces: gradients move
from the outlet stages to the headwater stages. The driver only sees the loss and a
gradient as large as the network's weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import timedelta
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.operators import cleaning, kan
from rillflow.operators.adjoint import DIRECTIONS, pull_back
from rillflow.operators.gauges import complete_gauges
from rillflow.operators.kernel import Scheme, advance, first_state
from rillflow.operators.layout import stage_tasks
from rillflow.operators.resample import trimmed_slice
from rillflow.operators.routing import (
    BOUNDARY,
    INFLOW,
    pack_inflow,
    read_boundary,
    read_bundle,
    read_inflow,
    runs,
    static_rows,
)
from rillflow.plans.problem import RoutingProblem, channel_parameters, gauge_daily, predict_parameters
from rillflow.scratch import by_key, scratch_path, store

LOSS, RETURNED = 3, 4
GRADIENT, SENT = 10, 11
IN = ("bundle", "chunk", "kind", "reach_id", "ints", "a", "b")
OUT_SCHEMA = "kind int, to_stage int, reach_id bigint, chunk int, a array<double>, b array<double>"


def gradient_rows(batches: Iterator[pd.DataFrame], scheme: Scheme) -> Iterator[pd.DataFrame]:
    """Task side of the backward pass: rerun the pieces, then go through them in reverse."""
    b = None
    for _, chunk, part in runs(batches):
        if chunk < 0:
            if b is not None:
                yield from _reverse(b, None, scheme)
            b = read_bundle(part)
        else:
            yield from _reverse(b, part, scheme)
            b = None
    if b is not None:
        yield from _reverse(b, None, scheme)


def _dense(b, part, kind, n):
    x, q = np.zeros((n, b.size)), np.zeros((n, b.size))
    rows = part[part["kind"] == kind] if part is not None else ()
    for r, xs, qs in zip(rows["reach_id"], rows["a"], rows["b"], strict=True) if len(rows) else ():
        x[:, b.position[int(r)]] += xs
        q[:, b.position[int(r)]] += qs
    return x, q


def _reverse(b, part, scheme):
    n = scheme.n_hours
    inflow, (ax, aq) = read_inflow(b, part, n, scheme), read_boundary(b, part, n)
    raw, q0 = first_state(b, inflow[0], ax[0], scheme)
    x, q = advance(b, inflow, ax, aq, q0, scheme, raw)
    grad = np.zeros((n, b.size))
    rows = part[part["kind"] == LOSS] if part is not None else ()
    for r, offs, g, width in zip(rows["reach_id"], rows["ints"], rows["a"], rows["b"], strict=True) if len(rows) else ():
        # derivatives by daily means, spread over the hours that each mean covers
        col = b.position[int(r)]
        for o, v, w in zip(offs, g, width, strict=True):
            grad[o : o + int(w), col] += v / w
    # what came back for a downstream reach goes to every reach of this bundle that drains into it
    back_x, back_q = np.zeros((n, b.size)), np.zeros((n, b.size))
    rows = part[part["kind"] == RETURNED] if part is not None else ()
    if len(rows):
        draining: dict[int, list[int]] = {}
        for i in np.flatnonzero(b.out_down >= 0):
            draining.setdefault(int(b.out_down[i]), []).append(i)
        for r, xs, qs in zip(rows["reach_id"], rows["a"], rows["b"], strict=True):
            for i in draining.get(int(r), ()):
                back_x[:, i] += xs
                back_q[:, i] += qs
    out, sx, sq = pull_back(b, inflow, ax, aq, x, q, grad, back_x, back_q, scheme)
    stacked = np.stack([out[d] for d in DIRECTIONS[1:]], axis=1)
    types = {"kind": "int32", "to_stage": "int32", "chunk": "int32"}
    yield pd.DataFrame(
        {"kind": GRADIENT, "to_stage": -1, "reach_id": b.ids, "chunk": 0, "a": list(stacked), "b": None}
    ).astype(types)
    fed = sorted({b.position[int(r)] for r in part.loc[part["kind"] == BOUNDARY, "reach_id"]}) if part is not None else []
    if fed:
        yield pd.DataFrame(
            {"kind": SENT, "to_stage": -1, "reach_id": b.ids[fed], "chunk": 0, "a": list(sx[:, fed].T), "b": list(sq[:, fed].T)}
        ).astype(types)


def _forward_rows(batches, scheme):
    from rillflow.operators.routing import route_rows

    return route_rows(batches, scheme)


class Trainer:
    """One problem (a batch of gauges in one window) at a time."""

    def __init__(self, shape: kan.KanShape, weights, adam: kan.Adam, tau: int = 3, warmup: int = 3):
        self.shape, self.weights, self.adam = shape, weights, adam
        self.tau, self.warmup = tau, warmup

    def loss_and_gradient(self, problem: RoutingProblem, attributes: DataFrame, stats: DataFrame, inflow: DataFrame, obs: DataFrame):
        spark = problem.flow.sparkSession
        scheme = problem.scheme
        if scheme.chunk < scheme.n_hours:
            raise ValueError("training needs the whole window in one chunk")
        unit = store(predict_parameters(problem, attributes, stats, self.shape, self.weights), "unit")
        params = channel_parameters(problem, unit).withColumn("slope", F.greatest("slope", F.lit(scheme.slope_min)))
        tasks = stage_tasks(problem.plan)
        if "flow_scale" not in params.columns:
            params = params.withColumn("flow_scale", F.lit(1.0))
        work, root = self._forward(problem, params, inflow, tasks)
        routed = (
            spark.read.schema(f"{OUT_SCHEMA}, stage int")
            .parquet(root)
            .filter("kind = 0")
            .select("reach_id", "chunk", F.col("a").alias("q"))
        )
        # the training form trims a fixed number of hours at the start
        daily = store(gauge_daily(problem, routed, self.tau, start_offset=13), "pred")
        first = (problem.start + timedelta(days=1 + self.warmup)).date()
        good = complete_gauges(self._window(problem, obs))
        pairs = (
            daily.join(by_key(good), "staid", "left_semi")
            .join(by_key(obs.select("staid", "d", F.col("streamflow").alias("obs"))), ["staid", "d"])
            .filter(F.col("d") >= F.lit(first))
        )
        row = pairs.agg(F.avg(F.abs(F.col("pred") - F.col("obs"))).alias("loss"), F.count("*").alias("n")).head()
        if not row.n:
            raise ValueError("no gauge of the batch has complete observations in the window")
        low, high = trimmed_slice(scheme.n_hours, self.tau, 13)
        bins = (high - low) // 24
        day = F.date_diff("d", F.lit((problem.start + timedelta(days=1)).date()))
        # the daily means need not cover whole days: the trimmed series is cut into equal bins
        opens = F.floor(day * F.lit(high - low) / F.lit(bins))
        width = F.ceil((day + 1) * F.lit(high - low) / F.lit(bins)) - opens
        sign = F.signum(F.col("pred") - F.col("obs")) / F.lit(float(row.n))
        by_reach = (
            pairs.select("staid", (opens + low).cast("long").alias("_o"), width.cast("double").alias("_w"), sign.alias("_g"))
            .join(by_key(problem.outflow), "staid")
            .groupBy("reach_id", "_o", "_w")
            .agg(F.sum("_g").alias("_g"))
            .groupBy("reach_id")
            .agg(F.sort_array(F.collect_list(F.struct("_o", "_w", "_g"))).alias("_s"))
        )
        seeds = by_reach.select(
            "reach_id", F.col("_s._o").alias("ints"), F.col("_s._g").alias("a"), F.col("_s._w").alias("b")
        )
        grads = self._backward(problem, tasks, work, root, seeds)
        return row.loss, self._network_gradient(problem, attributes, stats, unit, params, grads)

    def _window(self, problem, obs):
        """Observations of the window on a full calendar, so that absent days count as missing."""
        days = problem.scheme.n_hours // 24
        first = F.lit(problem.start.date())
        each = problem.gauges.select("staid", F.explode(F.sequence(F.lit(1), F.lit(max(1, days - 1)))).alias("_i"))
        grid = each.select("staid", F.date_add(first, F.col("_i")).alias("d"))
        return grid.join(by_key(obs.select("staid", "d", "streamflow")), ["staid", "d"], "left")

    def _forward(self, problem, params, inflow, tasks):
        placed = problem.plan
        empty = F.lit(None).cast("array<double>")
        rows = placed.join(by_key(params), "reach_id", "left").withColumn("start", F.lit(None).cast("double"))
        static = static_rows(rows, problem.outflow)
        packed = pack_inflow(inflow, problem.start, problem.scheme).join(by_key(placed.select("reach_id", "stage", "bundle")), "reach_id")
        lateral = packed.select(
            "stage", "bundle", "chunk", F.lit(INFLOW).alias("kind"), "reach_id", "ints", "a", empty.alias("b")
        )
        work = store(static.unionByName(lateral), "work", ["stage"])
        root = scratch_path(work.sparkSession, "forward")
        for stage, n_bundles in tasks:
            todo = work.filter(F.col("stage") == stage).select(*IN)
            if stage > 0:
                todo = todo.unionByName(self._arrived(work.sparkSession, root, placed, stage))
            self._run(todo, n_bundles, partial(_forward_rows, scheme=problem.scheme), f"{root}/stage={stage}")
        return work, root

    def _arrived(self, spark, root, placed, stage):
        rows = spark.read.schema(f"{OUT_SCHEMA}, stage int").parquet(root)
        rows = rows.filter((F.col("kind") == 1) & (F.col("to_stage") == stage))
        return rows.join(by_key(placed.select("reach_id", "bundle")), "reach_id").select(
            "bundle", "chunk", F.lit(BOUNDARY).alias("kind"), "reach_id", F.lit(None).cast("array<bigint>").alias("ints"), "a", "b"
        )

    @staticmethod
    def _run(todo, n, step, path):
        todo.repartitionById(n, F.col("bundle")).sortWithinPartitions("bundle", "chunk", "kind", "reach_id").mapInPandas(
            step, OUT_SCHEMA
        ).write.partitionBy("kind", "to_stage").parquet(path)

    def _backward(self, problem, tasks, work, forward_root, seeds) -> DataFrame:
        placed = problem.plan
        spark = work.sparkSession
        root = scratch_path(spark, "backward")
        seeded = store(
            seeds.join(by_key(placed.select("reach_id", "stage", "bundle")), "reach_id").select(
                "stage", "bundle", F.lit(0).alias("chunk"), F.lit(LOSS).alias("kind"), "reach_id", "ints", "a", "b"
            ),
            "seeds",
        )
        feeders = store(placed.filter("out_down IS NOT NULL").select("stage", "bundle", F.col("out_down").alias("reach_id")).distinct(), "feeders")
        done = False
        for stage, n_bundles in reversed(tasks):
            todo = work.filter(F.col("stage") == stage).select(*IN)
            todo = todo.unionByName(seeded.filter(F.col("stage") == stage).select(*IN))
            if stage > 0:
                todo = todo.unionByName(self._arrived(spark, forward_root, placed, stage))
            if done:
                sent = spark.read.schema(f"{OUT_SCHEMA}, stage int").parquet(root).filter(F.col("kind") == SENT)
                back = sent.drop("stage").join(by_key(feeders.filter(F.col("stage") == stage)), "reach_id").select(
                    "bundle", "chunk", F.lit(RETURNED).alias("kind"), "reach_id",
                    F.lit(None).cast("array<bigint>").alias("ints"), "a", "b",
                )
                todo = todo.unionByName(back)
            self._run(todo, n_bundles, partial(gradient_rows, scheme=problem.scheme), f"{root}/stage={stage}")
            done = True
        grads = spark.read.schema(f"{OUT_SCHEMA}, stage int").parquet(root).filter(F.col("kind") == GRADIENT)
        return grads.select("reach_id", *[F.col("a")[i].alias(f"d_{n}") for i, n in enumerate(DIRECTIONS[1:])])

    def _network_gradient(self, problem, attributes, stats, unit, params, grads):
        names = list(self.shape.inputs)
        joined = cleaning.join_attributes(problem.plan.select("reach_id"), attributes, names)
        scores = cleaning.fill_and_standardize(joined, stats, names)
        # clamping the slope has no effect on the learned parameters
        by_unit = []
        for name in self.shape.outputs:
            low, high = problem.physics.ranges[name]
            if name in problem.physics.log_space:
                factor = F.col(name) * F.lit(math.log(high) - math.log(low + 1e-6))
            else:
                factor = F.lit(high - low)
            by_unit.append((F.col(f"d_{name}") * factor).alias(f"g_{name}"))
        physical = params.select("reach_id", *[n for n in self.shape.outputs])
        local = grads.join(by_key(physical), "reach_id").select("reach_id", *by_unit)
        return kan.weight_gradients(scores.join(by_key(local), "reach_id"), self.shape, self.weights)

    def step(self, problem, attributes, stats, inflow, obs, rate: float | None = None) -> float:
        """One optimiser step; returns the loss before it."""
        loss, grads = self.loss_and_gradient(problem, attributes, stats, inflow, obs)
        if rate is not None:
            self.adam.rate = rate
        self.weights = self.adam.step(self.weights, kan.clip_norm(grads, 1.0))
        return loss


