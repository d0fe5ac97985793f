"""The distributed gradient against finite differences of the distributed loss, and a falling loss."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from rillflow.operators import cleaning, kan
from rillflow.plans import problem as prob
from rillflow.plans.training import Trainer


class Source:
    def __init__(self, spark, days=8, m=24, seed=5):
        rng = np.random.default_rng(seed)
        down = [None] + [int(rng.integers(max(0, i - 6), i)) for i in range(1, m)]
        self._flow = spark.createDataFrame([(i, d) for i, d in enumerate(down)], "reach_id bigint, down_id bigint")
        self._reaches = spark.createDataFrame(
            [(i, float(rng.uniform(2000, 9000)), float(rng.uniform(0.001, 0.01)), 0.25) for i in range(m)],
            "reach_id bigint, length_m double, slope double, x double",
        )
        self._attributes = spark.createDataFrame(
            [(i, *map(float, rng.normal(size=2))) for i in range(m)], "reach_id bigint, a double, b double"
        )
        self._inflow = spark.createDataFrame(
            [(i, datetime(2024, 1, 1) + timedelta(days=d), float(rng.gamma(1.0, 3.0))) for i in range(m) for d in range(days)],
            "reach_id bigint, ts timestamp_ntz, qr double",
        )
        self._gauges = spark.createDataFrame([("00000000", 0), ("00000002", 2)], "staid string, reach_id bigint")
        self._obs = spark.createDataFrame(
            [(g, date(2024, 1, 1) + timedelta(days=d), float(rng.uniform(5, 60))) for g in ("00000000", "00000002") for d in range(days)],
            "staid string, d date, streamflow double",
        )

    def flow(self):
        return self._flow

    def reaches(self):
        return self._reaches

    def attributes(self):
        return self._attributes

    def inflow(self):
        return self._inflow

    def gauges(self):
        return self._gauges

    def observations(self):
        return self._obs


@pytest.fixture(scope="module")
def setup(spark):
    source = Source(spark)
    problem = prob.build_problem(
        source, date(2024, 1, 1), date(2024, 1, 8), chunk_hours=168, hold=24, batch=source.gauges(), limit=6
    )
    stats = cleaning.attribute_statistics(source.attributes(), ["a", "b"])
    return source, problem, stats


def test_gradient_matches_finite_differences(setup):
    source, problem, stats = setup
    shape = kan.KanShape(("a", "b"), ("n", "q_spatial", "p_spatial"), hidden=4, grid=3, k=2)
    weights = kan.initial_weights(shape, 1)
    args = (problem, source.attributes(), stats, source.inflow(), source.observations())
    trainer = Trainer(shape, weights, kan.Adam(), warmup=1)
    _, grads = trainer.loss_and_gradient(*args)
    for name, pos in (("out_b", 2),):
        values, loss = weights[name].reshape(-1), []
        keep = values[pos]
        for sign in (1, -1):
            values[pos] = keep + sign * 1e-4
            loss.append(trainer.loss_and_gradient(*args)[0])
        values[pos] = keep
        assert grads[name].reshape(-1)[pos] == pytest.approx((loss[0] - loss[1]) / 2e-4, rel=5e-3, abs=1e-6)


def test_loss_falls_and_checkpoint_round_trips(spark, setup, tmp_path):
    source, problem, stats = setup
    shape = kan.KanShape(("a", "b"), ("n", "q_spatial", "p_spatial"), hidden=4)
    trainer = Trainer(shape, kan.initial_weights(shape, 2), kan.Adam(rate=0.05), warmup=1)
    args = (problem, source.attributes(), stats, source.inflow(), source.observations())
    losses = [trainer.step(*args) for _ in range(4)]
    assert losses[-1] < losses[0]
    path = str(tmp_path / "checkpoint")
    kan.save_checkpoint(spark, path, shape, trainer.weights, trainer.adam, 1, 3, 2)
    shape2, weights, adam, epoch, batch, seed = kan.load_checkpoint(spark, path)
    assert (shape2, epoch, batch, seed, adam.t) == (shape, 1, 3, 2, 4)
    for k, v in trainer.weights.items():
        np.testing.assert_array_equal(weights[k], v)
