"""Analytic derivatives against central differences."""

import numpy as np
import pytest
from rillflow.operators import kan
from rillflow.operators.adjoint import pull_back
from rillflow.operators.kernel import Scheme, advance, first_state, make_bundle


def case(seed, m=14, hours=30):
    rng = np.random.default_rng(seed)
    down = np.array([-1] + [int(rng.integers(max(0, i - 4), i)) for i in range(1, m)])
    level = np.zeros(m, dtype=int)
    for i in range(m - 1, 0, -1):
        level[down[i]] = max(level[down[i]], level[i] + 1)
    values = {
        "n": rng.uniform(0.02, 0.2, m),
        "p_spatial": rng.uniform(2, 100, m),
        "q_spatial": rng.uniform(0.05, 0.95, m),
        "length_m": rng.uniform(500, 20000, m),
        "slope": rng.uniform(0.001, 0.02, m),
        "x": rng.uniform(0.05, 0.4, m),
    }
    none = np.full(m, -1)
    b = make_bundle(np.arange(m), down, none, none, level, np.zeros(m, dtype=int), values)
    inflow = rng.gamma(0.5, 2.0, (hours, m)) * (rng.random((hours, m)) < 0.6)
    return b, inflow[:, b.ids], rng.normal(size=(hours, m))


def run(b, inflow, above, scheme):
    raw, q0 = first_state(b, inflow[0], above[0][0], scheme)
    return advance(b, inflow, above[0], above[1], q0, scheme, raw)


@pytest.mark.parametrize("seed", [0, 1, 2])
@pytest.mark.parametrize("name", ["n", "p_spatial", "q_spatial"])
def test_scheme_gradient(seed, name):
    b, inflow, grad = case(seed)
    scheme = Scheme(n_hours=30, chunk=30)
    rng = np.random.default_rng(seed + 50)
    above = (rng.uniform(0, 1, inflow.shape), rng.uniform(0, 1, inflow.shape))
    x, q = run(b, inflow, above, scheme)
    zero = np.zeros_like(q)
    got, _, _ = pull_back(b, inflow, *above, x, q, grad, zero, zero, scheme)
    for i in range(b.size):
        keep = b.values[name][i]
        h = 1e-6 * keep
        loss = []
        for sign in (1, -1):
            b.values[name][i] = keep + sign * h
            loss.append((run(b, inflow, above, scheme)[1] * grad).sum())
        b.values[name][i] = keep
        want = (loss[0] - loss[1]) / (2 * h)
        assert got[name][i] == pytest.approx(want, rel=2e-4, abs=2e-4 * max(1.0, abs(want)))


@pytest.mark.parametrize("which", [0, 1])
def test_boundary_gradient(which):
    b, inflow, grad = case(7)
    scheme = Scheme(n_hours=30, chunk=30)
    rng = np.random.default_rng(5)
    above = [rng.uniform(0, 1, inflow.shape), rng.uniform(0, 1, inflow.shape)]
    x, q = run(b, inflow, above, scheme)
    zero = np.zeros_like(q)
    _, *sent = pull_back(b, inflow, *above, x, q, grad, zero, zero, scheme)
    for t, i in [(0, 0), (1, 3), (12, 5), (28, 1), (5, b.size - 1)]:
        loss = []
        for sign in (1, -1):
            moved = [a.copy() for a in above]
            moved[which][t, i] += sign * 1e-6
            loss.append((run(b, inflow, moved, scheme)[1] * grad).sum())
        want = (loss[0] - loss[1]) / 2e-6
        assert sent[which][t, i] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_spline_basis_sums_to_one():
    shape = kan.KanShape(("a",), grid=5, k=3)
    x = np.linspace(-1, 0.999, 101)
    np.testing.assert_allclose(kan.splines(x, kan.knots(shape), shape.k).sum(axis=-1), 1.0, atol=1e-12)


def test_network_gradient():
    shape = kan.KanShape(("a", "b", "c"), ("n", "q_spatial", "p_spatial"), hidden=5, layers=2, grid=4, k=2)
    w = kan.initial_weights(shape, 3)
    rng = np.random.default_rng(0)
    x, g = rng.normal(size=(20, 3)) * 0.4, rng.normal(size=(20, 3))
    grads = kan.backward(shape, w, x, g)
    for name, values in w.items():
        flat = values.reshape(-1)
        for pos in rng.choice(flat.size, min(6, flat.size), replace=False):
            keep, loss = flat[pos], []
            for sign in (1, -1):
                flat[pos] = keep + sign * 1e-6
                loss.append((kan.forward(shape, w, x)[0] * g).sum())
            flat[pos] = keep
            assert grads[name].reshape(-1)[pos] == pytest.approx((loss[0] - loss[1]) / 2e-6, rel=1e-4, abs=1e-6)


def test_outputs_are_in_the_unit_interval_and_repeatable():
    shape = kan.KanShape(("a", "b"), hidden=7)
    x = np.random.default_rng(1).normal(size=(50, 2)) * 3
    y1 = kan.forward(shape, kan.initial_weights(shape, 42), x)[0]
    y2 = kan.forward(shape, kan.initial_weights(shape, 42), x)[0]
    assert ((y1 > 0) & (y1 < 1)).all()
    np.testing.assert_array_equal(y1, y2)


def test_learning_rate_schedule():
    assert kan.learning_rate({1: 0.005, 3: 0.001}, 2) == 0.005
    assert kan.learning_rate({1: 0.005, 3: 0.001}, 9) == 0.001
    assert kan.learning_rate({2: 0.005}, 1) == 0.005
