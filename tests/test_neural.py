"""The classifier head against numpy on the driver: gradient, fit, weights, early stop, odd rows."""

import numpy as np
import pytest

from kinetra.operators import neural as N

SCHEMA = "id int, label int, vec array<double>"


def blobs(n=(300, 60), seed=0):
    rng = np.random.default_rng(seed)
    y = np.r_[np.zeros(n[0], int), np.ones(n[1], int)]
    x = rng.normal(0, 1, (len(y), 4)) + y[:, None] * np.array([1.5, -1.0, 0.5, 0.0])
    return x, y


def frame(spark, x, y):
    rows = [(i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_gradient_is_the_slope_of_the_loss():
    x, y = blobs((20, 10))
    head, w = N.start(4, 3, 2, 1), np.array([1.0, 2.5])
    grad, _, weight = N.gradient(head, x, y, w, 0.1)
    assert weight == 20 + 25
    for k in range(head.flat().size):
        step = np.zeros(head.flat().size)
        step[k] = 1e-6
        up, down = (N.gradient(head.like(head.flat() + s), x, y, w, 0.1)[1] for s in (step, -step))
        assert abs((up - down) / 2e-6 - grad[k]) < 1e-4


def local_fit(x, y, w, hidden, epochs, patience, rate=0.02, decay=1e-4, seed=42):
    head = best = N.start(x.shape[1], hidden, 2, seed)
    m = v = 0.0
    losses, idle = [], 0
    for t in range(1, epochs + 1):
        grad, loss, weight = N.gradient(head, x, y, w, 0.1)
        grad, loss = grad / weight, loss / weight
        if not losses or loss < min(losses):
            best, idle = head, 0
        else:
            idle += 1
        losses.append(loss)
        if idle >= patience:
            break
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        head = head.like(head.flat() * (1 - rate * decay) - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8))
    return best, losses


def test_fit_equals_a_fit_on_the_driver(spark):
    x, y = blobs()
    got = N.fit_head(frame(spark, x, y), 4, 8, epochs=12)
    want, losses = local_fit(x, y, np.array([1.0, 5.0]), 8, 12, 5)
    np.testing.assert_allclose(got.flat(), want.flat(), atol=1e-8)
    np.testing.assert_allclose(got.losses, losses, atol=1e-10)
    assert got.losses[-1] < got.losses[0]


def test_weights_find_the_rare_class(spark):
    x, y = blobs((400, 40), 3)
    df = frame(spark, x, y)
    assert N.inverse_weights(df, "label", 3) == [1.0, 10.0, 1.0]
    found = []
    for weights in (None, [1.0, 1.0]):
        out = N.apply_head(df, N.fit_head(df, 4, 8, weights=weights, epochs=20, rate=0.05)).toPandas()
        found.append(((out.pred == 1) & (out.label == 1)).sum())
    assert found[0] > found[1] and found[0] >= 30


def test_stops_early_and_keeps_the_best(spark):
    x, y = blobs((60, 30))
    # Steps this long overshoot: the loss rises, and the fit ends after two passes without a smaller one.
    got = N.fit_head(frame(spark, x, y), 4, 4, rate=3.0, patience=2, epochs=40)
    want, losses = local_fit(x, y, np.array([1.0, 2.0]), 4, 40, 2, rate=3.0)
    assert len(got.losses) == len(losses) < 40
    np.testing.assert_allclose(got.flat(), want.flat(), atol=1e-6)
    _, best, weight = N.gradient(got, x, y, np.array([1.0, 2.0]), 0.1)
    assert best / weight == pytest.approx(min(got.losses))


def test_rows_that_are_no_samples(spark):
    x, y = blobs((30, 15))
    odd = [(900, None, [1.0] * 4), (901, 7, [1.0] * 4), (902, 1, None), (903, 1, []), (904, 0, [1.0, 2.0]), (905, 0, [1.0, None, 0.0, 0.0]),
           (906, 1, [float("nan"), 0.0, 0.0, 0.0]), (907, 1, [float("inf"), 0.0, 0.0, 0.0])]
    clean = frame(spark, x, y)
    head = N.fit_head(clean.unionByName(spark.createDataFrame(odd, SCHEMA)), 4, 4, epochs=3)
    np.testing.assert_allclose(head.flat(), N.fit_head(clean, 4, 4, epochs=3).flat(), atol=1e-9)
    out = {r.id: r for r in N.apply_head(spark.createDataFrame(odd, SCHEMA), head).collect()}
    assert [k for k, r in sorted(out.items()) if r.pred is not None] == [900, 901]
    np.testing.assert_allclose(out[900].prob_1, head.probabilities(np.ones((1, 4)))[0, 1])
    none = N.fit_head(clean.limit(0), 4, 4)
    assert none.losses == () and N.apply_head(clean.limit(0), none).collect() == []
