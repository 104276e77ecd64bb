import numpy as np
import pandas as pd

from streamsift.operators import cnn as CN


import pytest


@pytest.mark.parametrize("padding,stride", [("valid", 1), ("same", 1), ("same", 2)])
def test_gradients_match_finite_differences(padding, stride):
    rng = np.random.RandomState(0)
    p = CN.init_cnn(4, kernels=3, seed=2, padding=padding, stride=stride)
    x = rng.rand(5, 6, 4)
    y = np.array([0, 1, 1, 0, 1], dtype=float)
    g, loss = CN.gradients(p, x, y)
    flat = CN._flat(p)
    num = np.zeros_like(flat)
    for i in range(len(flat)):
        for s in (1, -1):
            q = flat.copy()
            q[i] += s * 1e-6
            _, lo = CN.gradients(CN._unflat(q, p), x, y)
            num[i] += s * lo / 2e-6
    assert np.allclose(CN._flat(g), num, atol=1e-4)


def test_training_reduces_loss(spark):
    rng = np.random.RandomState(1)
    rows = []
    for i in range(200):
        y = i % 2
        x = rng.rand(6, 3) * 0.1 + (0.8 if y else 0.0) * (rng.rand(6, 3) > 0.5)
        rows.append((i, x.tolist(), y))
    d = spark.createDataFrame(rows, "sample_id long, set_x array<array<double>>, set_y int")
    params, hist = CN.train_cnn(spark, d, None, 3, kernels=4, lr=0.05, epochs=15, patience=15)
    assert hist[-1][1] < hist[0][1]
    pred = CN.predict_cnn(d, params, ["sample_id", "set_y"]).collect()
    acc = np.mean([r["pred"] == r["set_y"] for r in pred])
    assert acc > 0.8


def test_samples_reach_the_tasks_flat(spark):
    """Stacking takes one array a row, not an array of arrays."""
    assert CN._stack(pd.Series([np.arange(6.0), np.arange(6.0)]), 3).shape == (2, 2, 3)
    d = spark.createDataFrame([(i, [[float(i), 1.0], [0.0, 2.0], [1.0, 0.0]], i % 2) for i in range(9)], "sample_id long, set_x array<array<double>>, set_y int")
    flat = CN._flat_samples(d, "set_y")
    assert dict(flat.dtypes)["x"] == "array<double>" and flat.first()["x"] == [0.0, 1.0, 0.0, 2.0, 1.0, 0.0]
    p = CN.init_cnn(2, kernels=3)
    want = CN.forward(p, np.array([[[i, 1.0], [0.0, 2.0], [1.0, 0.0]] for i in range(9)]))[0]
    got = {r["sample_id"]: r["p"] for r in CN.predict_cnn(d, p, ["sample_id"]).collect()}
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(9))
