"""Flow-tensor convolutional classifier.

Model: K kernels of size 3 x F over an n x F fragment (valid padding) ->
ReLU -> global max over positions -> one sigmoid unit; binary
cross-entropy, Adam.

Spark plan: training is data parallel.  Every epoch is one job: the
current weights are broadcast, ``mapInPandas`` computes per-partition
gradient sums with numpy (im2col), a ``groupBy`` sums them into one small
vector and the driver takes the Adam step (the parameters are a few
thousand numbers).  Epochs use the full training set (no mini-batch
shuffle) and no dropout, so training is reproducible; early stopping on
the validation loss with a patience.  Prediction is a stateless
``mapInPandas`` over Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def init_cnn(n_features: int, kernels: int = 16, seed: int = 1, padding: str = "valid", stride: int = 1) -> dict:
    """Parameters plus the layout options (M7: 'same' or 'valid' rows, row stride)."""
    rng = np.random.RandomState(seed)
    fan = 3 * n_features
    return {"Wc": rng.normal(0, np.sqrt(2.0 / fan), size=(kernels, fan)), "bc": np.zeros(kernels),
            "wd": rng.normal(0, np.sqrt(1.0 / kernels), size=kernels), "bd": np.zeros(1),
            "padding": padding, "stride": int(stride)}


def _im2col(x: np.ndarray, padding: str = "valid", stride: int = 1) -> np.ndarray:
    """(B, n, F) -> (B, positions, 3F): 3-row windows over the full width;
    'same' pads one zero row on each side, positions are taken every
    ``stride`` rows."""
    if padding == "same":
        z = np.zeros((x.shape[0], 1, x.shape[2]))
        x = np.concatenate([z, x, z], axis=1)
    cols = np.concatenate([x[:, i:x.shape[1] - 2 + i, :] for i in range(3)], axis=2)
    return cols[:, ::stride, :]


def forward(p: dict, x: np.ndarray):
    cols = _im2col(x, p.get("padding", "valid"), p.get("stride", 1))
    z = (cols.reshape(-1, cols.shape[2]) @ p["Wc"].T + p["bc"]).reshape(*cols.shape[:2], -1)
    a = np.maximum(z, 0.0)
    idx = a.argmax(axis=1)
    m = np.take_along_axis(a, idx[:, None, :], axis=1)[:, 0, :]
    logit = m @ p["wd"] + p["bd"][0]
    prob = 1.0 / (1.0 + np.exp(-logit))
    return prob, (cols, z, idx, m)


def gradients(p: dict, x: np.ndarray, y: np.ndarray):
    """Sum of BCE gradients over the batch and the summed loss."""
    prob, (cols, z, idx, m) = forward(p, x)
    eps = 1e-12
    loss = -np.sum(y * np.log(prob + eps) + (1 - y) * np.log(1 - prob + eps))
    g = prob - y
    dwd = m.T @ g
    dbd = np.array([g.sum()])
    dm = g[:, None] * p["wd"][None, :]
    dz = np.zeros_like(z)
    b_ix = np.arange(x.shape[0])[:, None]
    k_ix = np.arange(z.shape[2])[None, :]
    dz[b_ix, idx, k_ix] = dm * (z[b_ix, idx, k_ix] > 0)
    dWc = dz.reshape(-1, dz.shape[2]).T @ cols.reshape(-1, cols.shape[2])
    dbc = dz.sum(axis=(0, 1))
    return {"Wc": dWc, "bc": dbc, "wd": dwd, "bd": dbd}, float(loss)


_ORDER = ["Wc", "bc", "wd", "bd"]


def _flat(d: dict) -> np.ndarray:
    return np.concatenate([np.ravel(d[k]) for k in _ORDER])


def _unflat(v: np.ndarray, like: dict) -> dict:
    out, o = {k: like[k] for k in like if k not in _ORDER}, 0
    for k in _ORDER:
        n = like[k].size
        out[k] = v[o:o + n].reshape(like[k].shape)
        o += n
    return out


def _stack(col, width: int) -> np.ndarray:
    """Flat samples, one array of plain numbers each, as (rows, n, width)."""
    return np.stack(col.to_numpy()).astype(np.float64).reshape(len(col), -1, width)


def _flat_samples(d: DataFrame, *others) -> DataFrame:
    """``others`` and every sample as one flat array: nested ones reach Python
    as objects of objects, row by row."""
    return d.select(*others, F.flatten("set_x").alias("x"))


def _grad_job(spark: SparkSession, data: DataFrame, params: dict) -> tuple[np.ndarray, float, int]:
    """One job: per-partition gradient sums, reduced by index.  Index -1
    carries the summed loss and -2 the row count."""
    bp = spark.sparkContext.broadcast(params)
    width = params["Wc"].shape[1] // 3

    def run(batches):
        tot, loss, n = None, 0.0, 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            g, lo = gradients(bp.value, _stack(pdf["x"], width), pdf["set_y"].to_numpy(dtype=np.float64))
            v = _flat(g)
            tot = v if tot is None else tot + v
            loss, n = loss + lo, n + len(pdf)
        if tot is not None:
            yield pd.DataFrame({"i": np.concatenate([np.arange(len(tot)), [-1, -2]]),
                                "g": np.concatenate([tot, [loss, float(n)]])})
    rows = (data.select("x", "set_y").mapInPandas(run, "i long, g double")
            .groupBy("i").agg(F.sum("g").alias("g")).collect())
    if not rows:
        return np.zeros(_flat(params).size), 0.0, 0
    got = {r["i"]: r["g"] for r in rows}
    g = np.array([got[i] for i in range(_flat(params).size)])
    return g, float(got[-1]), int(round(got[-2]))


def train_cnn(spark: SparkSession, train: DataFrame, val: DataFrame | None, n_features: int, kernels: int = 16,
              lr: float = 0.01, epochs: int = 30, patience: int = 10, seed: int = 1, padding: str = "valid",
              stride: int = 1):
    """M6/M7: returns (params, history list of (epoch, train_loss, val_loss))."""
    from ..session import cut_lineage
    train = cut_lineage(_flat_samples(train, "set_y"))
    val = cut_lineage(_flat_samples(val, "set_y")) if val is not None else None
    p = init_cnn(n_features, kernels, seed, padding, stride)
    v = _flat(p)
    m1, m2 = np.zeros_like(v), np.zeros_like(v)
    b1, b2, eps = 0.9, 0.999, 1e-7
    best, best_v, wait, hist = np.inf, v.copy(), 0, []
    for ep in range(1, epochs + 1):
        g, loss, n = _grad_job(spark, train, p)
        if n == 0:
            break
        g = g / n
        m1 = b1 * m1 + (1 - b1) * g
        m2 = b2 * m2 + (1 - b2) * g * g
        v = v - lr * (m1 / (1 - b1 ** ep)) / (np.sqrt(m2 / (1 - b2 ** ep)) + eps)
        p = _unflat(v, p)
        vl = np.nan
        if val is not None:
            _, vloss, vn = _grad_job(spark, val, p)
            vl = vloss / vn if vn else np.nan
        hist.append((ep, loss / n, vl))
        score = vl if val is not None else loss / n
        if score < best - 1e-12:
            best, best_v, wait = score, v.copy(), 0
        else:
            wait += 1
            if wait >= patience:
                break
    return _unflat(best_v, p), hist


def predict_cnn(samples: DataFrame, params: dict, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """M8: probability and class (p > threshold) per sample."""
    spark = samples.sparkSession
    bp = spark.sparkContext.broadcast(params)
    types = dict(samples.dtypes)
    width = params["Wc"].shape[1] // 3

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            prob, _ = forward(bp.value, _stack(pdf["x"], width))
            out = pdf[keys].copy()
            out["p"] = prob
            out["pred"] = (prob > threshold).astype(np.int32)
            yield out
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", p double, pred int"
    return _flat_samples(samples, *keys).mapInPandas(run, schema)
