"""Mini-batch training of many network candidates in one scan.

A candidate is a network with its own optimiser, rate, batch size, dropout,
penalty and fold. An epoch of all live candidates is one Spark job over the
stored rows: every task is a replica that takes mini-batch steps on its own
rows for each candidate, and an aggregation over (candidate, parameter)
averages parameters and optimiser moments, weighted by the rows each replica
used. What travels is a few models a task; rows never move. A further job per
epoch gives the validation loss of all candidates, and each stops on its own
patience with the parameters of its best epoch.

Draws come from integer arithmetic on the row key, so SQL can repeat them and a
lost task repeats its steps: a row's order inside its block of rows, its fold
and the cells dropout removes from it in an epoch.

Rows are (key long, x array<double>, y double). A null key draws like key 0.
A candidate without a training row keeps its start parameters.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

# Fixed values of the draws: modulus and multipliers of row key, cell, seed and epoch.
MODULUS = 2147483647
KEY_FACTOR, CELL_FACTOR, SEED_FACTOR, EPOCH_FACTOR = 48271, 69621, 40692, 16807
LOG_GUARD = 1e-12


def draw(keys: np.ndarray, cells: np.ndarray, seed: int, epoch: int) -> np.ndarray:
    """A number of [0, 1) for each key (rows) and cell (columns)."""
    h = (np.mod(keys, MODULUS)[:, None] * KEY_FACTOR + cells[None, :] * CELL_FACTOR + seed * SEED_FACTOR + epoch * EPOCH_FACTOR) % MODULUS
    for _ in range(2):
        h = (h * h + 7 * h + 1) % MODULUS
    return h / MODULUS


def draw_sql(key: str, cell: str, seed: int, epoch: int) -> str:
    """``draw`` in SQL, for keys of zero and above."""
    h = f"((({key}) % {MODULUS}) * {KEY_FACTOR} + ({cell}) * {CELL_FACTOR} + {seed * SEED_FACTOR + epoch * EPOCH_FACTOR}) % {MODULUS}"
    for _ in range(2):
        h = f"list_transform([CAST({h} AS BIGINT)], lambda h: (h * h + 7 * h + 1) % {MODULUS})[1]"
    return f"(({h}) / CAST({MODULUS} AS DOUBLE))"


def folds_of(keys: np.ndarray, folds: int, seed: int) -> np.ndarray:
    return (draw(keys, np.array([-1]), seed, 0)[:, 0] * folds).astype(int)


# ------------------------------------------------------------------ networks
def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700.0, 700.0)))


@dataclass(frozen=True)
class DenseNet:
    """M9: rectified layers of the given sizes, then one sigmoid unit. Flat
    parameters: per layer the weights (inputs x units), then the biases."""

    inputs: int
    hidden: tuple[int, ...] = (8,)

    @property
    def sizes(self) -> list[int]:
        return [self.inputs, *self.hidden, 1]

    @property
    def size(self) -> int:
        return sum(a * b + b for a, b in itertools.pairwise(self.sizes))

    @property
    def cells(self) -> int:
        """Units that dropout can remove: all hidden ones, layer by layer."""
        return sum(self.hidden)

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([np.concatenate([rng.uniform(-1, 1, a * b) * np.sqrt(6.0 / (a + b)), np.zeros(b)])
                               for a, b in itertools.pairwise(self.sizes)])

    def penalised(self) -> np.ndarray:
        return np.concatenate([np.repeat([True, False], [a * b, b]) for a, b in itertools.pairwise(self.sizes)])

    def layers(self, flat: np.ndarray):
        at = 0
        for a, b in itertools.pairwise(self.sizes):
            yield flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]
            at += a * b + b

    def probability(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        *inner, (w, b) = self.layers(flat)
        for wi, bi in inner:
            x = np.maximum(x @ wi + bi, 0.0)
        return sigmoid(x @ w + b)[:, 0]

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """Summed gradient and summed loss; ``mask`` scales the hidden units of each row."""
        *inner, (w, b) = self.layers(flat)
        keep = np.split(mask, np.cumsum(self.hidden)[:-1], axis=1) if mask is not None else [1.0] * len(inner)
        seen, slopes = [x], []
        for (wi, bi), k in zip(inner, keep):
            z = seen[-1] @ wi + bi
            slopes.append((z > 0) * k)
            seen.append(np.maximum(z, 0.0) * k)
        p = sigmoid(seen[-1] @ w + b)[:, 0]
        back = (p - y)[:, None]
        parts = [np.concatenate([(seen[-1].T @ back).ravel(), back.sum(axis=0)])]
        for i in range(len(inner) - 1, -1, -1):
            back = (back @ w.T) * slopes[i]
            parts.append(np.concatenate([(seen[i].T @ back).ravel(), back.sum(axis=0)]))
            w = inner[i][0]
        return np.concatenate(parts[::-1]), log_loss(p, y)


@dataclass(frozen=True)
class ConvNet:
    """M6, M7: kernels of three rows over the full width, rectified, largest
    value over the positions, one sigmoid unit. Input rows are flat (rows x
    width). Flat parameters: kernels, their biases, weights, bias."""

    rows: int
    width: int
    kernels: int = 16
    padding: str = "valid"
    stride: int = 1

    @property
    def positions(self) -> int:
        return (self.rows - (0 if self.padding == "same" else 2) + self.stride - 1) // self.stride

    @property
    def size(self) -> int:
        return self.kernels * (3 * self.width + 2) + 1

    @property
    def cells(self) -> int:
        """Outputs that dropout can remove: position by position, all kernels."""
        return self.positions * self.kernels

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        k, n = self.kernels, 3 * self.width
        return np.concatenate([rng.uniform(-1, 1, k * n) * np.sqrt(6.0 / (n + 3 * k)), np.zeros(k),
                               rng.uniform(-1, 1, k) * np.sqrt(6.0 / (k + 1)), np.zeros(1)])

    def penalised(self) -> np.ndarray:
        return np.arange(self.size) < self.kernels * 3 * self.width

    def split(self, flat: np.ndarray):
        k, n = self.kernels, 3 * self.width
        return flat[:k * n].reshape(k, n), flat[k * n:k * n + k], flat[k * n + k:k * n + 2 * k], flat[-1]

    def views(self, x: np.ndarray) -> np.ndarray:
        """Three successive rows side by side for every position."""
        x = x.reshape(len(x), self.rows, self.width)
        if self.padding == "same":
            x = np.pad(x, ((0, 0), (1, 1), (0, 0)))
        last = x.shape[1] - 2
        return np.concatenate([x[:, k:last + k] for k in range(3)], axis=2)[:, ::self.stride]

    def outputs(self, seen: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Every kernel at every position: one product over all rows."""
        out = seen.reshape(-1, seen.shape[2]) @ w.T
        out += b
        return out.reshape(len(seen), self.positions, self.kernels)

    def probability(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.split(flat)
        return sigmoid(np.maximum(largest(self.outputs(self.views(x), w, b)), 0.0) @ v + c)

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """Summed gradient and summed loss; ``mask`` scales every output of a
        kernel before it is rectified. Of equal largest outputs the first counts."""
        w, b, v, c = self.split(flat)
        seen = self.views(x)
        out = self.outputs(seen, w, b)
        if mask is not None:
            keep = mask.reshape(out.shape)
            out *= keep
        np.maximum(out, 0.0, out=out)
        top = largest(out)
        p = sigmoid(top @ v + c)
        err = p - y
        back, taken = err[:, None] * v * (top > 0), np.zeros(top.shape, bool)
        kernels, slope = np.zeros((self.kernels, seen.shape[2])), np.zeros(top.shape)
        for k in range(self.positions):
            own = (out[:, k] == top) & ~taken
            taken |= own
            at = back * own if mask is None else back * own * keep[:, k]
            kernels += at.T @ seen[:, k]
            slope += at
        return np.concatenate([kernels.ravel(), slope.sum(axis=0), top.T @ err, [err.sum()]]), log_loss(p, y)


def largest(out: np.ndarray) -> np.ndarray:
    """Largest output of each kernel over the positions."""
    top = out[:, 0].copy()
    for k in range(1, out.shape[1]):
        np.maximum(top, out[:, k], out=top)
    return top


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    return -float(np.sum(y * np.log(p + LOG_GUARD) + (1 - y) * np.log(1 - p + LOG_GUARD)))


# ------------------------------------------------------------------ candidates
@dataclass(frozen=True)
class Candidate:
    """A network and how it is trained. ``fold`` of ``folds`` is left out of
    training and scored on (None: train on every row)."""

    net: DenseNet | ConvNet
    rate: float = 0.01
    optimizer: str = "adam"
    batch: int = 1024
    dropout: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    seed: int = 1
    fold: int | None = None
    folds: int = 0


@dataclass(frozen=True)
class State:
    """Flat parameters, optimiser moments and (average) number of steps."""

    flat: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: float = 0.0

    @classmethod
    def fresh(cls, flat: np.ndarray) -> State:
        return cls(flat.astype(float), np.zeros(len(flat)), np.zeros(len(flat)))

    def moved(self, g: np.ndarray, c: Candidate) -> State:
        if c.optimizer == "sgd":
            return replace(self, flat=self.flat - c.rate * g, steps=self.steps + 1)
        t = self.steps + 1
        first, second = 0.9 * self.first + 0.1 * g, 0.999 * self.second + 0.001 * g * g
        move = (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
        return State(self.flat - c.rate * move, first, second, t)


def step(c: Candidate, s: State, keys: np.ndarray, x: np.ndarray, y: np.ndarray, epoch: int, drawn: np.ndarray | None = None) -> tuple[State, float]:
    """One mini-batch step; also the summed loss before it. ``drawn``: the rows'
    draws of all cells, where they are known."""
    mask = None
    if c.dropout > 0:
        drawn = draw(keys, np.arange(c.net.cells), c.seed, epoch) if drawn is None else drawn
        mask = (drawn >= c.dropout) / (1.0 - c.dropout)
    g, loss = c.net.gradient(s.flat, x, y, mask)
    g = g / len(x) + c.net.penalised() * (c.l1 * np.sign(s.flat) + 2.0 * c.l2 * s.flat)
    return s.moved(g, c), loss


def blocks(batches, size: int):
    """Arrow batches -> (keys, x, y) in blocks of ``size`` rows, the last smaller."""
    held: list[pd.DataFrame] = []
    have = 0
    for pdf in batches:
        at = 0
        while at < len(pdf):
            part = pdf.iloc[at:at + size - have]
            held.append(part)
            at, have = at + len(part), have + len(part)
            if have == size:
                yield arrays(held)
                held, have = [], 0
    if have:
        yield arrays(held)


def arrays(parts: list[pd.DataFrame]):
    d = pd.concat(parts)
    return (d["key"].fillna(0).to_numpy(dtype=np.int64), np.stack(d["x"].to_numpy()).astype(np.float64), d["y"].to_numpy(dtype=np.float64))


def train_rows(c: Candidate, keys: np.ndarray) -> np.ndarray | slice:
    return slice(None) if c.fold is None else folds_of(keys, c.folds, c.seed) != c.fold


def averaged_epoch(rows: DataFrame, live: list[tuple[Candidate, State]], epoch: int) -> list[tuple[State, float, int]]:
    """One epoch of all candidates: (averaged state, mean training loss, rows)."""
    shared = rows.sparkSession.sparkContext.broadcast(live)
    largest = max(c.batch for c, _ in live)

    def run(batches):
        work = [(c, s, 0.0, 0) for c, s in shared.value]
        for keys, x, y in blocks(batches, largest):
            order = np.lexsort((keys, draw(keys, np.array([-2]), 0, epoch)[:, 0]))
            keys, x, y = keys[order], x[order], y[order]
            of, drawn = None, None   # candidates with the same cells and seed share their draws
            for i, (c, s, loss, n) in enumerate(work):
                mine = train_rows(c, keys)
                k, xs, ys = keys[mine], x[mine], y[mine]
                if c.dropout > 0 and (c.net.cells, c.seed, c.fold, c.folds) != of:
                    of, drawn = (c.net.cells, c.seed, c.fold, c.folds), draw(k, np.arange(c.net.cells), c.seed, epoch)
                for at in range(0, len(k), c.batch):
                    cut = slice(at, at + c.batch)
                    s, lost = step(c, s, k[cut], xs[cut], ys[cut], epoch, drawn[cut] if c.dropout > 0 else None)
                    loss += lost
                work[i] = (c, s, loss, n + len(k))
        for i, (c, s, loss, n) in enumerate(work):
            if n:
                v = np.concatenate([s.flat, s.first, s.second, [s.steps, loss / n, 1.0]]) * n
                yield pd.DataFrame({"c": i, "i": np.arange(len(v)), "v": v})

    got = rows.mapInPandas(run, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).toPandas()
    out = [(s, float("nan"), 0) for _, s in live]
    for i, part in got.groupby("c"):
        v = part.sort_values("i")["v"].to_numpy()
        n = v[-1]
        first, second, third = np.split(v[:-3] / n, 3)
        out[i] = (State(first, second, third, v[-3] / n), float(v[-2] / n), int(round(n)))
    return out


def evaluate(rows: DataFrame, models: list[tuple[Candidate, State]], own_fold: bool = False) -> list[dict]:
    """Loss, accuracy and rows of each candidate; with ``own_fold`` on the rows
    its training left out."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for keys, x, y in blocks(batches, 4096):
            out = []
            for i, (c, s) in enumerate(shared.value):
                mine = folds_of(keys, c.folds, c.seed) == c.fold if own_fold and c.fold is not None else slice(None)
                p = c.net.probability(s.flat, x[mine])
                out.append((i, log_loss(p, y[mine]), float(((p > 0.5) == (y[mine] > 0.5)).sum()), len(p)))
            yield pd.DataFrame(out, columns=["c", "loss", "hits", "n"])

    got = rows.mapInPandas(run, "c int, loss double, hits double, n long").groupBy("c").agg(
        *[F.sum(k).alias(k) for k in ("loss", "hits", "n")]).collect()
    out = [{"loss": float("nan"), "accuracy": float("nan"), "n": 0} for _ in models]
    for r in got:
        if r["n"]:
            out[r["c"]] = {"loss": r["loss"] / r["n"], "accuracy": r["hits"] / r["n"], "n": r["n"]}
    return out


@dataclass
class Fitted:
    """A candidate, the state of its best epoch and what was seen on the way."""

    candidate: Candidate
    state: State
    best: float = float("inf")
    waited: int = 0
    history: list[tuple[int, float, float]] = field(default_factory=list)


def fit(rows: DataFrame, validation: DataFrame | None, candidates: list[Candidate], epochs: int = 1000, patience: int = 10) -> list[Fitted]:
    """Trains all candidates side by side. Each leaves when its validation
    loss (training loss without validation rows) has not fallen for
    ``patience`` epochs."""
    done = [Fitted(c, State.fresh(c.net.start(c.seed))) for c in candidates]
    now = {i: f.state for i, f in enumerate(done)}
    for epoch in range(1, epochs + 1):
        if not now:
            break
        order = list(now)
        got = averaged_epoch(rows, [(done[i].candidate, now[i]) for i in order], epoch)
        held = evaluate(validation, [(done[i].candidate, s) for i, (s, _, _) in zip(order, got)]) if validation is not None else None
        for at, i in enumerate(order):
            state, loss, n = got[at]
            f = done[i]
            score = held[at]["loss"] if held is not None and held[at]["n"] else loss
            f.history.append((epoch, loss, score))
            now[i] = state
            if n and score < f.best:
                f.best, f.state, f.waited = score, state, 0
            else:
                f.waited += 1
            if not n or f.waited >= patience:
                del now[i]
    return done


# ------------------------------------------------------------------ M11 / T6
def grid(**values) -> list[dict]:
    """All combinations, the last name varying fastest."""
    return [dict(zip(values, v)) for v in itertools.product(*values.values())]


def random_settings(n: int, seed: int, **values) -> list[dict]:
    """``n`` distinct combinations of the grid (all of them if it has fewer)."""
    every = grid(**values)
    return [every[i] for i in sorted(np.random.default_rng(seed).permutation(len(every))[:n])]


def search(rows: DataFrame, validation: DataFrame | None, make, settings: list[dict], folds: int = 0, epochs: int = 1000,
           patience: int = 10) -> tuple[Fitted, list[dict]]:
    """Trains every setting (``make(**setting)`` gives its candidate) on every
    fold in shared scans, scores it by mean accuracy on the folds left out
    (folds below 2: on all rows), and refits the best on all rows. Ties go to
    the first. Returns (refitted best, one dict a setting)."""
    rows = cut_lineage(rows.select("key", "x", F.col("y").cast("double").alias("y")))
    validation = None if validation is None else cut_lineage(validation.select("key", "x", F.col("y").cast("double").alias("y")))
    plain = [make(**s) for s in settings]
    runs = [(i, replace(c, fold=k, folds=folds)) for i, c in enumerate(plain) for k in range(folds)] if folds > 1 else list(enumerate(plain))
    fitted = fit(rows, validation, [c for _, c in runs], epochs, patience)
    marks = evaluate(rows, [(f.candidate, f.state) for f in fitted], own_fold=True)
    table = []
    for i, s in enumerate(settings):
        mine = [k for k, (j, _) in enumerate(runs) if j == i]
        seen = [marks[k]["accuracy"] for k in mine if marks[k]["n"]]
        table.append({**s, "accuracy": float(np.mean(seen)) if seen else float("nan"),
                      "epochs": max(len(fitted[k].history) for k in mine)})
    top = max(range(len(table)), key=lambda i: (table[i]["accuracy"] if table[i]["accuracy"] == table[i]["accuracy"] else -1.0, -i))
    best = fitted[top] if folds <= 1 else fit(rows, validation, [plain[top]], epochs, patience)[0]
    return best, table


# ------------------------------------------------------------------ use and storage
def predict(rows: DataFrame, net: DenseNet | ConvNet, flat: np.ndarray, keys: list[str], x: str = "x", threshold: float = 0.5) -> DataFrame:
    """M8: probability ``p`` and class (p above the threshold) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast((net, flat))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                n, f = shared.value
                p = n.probability(f, np.stack(pdf[x].to_numpy()).astype(np.float64))
                yield pdf[keys].assign(p=p, pred=(p > threshold).astype(np.int32))

    types = dict(rows.dtypes)
    return rows.select(*keys, x).mapInPandas(run, ", ".join([f"`{k}` {types[k]}" for k in keys] + ["p double", "pred int"]))


def save_network(spark: SparkSession, net: DenseNet | ConvNet, flat: np.ndarray, path: str) -> None:
    """Layout and parameters as one row of a Parquet table."""
    conv = isinstance(net, ConvNet)
    row = ("conv", [net.rows, net.width, net.kernels, net.stride], net.padding, flat.tolist()) if conv else \
        ("dense", [net.inputs, *net.hidden], None, flat.tolist())
    spark.createDataFrame([row], "kind string, layout array<int>, padding string, params array<double>").write.mode("overwrite").parquet(path)


def load_network(spark: SparkSession, path: str) -> tuple[DenseNet | ConvNet, np.ndarray]:
    r = spark.read.parquet(path).first()
    if r["kind"] == "conv":
        rows, width, kernels, stride = r["layout"]
        net: DenseNet | ConvNet = ConvNet(rows, width, kernels, r["padding"], stride)
    else:
        net = DenseNet(r["layout"][0], tuple(r["layout"][1:]))
    return net, np.array(r["params"])
