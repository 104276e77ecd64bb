"""Toxicity by classifier chains.

The categories are predicted in a fixed order by linear (logistic) models.
The model of a category sees the text features and the probabilities of all
earlier categories. In training those probabilities are out of fold: they come
from models that did not see the row, so a later model does not learn to trust
an over-fitted input.

Text features are the words of a text and their first four and five bytes,
hashed to a fixed space and used by presence, and a few shares of byte
classes. They are taken from whole texts in Arrow tasks with numpy; scoring
reads every text once with a broadcast table whose size is fixed by the
feature space.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamsift.llm.common import (SpanHash, blocks, broadcast_small, buffers, durable, fill, list_array, mix, pick,
                                   sliced, spans, table)

#: Bits of the hashed feature space.
SPACE_BITS = 20
#: Prefix lengths in bytes; 0 is the whole word.
PARTS = (0, 4, 5)
DENSE = 4
FOLDS = 3
#: Bound of the labelled sample that the chain is fitted on.
TRAIN_ROWS = 8000
#: Features a model may use, chosen by screening inside its own training rows.
MODEL_FEATURES = 1500
MIN_DOCS = 3


def byte_shares(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per text: share of ASCII punctuation, digits, white space; log length."""
    n = np.diff(off)
    kinds = np.zeros((256, 3), np.float64)
    for b in range(33, 127):
        kinds[b, 0] = not chr(b).isalnum()
        kinds[b, 1] = chr(b).isdigit()
    kinds[[9, 10, 11, 12, 13, 32], 2] = 1
    out = np.zeros((len(n), DENSE), np.float32)
    for k in range(3):
        cum = np.concatenate([[0], np.cumsum(kinds[:, k][buf])])
        out[:, k] = (cum[off[1:]] - cum[off[:-1]]) / np.maximum(n, 1)
    out[:, 3] = np.log1p(n) / 12
    return out


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and prefix of a block, with repeats."""
    s, e, doc = spans(buf, off)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = SpanHash(buf)
    docs, feats = [], []
    for k in PARTS:
        use = slice(None) if k == 0 else (e - s) >= k
        a = s[use]
        key = mix(h(a, e[use] if k == 0 else a + k), k + 1)
        docs.append(doc[use])
        feats.append((key >> np.uint64(64 - SPACE_BITS)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(feats)


def lowered(arr) -> pa.Array:
    return pc.utf8_lower(fill(arr))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l1: float = 4e-5, l2: float = 2e-5, rounds: int = 400) -> tuple[np.ndarray, float]:
    """L1/L2 logistic regression by accelerated proximal gradient steps. With
    one class only, the weights are 0 and the bias is the smoothed rate."""
    n, d = x.shape
    flat = lambda a: a.astype(x.dtype, copy=False)  # noqa: E731  products in the type of x make no copy of it
    rate = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(rate / (1 - rate)))
    if not 0 < y.sum() < n:
        return np.zeros(d), bias
    v = np.ones(d)
    for _ in range(12):  # largest eigenvalue of the Gram matrix, for the step
        v = (x.T @ (x @ flat(v))).astype(float)
        v /= max(np.linalg.norm(v), 1e-12)
    step = 4 / (np.linalg.norm(x @ flat(v)) ** 2 / n + 1 + 4 * l2)
    w, b, pw, pb, t = np.zeros(d), bias, np.zeros(d), bias, 1.0
    for _ in range(rounds):
        r = (sigmoid(x @ flat(pw) + pb) - y) / n
        nw = pw - step * (x.T @ flat(r) + l2 * pw)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        nb = pb - step * r.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


#: Bytes of text whose features are in memory at once.
SCORE_BYTES = 512 << 10


@dataclass
class Chain:
    """A fitted chain. ``weights`` has one row per category over ``feats``,
    then the byte shares, then the earlier categories' probabilities."""

    categories: list[str]
    feats: np.ndarray
    weights: list[dict] = field(default_factory=list)

    def score(self, hits_doc: np.ndarray, hits_col: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Probabilities (texts, categories) from distinct feature hits."""
        out = np.zeros((len(dense), len(self.categories)))
        for c, m in enumerate(self.weights):
            z = np.bincount(hits_doc, weights=m["sparse"][hits_col], minlength=len(dense)) + dense @ m["dense"] + m["bias"]
            out[:, c] = sigmoid(z + out[:, :c] @ m["earlier"])
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: Sequence[str], key: str, text: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled texts, picked by key hash: (id, fold, labels,
    distinct features, byte shares). One row per key."""
    lab = (labels.where(F.col(f"`{key}`").isNotNull())
           .groupBy(F.col(f"`{key}`").alias("id")).agg(*[F.max(f"`{c}`").alias(f"y{i}") for i, c in enumerate(categories)]))
    for i in range(len(categories)):
        lab = lab.where(F.col(f"y{i}").isNotNull())
    mine = pick(docs, id=key, text=text)
    lab = lab.join(mine.select("id"), "id", "left_semi")   # labels of other documents take no place in the bound
    lab = lab.orderBy(F.xxhash64("id"), "id").limit(rows)  # bounded by ``rows``
    one = mine.join(F.broadcast(lab), "id").groupBy("id", *[f"y{i}" for i in range(len(categories))]).agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            buf, off = buffers(lowered(batch.column(1)))
            for i, j in blocks(off, SCORE_BYTES):
                b, o = buf[off[i]:off[j]], off[i:j + 1] - off[i]
                pair = np.unique(np.stack(features(b, o), 1), axis=0) if len(b) else np.zeros((0, 2), np.int64)
                dense = byte_shares(b, o)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(2)[i:j], list_array(pair[:, 1].astype(np.int32), np.bincount(pair[:, 0], minlength=j - i), pa.int32()),
                     list_array(dense.ravel(), np.full(j - i, DENSE), pa.float32())], ["id", "y", "feats", "dense"])

    y = F.array(*[F.col(f"y{i}").cast("int") for i in range(len(categories))])
    made = one.select("id", "text", y.alias("y")).mapInArrow(run, f"id {dict(mine.dtypes)['id']}, y array<int>, feats array<int>, dense array<float>")
    return durable(made.withColumn("fold", F.pmod(F.crc32(F.col("id").cast("string")), F.lit(FOLDS)).cast("int")))


def screen(counts: pd.DataFrame, totals: np.ndarray, c: int, without: int | None, size: int) -> np.ndarray:
    """Features that tell category ``c`` best by the z-score of their log odds
    in all folds but ``without``. Columns of counts: n{fold}, p{fold}_{c}."""
    folds = [f for f in range(FOLDS) if f != without]
    df = sum(counts[f"n{f}"].to_numpy(float) for f in folds)
    pos = sum(counts[f"p{f}_{c}"].to_numpy(float) for f in folds)
    n, p = totals[folds, 0].sum(), totals[folds, 1 + c].sum()
    neg, q = df - pos, n - p
    odds = np.log((pos + 0.5) / (p - pos + 0.5)) - np.log((neg + 0.5) / (q - neg + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    z[df < MIN_DOCS] = 0
    best = np.lexsort((counts["feat"].to_numpy(), -z))[:size]
    return np.sort(counts["feat"].to_numpy()[best[z[best] > 0]])


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], key: str = "doc_id", text: str = "text",
              rows: int = TRAIN_ROWS) -> Chain:
    """Fit the chain on at most ``rows`` labelled rows (the bound is the
    parameter). No labelled row at all gives rates of one half and no
    features."""
    spark, ncat = docs.sparkSession, len(categories)
    sample = labelled_sample(docs, labels, categories, key, text, rows)
    aggs = [F.sum((F.col("fold") == f).cast("int")).alias(f"n{f}") for f in range(FOLDS)]
    aggs += [F.sum(F.when(F.col("fold") == f, F.col("y")[c]).otherwise(0)).alias(f"p{f}_{c}") for f in range(FOLDS) for c in range(ncat)]
    counts = (sample.select("fold", "y", F.explode("feats").alias("feat")).groupBy("feat").agg(F.count(F.lit(1)).alias("df"), *aggs)
              .where(F.col("df") >= MIN_DOCS).drop("df").toPandas())  # fewer rows than the feature space
    base = sample.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("y")[c]).alias(f"p{c}") for c in range(ncat)]).collect()
    totals = np.zeros((FOLDS, 1 + ncat))
    for r in base:
        totals[r["fold"]] = [r["n"], *[r[f"p{c}"] for c in range(ncat)]]
    chosen = {(c, f): screen(counts, totals, c, f, MODEL_FEATURES) for c in range(ncat) for f in [*range(FOLDS), None]}
    union = np.unique(np.concatenate([*chosen.values(), np.zeros(0, np.int64)])).astype(np.int64)
    cols = broadcast_small(spark, union)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hit = [np.intersect1d(f, cols.value, assume_unique=True) for f in pdf["feats"]]
            yield pdf[["id", "fold", "y", "dense"]].assign(cols=[np.searchsorted(cols.value, h).astype(np.int32) for h in hit])

    kind = dict(sample.dtypes)["id"]
    data = sample.mapInPandas(keep, f"id {kind}, fold int, y array<int>, dense array<float>, cols array<int>").toPandas().sort_values("id")
    n = len(data)
    fold, y = data["fold"].to_numpy(int), np.stack(data["y"]).astype(float) if n else np.zeros((0, ncat))
    hits, shares = list(data["cols"]), np.stack(data["dense"]).astype(np.float32) if n else np.zeros((0, DENSE), np.float32)
    out, oof = Chain(list(categories), union), np.zeros((n, ncat))
    for c in range(ncat):
        def columns(f, c=c):
            return np.searchsorted(union, chosen[c, f])

        def design(use, rows_, c=c):
            """One model's matrix: its features, the byte shares, earlier categories."""
            place = np.full(len(union), -1)
            place[use] = np.arange(len(use))
            x = np.zeros((len(rows_), len(use) + DENSE + c), np.float32)
            for i, r in enumerate(rows_):
                at = place[hits[r]]
                x[i, at[at >= 0]] = 1
            x[:, len(use):len(use) + DENSE] = shares[rows_]
            x[:, len(use) + DENSE:] = oof[rows_, :c]
            return x
        for f in range(FOLDS):
            inside, outside, use = np.flatnonzero(fold != f), np.flatnonzero(fold == f), columns(f)
            w, b = fit_logistic(design(use, inside), y[inside, c])
            oof[outside, c] = sigmoid(design(use, outside) @ w + b)
        use = columns(None)
        w, b = fit_logistic(design(use, np.arange(n)), y[:, c])
        sparse = np.zeros(len(union))
        k = len(use)
        sparse[use] = w[:k]
        out.weights.append({"sparse": sparse, "dense": w[k:k + DENSE], "earlier": w[k + DENSE:], "bias": b})
    return out


def block_scorer(model: Chain):
    """A function that scores the texts of one string column, block by block:
    (first, last, probabilities)."""
    used = np.flatnonzero(np.any([m["sparse"] != 0 for m in model.weights], axis=0)) if len(model.feats) else np.zeros(0, int)
    m = Chain(model.categories, model.feats[used], [w | {"sparse": w["sparse"][used]} for w in model.weights])
    slot = np.full(1 << SPACE_BITS, -1, np.int32)
    slot[m.feats] = np.arange(len(m.feats))
    width = len(m.feats) + 1

    def score(arr) -> Iterator[tuple[int, int, np.ndarray]]:
        buf, off = buffers(lowered(arr))
        for i, j in blocks(off, SCORE_BYTES):
            b, o = buf[off[i]:off[j]], off[i:j + 1] - off[i]
            doc, feat = features(b, o)
            col = slot[feat]
            hit = col >= 0
            pair = np.unique(doc[hit] * width + col[hit])
            yield i, j, m.score(pair // width, pair % width, byte_shares(b, o))

    return score


def score_chain(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, p_<category>...) for every row and whole text. Null and empty
    texts get the probabilities of a text without words. Repeated rows are
    scored alike; extra columns are ignored; an empty table gives no rows."""
    rows = pick(docs, id=key, text=text)
    model = broadcast_small(docs.sparkSession, chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = block_scorer(model.value)
        for batch in sliced(batches, 1):
            for i, j, p in score(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *[pa.array(p[:, c]) for c in range(p.shape[1])]], ["id", *[f"p_{c}" for c in model.value.categories]])

    names = ", ".join(f"p_{c} double" for c in chain.categories)
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, {names}").withColumnRenamed("id", key)


def drop_flagged(docs: DataFrame, chain: Chain, category: str, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a probability below ``threshold``; all columns
    stay. Rows are filtered where they are read, without a join."""
    model, at, c = broadcast_small(docs.sparkSession, chain), docs.columns.index(text), chain.categories.index(category)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = block_scorer(model.value)
        for batch in sliced(batches, at):
            p = [x[2][:, c] for x in score(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *p]) < threshold))

    return docs.mapInArrow(run, docs.schema)


#: The chain of the registered query: low quality first, then toxic.
CATEGORIES = ("low_quality", "toxic")
THRESHOLD = 0.4


def label_columns(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))


def score_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, toxic) of every document, by a chain
    fitted on the labelled documents of ``docs``."""
    chain = fit_chain(docs, label_columns(table(spark, sf_dir, "labels")), CATEGORIES)
    return score_chain(docs, chain).withColumn("toxic", F.col("p_toxic") >= THRESHOLD)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain probabilities and the toxic decision for all documents."""
    return score_toxicity(spark, table(spark, sf_dir, "documents"), sf_dir)
