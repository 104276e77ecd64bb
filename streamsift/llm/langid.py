"""Language identification with a byte convolutional network.

Fixed-length windows of UTF-8 bytes go through a byte embedding, filters of
several widths, ReLU, max pooling over the window and a softmax layer. The
network is trained in numpy with Adam on a bounded, per-language sample of
labelled windows. A text is cut into windows that cover all of it; its
language has the highest mean probability, weighted by the windows' bytes.

At prediction time the convolution is looked up: a filter's answer to two
neighbouring bytes is one row of a 65,536-row table, and a width-3 or width-4
answer is the sum of two rows. The result is that of the convolution.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from streamsift.llm.common import (BLOCK_BYTES, blocks, broadcast_small, buffers, durable, fill, pick, sliced, table)

WINDOW = 128
EMBED = 8
FILTERS = 12
WIDTHS = (2, 3, 4)
#: Bounds of the training sample: texts per language and windows per text.
LANG_TEXTS = 500
TEXT_WINDOWS = 4
#: More label values than this are refused (the sample is bounded per value).
MAX_LANGS = 500
EPOCHS = 4
UNKNOWN = "und"


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray            # (256, EMBED)
    filters: dict[int, np.ndarray]  # width -> (width, EMBED, FILTERS)
    shift: dict[int, np.ndarray]    # width -> (FILTERS,)
    out: np.ndarray              # (len(WIDTHS) * FILTERS, langs)
    bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.embed, *[self.filters[w] for w in WIDTHS], *[self.shift[w] for w in WIDTHS], self.out, self.bias]


def new_net(langs: list[str], seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    return Net(langs, rng.normal(0, 0.5, (256, EMBED)), {w: rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)) for w in WIDTHS},
               {w: np.zeros(FILTERS) for w in WIDTHS}, rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(langs))), np.zeros(len(langs)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def forward(net: Net, win: np.ndarray):
    """Probabilities of windows (n, WINDOW) and what backward needs."""
    x = net.embed[win]
    pooled, best, cols = [], {}, {}
    for w in WIDTHS:
        steps = win.shape[1] - w + 1
        col = np.concatenate([x[:, o:o + steps] for o in range(w)], axis=2)
        conv = col @ net.filters[w].reshape(w * EMBED, FILTERS)
        at = conv.argmax(axis=1)
        best[w], cols[w] = at, col
        pooled.append(np.take_along_axis(conv, at[:, None, :], 1)[:, 0] + net.shift[w])
    raw = np.concatenate(pooled, axis=1)
    hidden = np.maximum(raw, 0)
    return softmax(hidden @ net.out + net.bias), (raw, hidden, best, cols)


def gradients(net: Net, win: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy and its gradients, in the order of params()."""
    p, (raw, hidden, best, cols) = forward(net, win)
    n = len(win)
    loss = -np.log(np.maximum(p[np.arange(n), y], 1e-12)).mean()
    d = p.copy()
    d[np.arange(n), y] -= 1
    d /= n
    g_out, g_bias = hidden.T @ d, d.sum(axis=0)
    back = (d @ net.out.T) * (raw > 0)
    g_embed, g_f, g_s = np.zeros_like(net.embed), {}, {}
    row = np.arange(n)[:, None]
    for k, w in enumerate(WIDTHS):
        part = back[:, k * FILTERS:(k + 1) * FILTERS]
        g_s[w] = part.sum(axis=0)
        patch = cols[w][row, best[w]]                       # (n, FILTERS, w * EMBED): only winners get a gradient
        g_f[w] = np.einsum("nf,nfc->cf", part, patch).reshape(w, EMBED, FILTERS)
        for o in range(w):
            np.add.at(g_embed, win[row, best[w] + o], part[:, :, None] * net.filters[w][o].T[None])
    return float(loss), [g_embed, *[g_f[w] for w in WIDTHS], *[g_s[w] for w in WIDTHS], g_out, g_bias]


def train(windows: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Net:
    """Adam over shuffled mini-batches."""
    net, rng = new_net(langs, seed), np.random.default_rng(seed)
    params = net.params()
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), batch):
            use = order[a:a + batch]
            _, grads = gradients(net, windows[use], y[use])
            t += 1
            lr = rate * (0.5 ** epoch) * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t)
            for p, g, mm, vv in zip(params, grads, m, v):
                mm *= 0.9
                mm += 0.1 * g
                vv *= 0.999
                vv += 0.001 * g * g
                p -= lr * mm / (np.sqrt(vv) + 1e-8)
    return net


class Lookup:
    """The network with its convolutions tabulated over byte pairs."""

    def __init__(self, net: Net):
        self.net = net
        one = lambda w, o: (net.embed @ net.filters[w][o]).astype(np.float32)
        pair = lambda w, o: (one(w, o)[:, None] + one(w, o + 1)[None]).reshape(65536, FILTERS)
        self.p2, self.p3, self.p4a, self.p4b, self.t3 = pair(2, 0), pair(3, 0), pair(4, 0), pair(4, 2), one(3, 2)
        self.shift = np.concatenate([net.shift[w] for w in WIDTHS]).astype(np.float32)

    def windows(self, win: np.ndarray) -> np.ndarray:
        """Probabilities of windows (n, WINDOW) of bytes."""
        two = win[:, :-1].astype(np.int32) * 256 + win[:, 1:]
        c2 = self.p2[two].max(axis=1)
        c3 = self.p3[two[:, :-1]]
        c3 += self.t3[win[:, 2:]]
        c4 = self.p4a[two[:, :-2]]
        c4 += self.p4b[two[:, 2:]]
        hidden = np.maximum(np.concatenate([c2, c3.max(axis=1), c4.max(axis=1)], axis=1) + self.shift, 0)
        return softmax(hidden @ self.net.out + self.net.bias)


def cut(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, zero-padded at a text's end: (windows, text of
    each window, bytes in each window). An empty text has none."""
    n = np.diff(off)
    count = -(-n // WINDOW)
    doc = np.repeat(np.arange(len(n)), count)
    first = np.cumsum(count) - count
    at = off[:-1][doc] + (np.arange(len(doc)) - first[doc]) * WINDOW
    size = np.minimum(off[1:][doc] - at, WINDOW)
    padded = np.concatenate([buf, np.zeros(WINDOW, np.uint8)])
    win = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[at] if len(at) else np.zeros((0, WINDOW), np.uint8)
    short = np.flatnonzero(size < WINDOW)
    if len(short):
        win[short] *= np.arange(WINDOW) < size[short, None]
    return win, doc, size


def predict_texts(look: Lookup, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, langs): mean window probability, weighted by bytes."""
    win, doc, size = cut(buf, off)
    total = np.zeros((len(off) - 1, len(look.net.langs)))
    for a in range(0, len(win), 2048):
        p = look.windows(win[a:a + 2048]) * size[a:a + 2048, None]
        for c in range(total.shape[1]):
            total[:, c] += np.bincount(doc[a:a + 2048], weights=p[:, c], minlength=len(total))
    return total / np.maximum(np.diff(off), 1)[:, None]


def sample_windows(rows: DataFrame, texts: int = LANG_TEXTS) -> pd.DataFrame:
    """(lang, window): per language the ``texts`` labelled texts with the
    smallest key hash, and up to TEXT_WINDOWS evenly spaced windows of each."""
    slim = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    langs = slim.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} label values")
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = (slim.select("id", "lang").withColumn("at", F.row_number().over(order)).where(F.col("at") <= texts)
              .select(F.col("id").alias("pid"), F.col("lang").alias("plang")).distinct())
    one = (slim.join(F.broadcast(picked), F.col("id").eqNullSafe(F.col("pid")) & (F.col("lang") == F.col("plang")))
           .groupBy("id", "lang").agg(F.min("text").alias("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for lang, text in zip(pdf["lang"], pdf["text"]):
                raw = np.frombuffer(text.encode(), np.uint8)
                win, _, _ = cut(raw, np.array([0, len(raw)]))
                use = np.unique(np.linspace(0, len(win) - 1, min(TEXT_WINDOWS, len(win))).astype(int))
                out += [(lang, win[k].tobytes()) for k in use]
            yield pd.DataFrame(out, columns=["lang", "window"])

    return durable(one.select("lang", "text").mapInPandas(run, "lang string, window binary")).toPandas()


def fit(rows: DataFrame) -> Net | None:
    """Train on (id, text, lang); None when no row is labelled."""
    data = sample_windows(rows).sort_values(["lang", "window"])
    if not len(data):
        return None
    langs = sorted(data["lang"].unique())
    return train(np.stack([np.frombuffer(w, np.uint8) for w in data["window"]]), np.searchsorted(langs, data["lang"].to_numpy()), langs)


def identify(docs: DataFrame, net: Net | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row and whole text. Null texts and
    texts without a letter get ``und`` and score 0, and so do all texts when
    there is no model. Equal probabilities: the first language by name. Extra
    columns are ignored; an empty table gives no rows."""
    rows = pick(docs, id=key, text=text).withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    kind = dict(rows.dtypes)["id"]
    model = broadcast_small(docs.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(model.value) if model.value else None
        names = np.array([*(model.value.langs if model.value else []), UNKNOWN], object)
        for batch in sliced(batches, 1):
            letter = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            buf, off = buffers(fill(batch.column(1)))
            for i, j in blocks(off, BLOCK_BYTES):
                p = predict_texts(look, buf[off[i]:off[j]], off[i:j + 1] - off[i]) if look else np.zeros((j - i, 1))
                use = letter[i:j] & (look is not None)
                best = np.where(use, p.argmax(axis=1), len(names) - 1)
                score = np.where(use, np.clip(p.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(names[best], pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", key)


def remainder(key: str, mod: int):
    """crc32 of the key as text modulo ``mod``; a null key counts as empty."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; documents with remainder 0 are held out."""
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(remainder("doc_id", 5) != 0).select(F.col("doc_id").alias("id"), "text", "lang")
    out = identify(docs, fit(learn))
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
