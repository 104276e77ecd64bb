"""Language-model scoring: counts over the corpus and a log-bilinear model.

Tokens are the runs of non-white-space bytes of the lower-cased text (A-Z) and
one end token. Two scores are made per text:

* base: add-one unigram log10 probabilities from the token counts of the
  training texts;
* model: P(token | two tokens before) = P(symbol | context) * P(token | symbol).
  Symbols are the end, the most frequent words, and classes of all other words
  by their last bytes. P(symbol | context) is a log-bilinear network,
  ``softmax((c1 * r[w1] + c2 * r[w2]) . t + b)``, trained by noise-contrastive
  estimation and normalised over all symbols when scoring. P(token | class) is
  the add-one count within the class, so the whole is a distribution.

Counts, training and scoring pass over all texts. Training is data-parallel:
each task runs NCE steps over its own texts from common start values, and the
parameters are averaged by a Spark aggregation. Frequent words are looked up
in a broadcast table of bounded size; all other words are joined with the full
count table by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamsift.llm.common import (TOKEN_BYTES, SpanHash, binary_array, blocks, broadcast_small, buffers, durable,
                                   fill, list_array, mix, pick, ragged, sliced, spans, table)
from streamsift.llm.langid import remainder

SHORTLIST = 191
CLASSES = 320
SYMBOLS = 1 + SHORTLIST + CLASSES      # symbol 0 is the end (and the start context)
DIM = 24
#: Words in the broadcast count table at most.
LOOKUP_WORDS = 1 << 18
NOISE = 64
BATCH = 4096
RATE = 0.15
#: Tokens that one training replica sees at least, if the corpus has them.
REPLICA_TOKENS = 2_000_000
COUNT_BLOCK = 4 << 20


def tokens(buf: np.ndarray, off: np.ndarray):
    """Starts, ends, texts and 64-bit keys of the words of a block."""
    s, e, doc = spans(buf, off, TOKEN_BYTES)
    key = SpanHash(buf)(s, e) if len(s) else np.zeros(0, np.uint64)
    return s, e, doc, key


def word_class(buf: np.ndarray, s: np.ndarray, e: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of words by a hash of their last three bytes."""
    if not len(s):
        return np.zeros(0, np.int32)
    tail = np.zeros(len(s), np.uint64)
    for k in (1, 2, 3):
        at = np.maximum(e - k, s)
        tail = tail * np.uint64(257) + np.where(e - k >= s, buf[at].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix(tail, 5) % np.uint64(classes)).astype(np.int32)


def count_words(rows: DataFrame, classes: int = CLASSES) -> DataFrame:
    """(word, class, c) over all texts of ``rows`` (text). Tasks add up
    repeats inside blocks before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            buf, off = buffers(pc.ascii_lower(fill(batch.column(0))))
            for i, j in blocks(off, COUNT_BLOCK):
                b = buf[off[i]:off[j]]
                s, e, _, key = tokens(b, off[i:j + 1] - off[i])
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                s, e = s[first], e[first]
                for a in range(0, len(s), 200_000):
                    x, y = s[a:a + 200_000], e[a:a + 200_000]
                    yield pa.RecordBatch.from_arrays([binary_array(ragged(b, x, y - x), y - x), pa.array(word_class(b, x, y, classes), pa.int32()),
                                                      pa.array(n[a:a + 200_000], pa.int64())], ["word", "class", "c"])

    return rows.select("text").mapInArrow(run, "word binary, class int, c long").groupBy("word", "class").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What scoring needs of the counts, all of it of bounded size."""

    n: int                       # training tokens, ends included
    v: int                       # distinct training tokens, the end included
    ends: int
    short: np.ndarray            # sorted keys of the shortlist
    short_symbol: np.ndarray
    keys: np.ndarray             # sorted keys of the lookup words
    counts: np.ndarray
    class_total: np.ndarray      # N_class + V_class + 1 over words off the shortlist
    unigram: np.ndarray          # probability of each symbol
    classes: int


def keys_of(words: list[bytes]) -> np.ndarray:
    off = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    buf = np.frombuffer(b"".join(words), np.uint8)
    return SpanHash(buf)(off[:-1], off[1:]) if words else np.zeros(0, np.uint64)


def vocabulary(counts: DataFrame, texts: int, shortlist: int = SHORTLIST, classes: int = CLASSES, lookup: int = LOOKUP_WORDS) -> Vocabulary:
    top = [(bytes(r["word"]), r["class"], r["c"]) for r in counts.orderBy(F.desc("c"), "word").limit(shortlist).collect()]
    level = F.floor(F.log2("c") * 16).cast("int")   # a few hundred levels for any corpus
    levels = sorted(((r["level"], r["w"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("w")).collect()), reverse=True)
    floor, seen = None, 0
    for lv, w in levels:
        if seen + w > lookup:
            break
        floor, seen = lv, seen + w
    listed = counts.where(level >= floor).select("word", "c").toPandas() if floor is not None else None
    by_class = counts.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    cls_n, cls_v = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for r in by_class:
        cls_n[r["class"]], cls_v[r["class"]] = r["n"], r["v"]
    words_n, words_v = int(cls_n.sum()), int(cls_v.sum())
    for _, c, n in top:
        cls_n[c] -= n
        cls_v[c] -= 1
    uni = np.zeros(1 + shortlist + classes)
    uni[0] = texts
    uni[1:1 + len(top)] = [n for _, _, n in top]
    uni[1 + shortlist:] = cls_n
    uni += 0.5
    short = keys_of([w for w, _, _ in top])
    order = np.argsort(short)
    known = {w: n for w, _, n in top} | (dict(zip(map(bytes, listed["word"]), listed["c"])) if listed is not None else {})
    keys, c = keys_of(list(known)), np.fromiter(known.values(), np.int64, len(known))
    at = np.argsort(keys)
    return Vocabulary(words_n + texts, words_v + (texts > 0), texts, short[order], order.astype(np.int32) + 1, keys[at], c[at],
                      cls_n + cls_v + 1, uni / uni.sum(), classes)


def find(keys: np.ndarray, values: np.ndarray, key: np.ndarray, default) -> np.ndarray:
    """values of keys, or the default."""
    out = np.full(len(key), default, values.dtype)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        out[hit] = values[at[hit]]
    return out


def symbols(voc: Vocabulary, buf, s, e, key) -> np.ndarray:
    sym = find(voc.short, voc.short_symbol, key, 0)
    rest = sym == 0
    sym[rest] = 1 + (len(voc.unigram) - 1 - voc.classes) + word_class(buf, s[rest], e[rest], voc.classes)
    return sym


def sequence(sym: np.ndarray, doc: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token with the ends: symbol, the two before it, and the text."""
    n = np.bincount(doc, minlength=texts)
    out = np.zeros(len(sym) + texts, np.int64)
    where = np.arange(len(sym)) + doc
    out[where] = sym
    owner = np.repeat(np.arange(texts), n + 1)
    pos = np.arange(len(out)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    w1 = np.where(pos >= 1, np.concatenate([[0], out[:-1]]), 0)
    w2 = np.where(pos >= 2, np.concatenate([[0, 0], out[:-2]])[:len(out)], 0)
    return out, w1, w2, owner


def start(voc: Vocabulary, dim: int = DIM, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    k = len(voc.unigram)
    return {"r": rng.normal(0, 0.3, (k, dim)), "t": rng.normal(0, 0.05, (k, dim)), "b": np.log(voc.unigram),
            "c1": np.ones(dim), "c2": np.full(dim, 0.5)}


def spread(index: np.ndarray, grad: np.ndarray, rows: int) -> np.ndarray:
    """Sum of gradient rows by index."""
    d = grad.shape[1]
    return np.bincount((index[:, None] * d + np.arange(d)).ravel(), weights=grad.ravel(), minlength=rows * d).reshape(rows, d)


def nce_gradients(p: dict, w, w1, w2, weight, noise, log_noise) -> dict[str, np.ndarray]:
    """Ascent gradients of the weighted NCE objective of a batch, whose noise
    words are shared by all its tokens."""
    k, j = len(p["b"]), len(noise)
    r1, r2 = p["r"][w1], p["r"][w2]
    q = p["c1"] * r1 + p["c2"] * r2
    shift = np.log(j) + log_noise
    pos = weight * (1 - 1 / (1 + np.exp(-((q * p["t"][w]).sum(1) + p["b"][w] - shift[w]))))
    neg = -weight[:, None] / (1 + np.exp(-(q @ p["t"][noise].T + p["b"][noise] - shift[noise])))
    dq = pos[:, None] * p["t"][w] + neg @ p["t"][noise]
    g = {"t": spread(w, pos[:, None] * q, k), "b": np.bincount(w, weights=pos, minlength=k)}
    np.add.at(g["t"], noise, neg.T @ q)
    np.add.at(g["b"], noise, neg.sum(0))
    g["r"] = spread(w1, dq * p["c1"], k) + spread(w2, dq * p["c2"], k)
    g["c1"], g["c2"] = (dq * r1).sum(0), (dq * r2).sum(0)
    return g


def nce_train(p: dict, stats: dict, w, w1, w2, log_noise, cum_noise, rng) -> None:
    """Adagrad steps over the distinct (context, token) triples of a block."""
    k = len(p["b"])
    code, n = np.unique((w2 * k + w1) * k + w, return_counts=True)
    order = rng.permutation(len(code))
    for a in range(0, len(code), BATCH):
        c, weight = code[order[a:a + BATCH]], n[order[a:a + BATCH]].astype(float)
        noise = np.minimum(np.searchsorted(cum_noise, rng.random(NOISE)), k - 1)
        g = nce_gradients(p, c % k, c // k % k, c // (k * k), weight / weight.sum(), noise, log_noise)
        for name, grad in g.items():
            stats[name] += grad * grad
            p[name] += RATE * grad / np.sqrt(stats[name] + 1e-8)


def fit(rows: DataFrame, voc: Vocabulary) -> dict[str, np.ndarray]:
    """Parameter averages over replicas, weighted by their tokens. The number
    of replicas grows with the corpus; what comes back is one model."""
    shared = broadcast_small(rows.sparkSession, voc)
    shapes = {name: x.shape for name, x in start(voc).items()}
    size = sum(int(np.prod(s)) for s in shapes.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, seen = shared.value, 0
        p = start(v)
        stats = {name: np.full_like(x, 1e-3) for name, x in p.items()}
        log_noise, cum, rng = np.log(v.unigram), np.cumsum(v.unigram), np.random.default_rng(TaskContext.get().partitionId())
        for batch in sliced(batches, 0):
            buf, off = buffers(pc.ascii_lower(fill(batch.column(0))))
            for i, j in blocks(off):
                b = buf[off[i]:off[j]]
                s, e, doc, key = tokens(b, off[i:j + 1] - off[i])
                w, w1, w2, _ = sequence(symbols(v, b, s, e, key), doc, j - i)
                nce_train(p, stats, w, w1, w2, log_noise, cum, rng)
                seen += len(w)
        if seen:
            flat = np.concatenate([p[name].ravel() for name in shapes])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(flat * seen), pa.array(np.full(size, float(seen)))], ["at", "wx", "w"])

    replicas = max(rows.sparkSession.sparkContext.defaultParallelism, -(-voc.n // REPLICA_TOKENS))
    mean = (rows.select("text").coalesce(replicas).mapInArrow(run, "at int, wx double, w double")
            .groupBy("at").agg((F.sum("wx") / F.sum("w")).alias("x")).toPandas())
    if not len(mean):
        return start(voc)
    flat = np.zeros(size)
    flat[mean["at"].to_numpy()] = mean["x"].to_numpy()
    out, at = {}, 0
    for name, shape in shapes.items():
        n = int(np.prod(shape))
        out[name] = flat[at:at + n].reshape(shape)
        at += n
    return out


def symbol_log10(p: dict, w, w1, w2) -> np.ndarray:
    """Normalised log10 P(w | w1, w2): each distinct context is multiplied
    with all symbols once."""
    k = len(p["b"])
    ctx, back = np.unique(w2 * k + w1, return_inverse=True)
    order = np.argsort(back, kind="stable")
    first = np.concatenate([np.searchsorted(back[order], np.arange(0, len(ctx), 4096)), [len(back)]])
    out = np.empty(len(w))
    for a in range(len(first) - 1):
        c = ctx[a * 4096:(a + 1) * 4096]
        q = p["c1"] * p["r"][c % k] + p["c2"] * p["r"][c // k]
        z = q.astype(np.float32) @ p["t32"] + p["b32"]
        top = z.max(axis=1)
        norm = np.log(np.exp(z - top[:, None]).sum(axis=1)) + top
        use = order[first[a]:first[a + 1]]
        row = back[use] - a * 4096
        out[use] = (z[row, w[use]] - norm[row]) / np.log(10)
    return out


def score_texts(rows: DataFrame, counts: DataFrame, voc: Vocabulary, params: dict) -> DataFrame:
    """Scores of (id, held_out, text) rows: one output row per input row."""
    spark = rows.sparkSession
    model = broadcast_small(spark, (voc, params | {"t32": params["t"].T.astype(np.float32).copy(), "b32": params["b"].astype(np.float32)}))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = model.value
        done = TaskContext.get().partitionId() << 36
        for batch in sliced(batches, 2):
            buf, off = buffers(pc.ascii_lower(fill(batch.column(2))))
            for i, j in blocks(off):
                b, m = buf[off[i]:off[j]], j - i
                s, e, doc, key = tokens(b, off[i:j + 1] - off[i])
                sym = symbols(v, b, s, e, key)
                w, w1, w2, owner = sequence(sym, doc, m)
                n = np.bincount(owner, minlength=m)
                score = np.bincount(owner, weights=symbol_log10(p, w, w1, w2), minlength=m)
                c = find(v.keys, v.counts, key, 0)
                gain = np.log10(c + 1.0)
                off_list = sym > len(v.unigram) - 1 - v.classes
                inside = np.where(off_list, gain - np.log10(v.class_total[np.maximum(sym - (len(v.unigram) - v.classes), 0)]), 0.0)
                score += np.bincount(doc, weights=inside, minlength=m)
                base = np.bincount(doc, weights=gain, minlength=m) + np.log10(v.ends + 1.0) - n * np.log10(v.n + v.v + 1.0)
                known = np.bincount(doc, weights=c > 0, minlength=m).astype(np.int64) + (v.ends > 0)
                rare = np.flatnonzero(c == 0)   # not in the lookup table: joined with all counts later
                pair, first, times = np.unique(np.stack([doc[rare].astype(np.uint64), key[rare]], 1), axis=0, return_index=True, return_counts=True) if len(rare) else (np.zeros((0, 2), np.uint64), rare, rare)
                at = rare[first] if len(rare) else rare
                words = binary_array(ragged(b, s[at], (e - s)[at]), (e - s)[at])
                per = np.bincount(pair[:, 0].astype(np.int64), minlength=m)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(done + np.arange(m), pa.int64()), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                     pa.array(base), pa.array(score), lists, list_array(times, per, pa.int32())],
                    ["id", "held_out", "row", "n_tokens", "n_known", "base", "score", "words", "times"])
                done += m

    part = durable(rows.select("id", "held_out", "text").mapInArrow(
        run, f"id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, score double, words array<binary>, times array<int>"))
    rare = part.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = (rare.join(counts.select("word", "c"), "word")
             .groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("gain")))
    zero = F.lit(0.0)
    return (part.drop("words", "times").join(found, "row", "left")
            .select("id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                    F.lit(voc.n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("gain", zero)).alias("base_score"),
                    (F.col("score") + F.coalesce("gain", zero)).alias("score")))


def lm_scores(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every row; learns from rows where ``held_out`` is false.

    Null and empty texts are one end token. Repeated rows are counted and
    scored one by one. Words longer than a batch, or any other bytes, are
    words like others. With no training text the counts are 0, the base is
    that of unseen tokens and the model keeps its start values. Extra columns
    are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), held_out.alias("held_out"), F.col(f"`{text}`").alias("text"))
    learn = rows.where(~F.col("held_out"))
    counts = durable(count_words(learn))
    voc = vocabulary(counts, learn.count())
    return score_texts(rows, counts, voc, fit(learn, voc)).withColumnRenamed("id", key)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those with remainder 2 are held out of training."""
    docs = table(spark, sf_dir, "documents")
    return lm_scores(pick(docs, doc_id="doc_id", text="text"), remainder("doc_id", 7) == 2)
