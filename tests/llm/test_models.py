"""Learned operators: gradients, normalisation, plain versions of the scores
and held-out accuracy."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_rows import ROWS
from streamsift.llm import langid, lm, toxicity

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# ---------------------------------------------------------------- toxicity

def corpus(spark, seed=1, n=1500):
    """Texts with rare insults (also as unseen forms of a stem) and labels."""
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abdefghiklmnoprstu"), rng.integers(3, 9))) for _ in range(3000)]
    rows = []
    for i in range(n):
        w = list(rng.choice(vocab, rng.integers(20, 400)))
        toxic, junk = int(rng.random() < 0.2), int(rng.random() < 0.2)
        if toxic:
            for _ in range(1 + len(w) // 60):
                w[rng.integers(len(w))] = "zxgrol" + rng.choice(list("aeiou")) + rng.choice(list("aeiou")) if rng.random() < 0.6 else "qurk"
        if junk:
            w = [x + "### spamword" for x in w]
        rows.append((i, " ".join(w), junk, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, junk int, toxic int")


def test_chain_held_out(spark):
    df = corpus(spark).cache()
    labels = df.where("doc_id % 2 = 0").select("doc_id", "junk", "toxic")
    chain = toxicity.fit_chain(df.select("doc_id", "text"), labels, ["junk", "toxic"])
    assert len(chain.weights[1]["earlier"]) == 1 and len(chain.weights[0]["earlier"]) == 0
    held = toxicity.score_chain(df, chain).join(df.where("doc_id % 2 = 1").select("doc_id", "junk", "toxic"), "doc_id").collect()
    assert np.mean([(r.p_toxic >= 0.5) == bool(r.toxic) for r in held]) > 0.98
    assert np.mean([(r.p_junk >= 0.5) == bool(r.junk) for r in held]) > 0.98
    left = toxicity.drop_flagged(df, chain, "toxic", 0.5)
    assert left.columns == df.columns
    flagged = {r.doc_id for r in toxicity.score_chain(df, chain).where("p_toxic >= 0.5").collect()}
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in df.collect()} - flagged


def test_labels_without_texts_take_no_place(spark):
    """The bound on the sample holds for labelled texts that exist."""
    df = corpus(spark, n=200)
    labels = df.select("doc_id", "junk", "toxic").unionByName(spark.range(1000, 9000).selectExpr("id doc_id", "0 junk", "0 toxic"))
    assert toxicity.labelled_sample(df, labels, ["junk", "toxic"], "doc_id", "text", 300).count() == 200
    assert toxicity.labelled_sample(df, labels, ["junk", "toxic"], "doc_id", "text", 150).count() == 150


def test_score_equals_plain_sum(spark):
    """The numpy blocks against word-by-word scoring of the same model."""
    df = corpus(spark, n=300).cache()
    chain = toxicity.fit_chain(df.select("doc_id", "text"), df.select("doc_id", "junk", "toxic"), ["junk", "toxic"])
    got = {r.doc_id: (r.p_junk, r.p_toxic) for r in toxicity.score_chain(df, chain).collect()}
    col = {int(f): k for k, f in enumerate(chain.feats)}
    for r in df.limit(20).collect():
        hits = set()
        for w in re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", r.text.lower()):
            raw = np.frombuffer(w.encode(), np.uint8)
            for k in toxicity.PARTS:
                if len(raw) >= k:
                    end = len(raw) if k == 0 else k
                    h = toxicity.mix(toxicity.SpanHash(raw)(np.array([0]), np.array([end])), k + 1)[0]
                    hits.add(col.get(int(h >> np.uint64(64 - toxicity.SPACE_BITS))))
        hits.discard(None)
        dense = toxicity.byte_shares(np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())]))[0]
        p = []
        for m in chain.weights:
            z = sum(m["sparse"][k] for k in hits) + dense @ m["dense"] + m["bias"] + sum(a * b for a, b in zip(p, m["earlier"]))
            p.append(1 / (1 + math.exp(-z)))
        assert np.allclose(p, got[r.doc_id], atol=1e-6)


def test_out_of_fold_and_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x @ [2, -1, 0, 0, 0] + rng.logistic(size=400) > 0).astype(float)
    w, b = toxicity.fit_logistic(x, y, l1=0, l2=0, rounds=3000)
    grad = x.T @ (toxicity.sigmoid(x @ w + b) - y) / 400
    assert np.abs(grad).max() < 1e-4
    w, b = toxicity.fit_logistic(x, np.zeros(400))
    assert not w.any() and toxicity.sigmoid(np.array(b)) < 0.01


def test_toxicity_edge_cases(spark, edge, empty):
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 1), (4, 0, 0), (8, 1, 0), (9, 0, 1), (9, 1, 1), (None, 1, 1), (6, None, 1), (777, 1, 1)], "doc_id long, quality int, toxic int") \
        .withColumn("text", F.lit("clash"))
    lab = toxicity.label_columns(labels)
    chain = toxicity.fit_chain(edge, lab, toxicity.CATEGORIES)
    got = toxicity.score_chain(edge, chain).collect()
    assert len(got) == len(ROWS) and all(0 <= r.p_toxic <= 1 for r in got)
    assert toxicity.score_chain(empty, chain).count() == 0
    none = toxicity.fit_chain(empty, lab.limit(0), toxicity.CATEGORIES)
    assert all(abs(r.p_toxic - 0.5) < 1e-9 for r in toxicity.score_chain(edge, none).collect())


def test_toxicity_of_given_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    got = toxicity.op1_toxicity(spark, MID).collect()
    assert len(got) == spark.read.parquet(f"{MID}/documents.parquet").count()
    known = [(r.toxic, labels[r.doc_id]) for r in got if r.doc_id in labels]
    assert sum(p and not t for p, t in known) <= 3 and sum(p and t for p, t in known) >= 0.6 * sum(t for _, t in known)


def test_many_rare_toxic_words(spark):
    """1,200 toxic words of one feature each, every one in three training
    texts; a toxic text holds one of them, all texts have 12 words."""
    rng = np.random.default_rng(8)
    vocab = rng.permutation(["".join(x) for x in itertools.product("bcdfghklmnoprst", repeat=3)]).tolist()
    bad, clean = vocab[:1200], vocab[1200:1400]
    held = 7200
    words = [[w] for w in bad * 3] + [[]] * 3600 + [[bad[k]] for k in rng.choice(1200, 600, replace=False)] + [[]] * 600
    rows = [(i, " ".join([*w, *rng.choice(clean, 12 - len(w))]), len(w)) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = toxicity.fit_chain(df.select("doc_id", "text"), df.where(F.col("doc_id") < held).select("doc_id", "toxic"), ["toxic"])
    got = {r.doc_id: r.p_toxic >= toxicity.THRESHOLD for r in toxicity.score_chain(df.where(F.col("doc_id") >= held), chain).collect()}
    assert sum(got[i] for i, _, y in rows[held:] if y) >= 0.95 * 600
    assert sum(got[i] for i, _, y in rows[held:] if not y) <= 0.2 * 600   # 70 of the 600 are flagged with 1,500 features


# ------------------------------------------------------------- language model

def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode())


def brute_base(rows, held):
    c = Counter()
    for (d, t), h in zip(rows, held):
        if not h:
            c.update(split(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for (d, t), h in zip(rows, held):
        toks = [*split(t), None]
        out.append((d, h, len(toks), sum(c[x] > 0 for x in toks), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in toks), 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("lookup", [1 << 18, 40])
def test_base_scores(spark, monkeypatch, lookup):
    """Also with a small lookup table, so that most words are joined."""
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (lm.SHORTLIST, lm.CLASSES, lookup))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    got = lm.op5_lm_scoring(spark, SMALL).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute_base(rows, held)


def test_lm_edge_cases(spark, edge, empty):
    held = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)) == 2
    rows = [(r[0], r[1]) for r in ROWS]
    got = lm.lm_scores(edge, held).collect()
    want = brute_base(rows, [(d or 0) % 3 == 2 for d, _ in rows])
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    assert all(r.score < 0 for r in got)
    assert lm.lm_scores(empty, held).count() == 0
    unseen = lm.lm_scores(edge, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in unseen)


def model(spark):
    df = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text")
    counts = lm.count_words(df)
    voc = lm.vocabulary(counts, df.count())
    return df, counts, voc, lm.fit(df, voc)


def test_lm_is_a_distribution_and_learns(spark):
    df, counts, voc, p = model(spark)
    full = p | {"t32": p["t"].T.astype(np.float32), "b32": p["b"].astype(np.float32)}
    k = len(p["b"])
    for w1, w2 in ((0, 0), (3, 1), (k - 1, 5)):
        w = np.arange(k)
        assert abs((10 ** lm.symbol_log10(full, w, np.full(k, w1), np.full(k, w2))).sum() - 1) < 1e-4
    # inside a class: counted words and one unseen word add up to 1
    words = {(bytes(r["word"]), r["class"]): r["c"] for r in counts.collect()}
    short = set(voc.short.tolist())
    for c in (0, 7, 100):
        inside = [n for (w, cc), n in words.items() if cc == c and int(lm.keys_of([w])[0]) not in short]
        assert sum(n + 1 for n in inside) + 1 == voc.class_total[c]
    r = lm.op5_lm_scoring(spark, MID).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_nce_gradient():
    rng = np.random.default_rng(3)
    k, d, b = 12, 4, 9
    p = {"r": rng.normal(size=(k, d)), "t": rng.normal(size=(k, d)), "b": rng.normal(size=k), "c1": rng.normal(size=d), "c2": rng.normal(size=d)}
    w, w1, w2 = (rng.integers(0, k, b) for _ in range(3))
    weight, noise, log_noise = rng.random(b), rng.integers(0, k, 5), np.log(np.full(k, 1 / k))

    def value(p):
        q = p["c1"] * p["r"][w1] + p["c2"] * p["r"][w2]
        pos = (q * p["t"][w]).sum(1) + p["b"][w] - np.log(5) - log_noise[w]
        neg = q @ p["t"][noise].T + p["b"][noise] - np.log(5) - log_noise[noise]
        return (weight * -np.log1p(np.exp(-pos))).sum() - (weight[:, None] * np.log1p(np.exp(neg))).sum()
    g = lm.nce_gradients(p, w, w1, w2, weight, noise, log_noise)
    for name in p:
        at = tuple(rng.integers(0, s) for s in p[name].shape)
        hi, lo = {n: x.copy() for n, x in p.items()}, {n: x.copy() for n, x in p.items()}
        hi[name][at] += 1e-5
        lo[name][at] -= 1e-5
        assert abs((value(hi) - value(lo)) / 2e-5 - g[name][at]) < 1e-5


# ------------------------------------------------------------------ languages

def test_lookup_equals_convolution():
    rng = np.random.default_rng(0)
    net = langid.new_net(["a", "b", "c"])
    for w in langid.WIDTHS:
        net.shift[w][:] = rng.normal(size=langid.FILTERS)
    win = rng.integers(0, 256, (7, langid.WINDOW)).astype(np.uint8)
    assert np.allclose(langid.forward(net, win)[0], langid.Lookup(net).windows(win), atol=1e-4)


def test_network_gradient():
    rng = np.random.default_rng(1)
    net = langid.new_net(["a", "b", "c"])
    win, y = rng.integers(97, 110, (5, 20)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, grads = langid.gradients(net, win, y)
    for p, g in zip(net.params(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = p[at]
        p[at] = keep + 1e-5
        hi = langid.gradients(net, win, y)[0]
        p[at] = keep - 1e-5
        lo = langid.gradients(net, win, y)[0]
        p[at] = keep
        assert abs((hi - lo) / 2e-5 - g[at]) < 1e-6


def test_windows_cover_texts():
    texts = [b"", b"x", bytes(range(1, 200)) * 3, b"y" * langid.WINDOW]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    win, doc, size = langid.cut(buf, off)
    for k, t in enumerate(texts):
        assert b"".join(w[:n].tobytes() for w, n in zip(win[doc == k], size[doc == k])) == t
        assert all(not w[n:].any() for w, n in zip(win, size))


def test_language_of_given_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    got = langid.op10_language_id(spark, MID).collect()
    assert {r.doc_id for r in got} == set(lang) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_language_edge_cases(spark, edge, empty):
    train_rows = edge.selectExpr("doc_id id", "text", "lang")
    net = langid.fit(train_rows)
    got = langid.identify(edge, net).collect()
    assert len(got) == len(ROWS)
    by = Counter((r.doc_id, r.lang_pred == langid.UNKNOWN) for r in got)
    no_letter = Counter((r[0], not any(c.isalpha() for c in r[1] or "")) for r in ROWS)
    assert by == no_letter
    assert all(r.score == 0 for r in got if r.lang_pred == langid.UNKNOWN)
    assert langid.identify(empty, net).count() == 0
    assert langid.fit(train_rows.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(edge, None).collect()} == {langid.UNKNOWN}
