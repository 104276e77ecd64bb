"""Filter audit, mixing and spelling variants against plain Python."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from streamsift.llm import audit, mixing, spelling
from llm_rows import LONG, ROWS

SMALL = "/root/testdata/sf0.001"


def duck(rows, labels=()):
    """DuckDB with documents and labels of the given rows."""
    import pandas as pd
    con = duckdb.connect()
    docs = pd.DataFrame([(r[0], r[1], r[2], r[2]) for r in rows], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})
    con.register("d0", docs)
    con.execute("CREATE VIEW documents AS SELECT doc_id, CAST(text AS VARCHAR) AS text, CAST(lang AS VARCHAR) AS lang, CAST(source AS VARCHAR) AS source FROM d0")
    con.register("l0", pd.DataFrame(list(labels), columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    con.execute("CREATE VIEW labels AS SELECT * FROM l0")
    return con


def same(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall(), key=str)
    assert got == want
    return got


# ------------------------------------------------------------------ transducer

def test_transducer_counts():
    texts = ["", " ", "a", "A b\tb\x0bB", LONG, "x" * 3000, "É é ñ 東京 $5 #a", "a b a\u0085b", "tie tie", "tie tie", "😀😀 |", "\n\n"]
    rng = np.random.default_rng(1)
    texts += ["".join(rng.choice(list("aAb $é東\n\t"), 500)) for _ in range(50)]
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    want = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        want.append([len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t))])
    assert (audit.NEXT[0] == audit.NEXT[1]).all()
    assert audit.transduce(buf, off).tolist() == want
    assert audit.transduce(buf[:0], np.zeros(1, np.int64)).shape == (0, 5)


def test_transducer_slices(monkeypatch):
    """Slices, batches of insertions and colliding hashes change nothing."""
    text = (LONG[:5000] + "Zz% " * 300 + "é" * 700).encode() * 2
    buf, off = np.frombuffer(text, np.uint8), np.array([0, 100, 100, len(text)])
    want = audit.transduce(buf, off)
    monkeypatch.setattr(audit, "STEP", 7)
    monkeypatch.setattr(audit, "INSERT", 11)
    assert (audit.transduce(buf, off) == want).all()

    class Weak(audit.SpanHash):
        def __call__(self, s, e):
            return super().__call__(s, e) & np.uint64(1)
    monkeypatch.setattr(audit, "INSERT", 1 << 18)
    monkeypatch.setattr(audit, "SpanHash", Weak)
    assert (audit.transduce(buf, off) == want).all()


# ---------------------------------------------------------------- filter audit

def brute_audit(rows, labels):
    first = {}
    for r in rows:
        if r[0] is not None:
            t = r[1] or ""
            first[t] = min(first.get(t, r[0]), r[0])
    quality, toxic = {x for x, q, _ in labels if q == 1 and x is not None}, {x for x, _, t in labels if t == 1 and x is not None}
    docs = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        docs[lang or ""].append(({f for f in fails if fails[f]}, i in quality, i in toxic))
    out = []
    for part, ds in docs.items():
        share = Counter()
        lines = []
        for order in permutations("ABCDE"):
            alive = list(range(len(ds)))
            for step, f in enumerate(order, 1):
                hit = [k for k in alive if f in ds[k][0]]
                failing = [k for k in range(len(ds)) if f in ds[k][0]]
                alive = [k for k in alive if f not in ds[k][0]]
                share[f] += len(hit)
                lines.append((part, "".join(order), step, len(alive), len(hit), len(failing) - len(hit), sum(ds[k][0] == {f} for k in failing),
                              sum(ds[k][1] for k in hit), sum(ds[k][2] for k in hit), f))
        out += [x[:9] + (share[x[9]],) for x in lines]
    return sorted(out)


WORDS = " ".join(f"w{i}" for i in range(250))
AUDIT_ROWS = ROWS + [(20, WORDS, "en"), (21, WORDS, "en"), (22, WORDS.upper(), "de"), (23, "a b " * 200, "de"), (24, WORDS + " $", None), (25, WORDS + " x", "")]
LABELS = [(20, 1, 0), (20, 0, 1), (21, None, None), (1, 1, 1), (23, 0, 1), (9, 1, 0), (999, 1, 1), (None, 1, 1)]


def test_audit(spark, empty):
    docs = spark.createDataFrame(AUDIT_ROWS, "doc_id long, text string, lang string").withColumn("part", F.lit("x")).withColumn("mask", F.lit(1)).withColumn("words", F.lit(1))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("good", F.lit(7))
    want = brute_audit(AUDIT_ROWS, LABELS)
    got = same(audit.audit(docs, labels), duck(AUDIT_ROWS, LABELS), audit.OP11_SQL)
    names = sorted(["part", "filter_order", "step", *audit.REPORT])
    assert sorted(tuple(dict(zip(names, r))[c] for c in ["part", "filter_order", "step", *audit.REPORT]) for r in got) == want
    assert len(got) == 600 * len({r[2] or "" for r in AUDIT_ROWS})
    assert audit.audit(empty, labels).count() == 0
    assert audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_text_counts(edge, empty):
    got = {(r.doc_id, r.words, r.distinct_words) for r in audit.text_counts(edge).collect()}
    assert {(8, 120_000, 3), (3, 0, 0), (4, 0, 0), (9, 3, 1), (None, 2, 2)} <= got
    assert audit.text_counts(empty).count() == 0


def test_audit_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = sorted(tuple(r) for r in audit.op11_filter_audit(spark, SMALL).select("part", "filter_order", "step", *audit.REPORT).collect())
    assert got == brute_audit(rows, labels)


# ---------------------------------------------------------------------- mixing

def brute_targets(sizes, weights=(5, 2, 1), ceiling=3):
    """Excess is handed out again and again until no target is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    stopped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(ceiling * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        target = {s: left * weight[s] / max(1, sum(weight[o] for o in open_)) if s in open_ else ceiling * sizes[s] for s in names}
        above = {s for s in open_ if target[s] > ceiling * sizes[s]}
        if not above:
            return target
        stopped |= above


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 0, None: 5}, {"z": 3, "é": 90, "b": 7, "": 40, "B": 1}, {"a": 0, "b": 0}, {"a": 7},
    {f"s{k}": (k * 37) % 101 for k in range(40)}])
def test_rates(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long").select(mixing.source_key(F.col("source")).alias("skey"), "source", "source_size")
    keys = {r.skey: r.source for r in rows.collect()}
    got = {keys[r.skey]: r for r in mixing.rates(rows.select("skey", "source_size")).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    for s, r in got.items():
        assert r.target == pytest.approx(want[s], abs=1e-9)
        assert r.rate <= 3 and (r.rate == 0) == (want[s] == 0)
    assert sum(r.target for r in got.values()) == pytest.approx(sum(sizes.values()))


def test_mix(spark, edge, empty):
    got = same(mixing.plan_mix(edge, source="lang").withColumn("taken", F.col("size") * F.col("copies")).drop("copies"), duck(ROWS), mixing.OP12_SQL)
    assert len(got) == len(ROWS)
    plan = Counter()
    for r in mixing.plan_mix(edge, source="lang").collect():
        plan[r.doc_id] += r.copies
    out = mixing.mix(edge, source="lang")
    assert out.columns == edge.columns
    taken = Counter(r.doc_id for r in out.collect())
    assert taken == +plan
    assert mixing.plan_mix(empty, source="lang").count() == 0 and mixing.mix(empty, source="lang").count() == 0
    with pytest.raises(ValueError):
        mixing.plan_mix(edge, source="lang", weights=(1, 0))


def test_mix_comes_near_targets(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.lit(1), (F.col("id") % 17 + 1).cast("int"))).alias("text"),
                                      F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    got = mixing.plan_mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("copies").alias("most")).collect()
    assert all(abs(r.taken / r.target - 1) < 0.1 and r.most <= 3 for r in got)
    assert sum(r.target for r in got) == pytest.approx(docs.select(F.sum(mixing.word_count(F.col("text")))).first()[0])
    assert not any("Python" in x or "Arrow" in x for x in mixing.plan_mix(docs)._jdf.queryExecution().toString().split())


def test_mix_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    same(mixing.op12_mixing(spark, SMALL), con, mixing.OP12_SQL)


# -------------------------------------------------------------------- spelling

def brute_words(rows, least=5):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= least}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(n, ratio=5):
    holes = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            holes[w[:k] + w[k + 1:]].add(w)
            holes[w[:k] + "\0" + w[k + 1:]].add(w)
        holes[w].add(w)
    links = defaultdict(set)
    for ws in holes.values():
        for a in ws:
            links[a] |= {b for b in ws if near(a, b)}
    form = {}
    for w in n:
        top = min(links[w], key=lambda x: (-n[x], x), default=None)
        form[w] = top if top is not None and n[top] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(links[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def tuples(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("limit", [3, 40, 20_000])
def test_variants_any_cut(spark, limit):
    """Random words over few letters, and one path that holds a third of all."""
    rng = np.random.default_rng(limit)
    words = {"".join(rng.choice(list("abkuéÿ"), rng.integers(6, 9))) for _ in range(300)}
    words |= {"".join(rng.permutation(list("abcdef"))) for _ in range(200)}
    n = {w: int(rng.integers(1, 60)) ** 2 for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert tuples(spelling.variants(df, limit=limit)) == brute_variants(n)


def test_one_edit():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("ab"), rng.integers(1, 6))) for _ in range(150)]
    pairs = [(a, b) for a in words for b in words if len(b) - len(a) in (0, 1)]
    (x, xo), (y, yo) = spelling.letters([p[0] for p in pairs]), spelling.letters([p[1] for p in pairs])
    got = spelling.one_edit((x, xo[:-1], np.diff(xo)), (y, yo[:-1], np.diff(yo)))
    assert got.tolist() == [near(a, b) for a, b in pairs]


def test_word_counts(spark, edge, empty):
    rows = [(r[0], r[1]) for r in ROWS] + [(k, "Straße straße STRASSE Àéîõü naïveté") for k in range(9000)] + [(5, "x" * 5000)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("h", F.lit(1))
    assert {r.word: r.n for r in spelling.word_counts(df).collect()} == brute_words(rows)
    assert len([w for w in brute_words(rows) if near(w, "naïveté")]) >= 3
    assert spelling.spelling_variants(empty).count() == 0
    assert tuples(spelling.spelling_variants(df)) == brute_variants(brute_words(rows))
    with pytest.raises(ValueError):
        spelling.variants(df.select("word", F.lit(1).alias("n")), ratio=1)


def test_spelling_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert tuples(spelling.op13_spelling_variants(spark, SMALL)) == brute_variants(brute_words(rows))
