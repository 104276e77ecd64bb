"""Near-duplicate classes and decontamination against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from streamsift.llm import decontam, minhash
from llm_rows import ROWS

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"(?:[a-z0-9]|[^\x00-\x7f])+")


def words(t):
    return WORD.findall((t or "").lower())


def grams(ws):
    return Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else Counter([tuple(ws)] if ws else [])


def jac(a, b, weighting="count"):
    if weighting == "binary":
        a, b = Counter(dict.fromkeys(a, 1)), Counter(dict.fromkeys(b, 1))
    low = sum((a & b).values())
    return low / max(1, sum(a.values()) + sum(b.values()) - low)


def brute_classes(rows, weighting="binary", threshold=0.8):
    """Class of every row: the smallest id of its component."""
    g = [grams(words(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    index = defaultdict(list)
    for i, c in enumerate(g):
        for s in c:
            index[s].append(i)
        if not c:
            index["t" + (rows[i][1] or "").lower()].append(i)
    pairs = {(a, b) for v in index.values() for a in v for b in v if a < b}
    for a, b in pairs:
        if (not g[a] and not g[b]) or jac(g[a], g[b], weighting) >= threshold:
            parent[root(a)] = root(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    n = Counter(root(i) for i in range(len(rows)))
    return sorted(((d, low.get(root(i)), n[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def classes(df, **kw):
    return sorted(((r.doc_id, r.class_id, r.class_size) for r in minhash.near_duplicates(df, **kw).collect()), key=str)


def variants(rng, base, n, edits):
    vocab = [f"w{i}" for i in range(5000)]
    out = []
    for _ in range(n):
        w = list(base)
        for p in rng.choice(len(w), edits, replace=False):
            w[p] = vocab[rng.integers(5000)]
        out.append(" ".join(w))
    return out


def test_signature_agreement_is_weighted_similarity():
    rng = np.random.default_rng(1)
    for sizes in (8, 300, 4000):
        elems = np.sort(rng.integers(0, 2**63, sizes).astype(np.uint64))
        wa, wb = rng.integers(0, 4, sizes).astype(float), rng.integers(0, 4, sizes) + rng.random(sizes).round(2)
        a, b = wa > 0, wb > 0
        sig = minhash.signatures(np.concatenate([elems[a], elems[b]]), np.concatenate([wa[a], wb[b]]), np.array([a.sum(), b.sum()]))
        want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / minhash.COORDS) + 0.01
    # a signature does not depend on what it is computed with
    again = minhash.signatures(elems[b], wb[b], np.array([b.sum()]))
    assert (again[0] == sig[1]).all()


def test_classes_of_given_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert classes(df) == brute_classes(rows)


@pytest.mark.parametrize("weighting", ["binary", "count"])
def test_classes_of_planted_groups(spark, weighting):
    """A tight group, a star whose copies only meet in the original, a chain,
    a passage that unrelated texts share, short texts and exact copies."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"t{x}" for x in rng.integers(0, 4000, n)]
    texts = []
    base = word(200)
    texts += variants(rng, base, 40, 1)
    star = word(170)
    texts += variants(rng, star, 30, 3) + [" ".join(star)]
    chain = word(300)
    for step in range(8):
        chain = chain[:step * 8] + word(8) + chain[step * 8 + 8:]
        texts.append(" ".join(chain))
    passage = word(60)
    texts += [" ".join(word(n) + passage + word(n)) for n in (2, 3, 4, 5, 8, 13, 20, 30, 40, 60) for _ in range(6)]
    texts += ["one two", "one two", "One, two!", "one two three", "", "", "...", texts[0], texts[0].upper(), "rep " * 50, "rep " * 60]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert classes(df, weighting=weighting) == brute_classes(rows, weighting)


def test_blocks_of_a_bucket(spark, monkeypatch):
    """Blocks far smaller than the buckets give the same classes."""
    rng = np.random.default_rng(6)
    star = [f"t{x}" for x in rng.integers(0, 4000, 120)]
    rows = list(enumerate(variants(rng, star, 50, 2) + [" ".join(star)]))
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 4)
    assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == brute_classes(rows)


def test_shares_of_a_hub(spark, monkeypatch):
    """Hubs with more pairs than a share, and slices of single rows."""
    rng = np.random.default_rng(7)
    rows = list(enumerate(variants(rng, [f"t{x}" for x in rng.integers(0, 4000, 150)], 60, 1) + variants(rng, [f"u{x}" for x in range(90)], 20, 4)))
    monkeypatch.setattr(minhash, "HUB_PAIRS", 7)
    monkeypatch.setattr(minhash, "SET_BYTES", 1)
    assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == brute_classes(rows)
    with pytest.raises(ValueError):
        minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.5)


def test_near_edge_cases(edge, empty):
    assert classes(edge) == brute_classes([(r[0], r[1]) for r in ROWS])
    assert classes(empty) == []


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (150, 2))] + [(i, i + 1) for i in range(1000, 1200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.rep: r.comp for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def brute_leaks(rows, items, threshold=0.8):
    out = set()
    for d, t in rows:
        w = words(t)
        for i, it in items:
            x = words(it)
            if not x or not w:
                continue
            n, want, best = len(x), grams(x), 0.0
            for p in range(len(w)):
                win = w[p:p + n]
                if len(win) >= min(5, n):
                    size = min(5, n)
                    have = Counter(tuple(win[k:k + size]) for k in range(len(win) - size + 1))
                    best = max(best, jac(have, want))
            if best >= threshold:
                out.add((d, i, round(best, 9)))
    return out


def test_leaks_planted(spark):
    rng = np.random.default_rng(9)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 3000, n)]
    items = [(k, " ".join(word(n))) for k, n in enumerate((60, 45, 37, 30, 20, 15, 9, 5, 4, 2, 1))] + [(50, ""), (51, None), (52, "!!!")]
    items += [(60, items[0][1]), (61, "same same same same same same same same")]
    rows = []
    for k, (i, t) in enumerate(items):
        x = (t or "").split()
        for edit in range(5):
            y = list(x)
            if y and edit == 1:
                y[-1] = "changed"
            if y and edit == 2:
                y[len(y) // 2] = "changed"
            if y and edit == 3:
                y.insert(len(y) - 1, "added")
            if y and edit == 4:
                y = [", ".join(y).upper() + "!"]
            rows.append((100 * k + edit, " ".join(word(int(rng.integers(0, 40))) + y + word(int(rng.integers(0, 40))))))
    rows += [(9000, items[0][1]), (9001, " ".join(items[0][1].split()[:50])), (9002, None), (9003, ""), (9003, items[3][1]), (9003, items[3][1]), (9004, "same " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' item_id", "1 start", "'y' id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'z' doc_id")
    got = decontam.find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in got} == brute_leaks(rows, items)
    assert sum(r.doc_id == 9003 and r.item_id == 3 for r in got) == 2
    left = decontam.drop_leaked(df, bench)
    assert left.columns == df.columns
    bad = {(d, t) for d, t in rows if brute_leaks([(d, t)], items)}
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(r for r in rows if r not in bad)
    assert decontam.find_leaks(df.limit(0), bench).count() == 0 and decontam.find_leaks(df, bench.limit(0)).count() == 0


def edge_cut_copies(rng, count):
    """Items of 15 to 60 words and texts that hold one with words replaced at
    an edge, at similarity 0.80 to 0.82 where the size allows (else the next
    one above)."""
    word = lambda n: [f"e{x}" for x in rng.integers(0, 3000, n)]
    items, rows = [], []
    for k in range(count):
        n = int(rng.integers(15, 61))
        x = word(n)
        cut = max([c for c in range(1, n) if (n - 4 - c) / (n - 4 + c) >= 0.8], default=0)
        y = x[:n - cut] + word(cut) if k % 2 else word(cut) + x[cut:]
        items.append((k, " ".join(x)))
        rows.append((k, " ".join(word(int(rng.integers(0, 3)) * 10) + y + word(int(rng.integers(0, 3)) * 10))))
    return rows, items


def test_recall_of_edge_cut_copies(spark):
    """Of 8,000 copies at the threshold the fingerprint index finds all but
    the few whose every similar window lies outside the radius."""
    rows, items = edge_cut_copies(np.random.default_rng(12), 8000)
    got = decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = set()
    for (d, t), (i, x) in zip(rows, items):   # words are drawn from so many that other items are never near
        want |= brute_leaks([(d, t)], [(i, x)])
    found = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in got}
    assert {(d, i) for d, i, _ in found} <= {(d, i) for d, i, _ in want} and len(want) == 8000
    lost = {(d, i) for d, i, _ in want} - {(d, i) for d, i, _ in found}
    print(f"lost {len(lost)} of {len(want)}, farthest {max(r.hamming for r in got)} bits")
    assert len(lost) <= 8
    # a wider radius finds them too
    if lost:
        some = {d for d, _ in lost}
        wide = decontam.find_leaks(spark.createDataFrame([r for r in rows if r[0] in some], "doc_id long, text string"),
                                   spark.createDataFrame([r for r in items if r[0] in some], "item_id long, text string"), radius=31)
        assert {r.doc_id for r in wide.collect()} == some


@pytest.mark.parametrize("radius", [7, 15, 23])
def test_block_index_holds_the_radius(radius):
    rng = np.random.default_rng(4)
    it = decontam.Items([0, 1, 2], ["a b c d e f g", "x y", "1 2 3 4 5 6 7"], radius)
    flips = [sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) for k in rng.integers(0, 33, 4000)]
    prints = it.simhash[0] ^ np.array(flips, np.uint64)
    w, k = it.near(prints, 7)
    want = [(i, j) for j in (0, 2) for i in range(4000) if int(prints[i] ^ it.simhash[j]).bit_count() <= radius]
    assert sorted(zip(k.tolist(), w.tolist())) == sorted((j, i) for i, j in want)


def test_leaks_of_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()][:80]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    ids = {r[0] for r in rows}
    got = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontam.op8_decontamination(spark, SMALL).collect() if r.doc_id in ids}
    shared = {i: {g for g in grams(words(t))} for i, t in items}
    hold = [(d, t) for d, t in rows if any(shared[i] & set(grams(words(t))) for i in shared)]   # others have similarity 0
    assert got == brute_leaks(hold, items)
