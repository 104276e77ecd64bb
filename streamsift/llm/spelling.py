"""Spelling variants: near words by a trie of letter-group counts.

Letters fall into GROUPS groups by code point. A word's path in the trie is
the number of its letters in each group in turn. One inserted letter raises
one count, one deleted letter lowers one, one replaced letter does both or (in
its group) neither; so the near words of a word lie on paths that differ by a
surplus of at most one and a deficit of at most one. A depth-first search
follows these paths with a budget of one each, and the words at the leaves are
verified letter by letter. Of the two words of a pair, one finds the other: a
path whose first difference is a surplus is searched, its mirror image is not.

Spread over tasks: the trie is cut at a depth at which its largest subtree is
small (found by counting words per path prefix). A word is sent to its own
subtree and, as a query, to every subtree within the budget. Subtrees that are
still large (many words of one path), and large sets of queries, are dealt
into blocks; each pair of blocks is one group of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamsift.llm.common import durable, pick, ragged, table

#: Runs of letters; all have one byte in Latin-1.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Every so many (document, run) hashes lose a letter.
LOSS = 199
MIN_LETTERS = 6
MIN_COUNT = 5
#: A form is at least this many times as frequent as its variant.
RATIO = 5

#: Letter groups (levels of the trie): code point modulo GROUPS.
GROUPS = 10
#: Words of a subtree, or of a block of one, and queries of a block.
BLOCK_WORDS = 20_000
#: Candidate letters that are verified at once.
VERIFY = 1 << 20


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", loss: int = LOSS,
                min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of all texts with their number of occurrences.

    Runs of letters, A-Z in lower case. Where ``loss`` divides the CRC-32 of
    ``<key>:<run>``, the run loses the letter at that hash modulo its length.
    A null key is written as an empty text; a null text has no words. Repeated
    rows count as often as they occur; extra columns are ignored.
    """
    rows = pick(docs, key=key, text=text)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = (rows.select(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":")).alias("name"),
                        F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
            .select("name", F.translate("run", upper, lower).alias("run")))
    h = F.crc32(F.concat("name", "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    lost = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % loss == 0, lost).otherwise(F.col("run")).alias("word"))
    return (words.where(F.length("word") >= min_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


# ---------------------------------------------------------------- paths, routes

def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letters (one byte each) and the n+1 offsets."""
    raw = [w.encode("latin-1") for w in words]
    off = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=off[1:])
    return np.frombuffer(b"".join(raw), np.uint8), off


def paths(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(words, GROUPS) letter-group counts."""
    n = len(off) - 1
    owner = np.repeat(np.arange(n), np.diff(off))
    return np.bincount(owner * GROUPS + buf % GROUPS, minlength=n * GROUPS).reshape(n, GROUPS).astype(np.int32)


def routes(depth: int) -> np.ndarray:
    """Differences of path prefixes that a query follows: none, a surplus, or
    a surplus and a later deficit."""
    out = [np.zeros(depth, np.int32)]
    for up in range(depth):
        for down in [None, *range(up + 1, depth)]:
            d = np.zeros(depth, np.int32)
            d[up] = 1
            if down is not None:
                d[down] = -1
            out.append(d)
    return np.array(out)


def prefixes(words: DataFrame, depth: int, moves: np.ndarray) -> DataFrame:
    """(cell, word, n): every word under the path prefixes reached by
    ``moves``; a cell is the prefix's counts as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                path = paths(*letters(batch.column(0).to_pylist()))[:, :depth]
                to = (path[:, None, :] + moves[None]).reshape(-1, depth)
                src = np.repeat(np.arange(batch.num_rows), len(moves))
                real = (to >= 0).all(axis=1)
                cell = np.ascontiguousarray(to[real].astype(">i4")).view(np.uint8).reshape(-1, 4 * depth)
                cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * depth), len(cell), [None, pa.py_buffer(cell.tobytes())])
                at = pa.array(src[real])
                yield pa.RecordBatch.from_arrays([cells.cast(pa.binary()), batch.column(0).take(at), batch.column(1).take(at)], ["cell", "word", "n"])

    return words.mapInArrow(run, "cell binary, word string, n long")


def cut_depth(words: DataFrame, limit: int = BLOCK_WORDS) -> int:
    """The smallest depth whose largest subtree has at most ``limit`` words;
    all levels if none has."""
    whole = prefixes(words, GROUPS, np.zeros((1, GROUPS), np.int32))
    depth = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.substring("cell", 1, 4 * d).alias("cell")) for d in range(1, GROUPS + 1)]))
    sizes = whole.select(depth.alias("p")).groupBy("p.depth", "p.cell").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.groupBy("depth").agg(F.max("n").alias("n")).where(F.col("n") <= limit).agg(F.min("depth")).first()[0]
    return GROUPS if small is None else int(small)


# ---------------------------------------------------------------------- search

class Trie:
    """The words of a block, sorted by path; a node is known by its number
    among the nodes of its level."""

    def __init__(self, words: list[str]):
        buf, off = letters(words)
        path = paths(buf, off)
        order = np.lexsort(path.T[::-1])
        self.top = int(path.max(initial=0)) + 2
        self.words, self.path = order, path[order]
        self.buf, self.start, self.size = buf, off[:-1][order], np.diff(off)[order]
        self.keys, node = [], np.zeros(len(order), np.int64)
        for level in range(GROUPS):
            key, node = np.unique(node * self.top + self.path[:, level], return_inverse=True)
            self.keys.append(key)
        self.low = np.searchsorted(node, np.arange(len(self.keys[-1]) + 1))

    def child(self, level: int, node: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Number of the child with this count, -1 if there is none."""
        keys = self.keys[level]
        want = node * self.top + count
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where((keys[at] == want) & (count >= 0) & (count < self.top), at, -1)

    def search(self, path: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(queries, leaves, spent) reached within the budget, depth first;
        queries that take the same turns go together. ``spent``: 0 nothing, 1
        the surplus, 2 both."""
        stack = [(0, np.arange(len(path)), np.zeros(len(path), np.int64), 0)]
        while stack:
            level, q, node, spent = stack.pop()
            if level == GROUPS:
                yield q, node, spent
                continue
            for move in ((0, 1), (0, -1), (0,))[spent]:   # a surplus first, then a deficit
                to = self.child(level, node, path[q, level] + move)
                hit = to >= 0
                if hit.any():
                    stack.append((level + 1, q[hit], to[hit], spent + (move != 0)))


def one_edit(a: tuple, b: tuple) -> np.ndarray:
    """Do the words of each pair differ by exactly one inserted, deleted or
    replaced letter? ``a``, ``b``: (letters, starts, lengths), the words of
    ``b`` as long or one letter longer."""
    (x, xs, xn), (y, ys, yn) = a, b
    first = np.cumsum(xn) - xn
    at = np.arange(int(xn.sum())) - np.repeat(first, xn)
    left = ragged(x, xs, xn)
    here = left != ragged(y, ys, xn)
    later = left != ragged(y, ys + (yn - xn), xn)
    # longest equal beginning, and the last place where the ends differ
    begin = np.minimum.reduceat(np.where(here, at, 1 << 40), first)
    last = np.maximum.reduceat(np.where(later, at, -1), first)
    return np.where(xn == yn, np.add.reduceat(here, first, dtype=np.int64) == 1, last < begin)


def search_block(entries: list[str], queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(query, entry) numbers of the near pairs that the queries find. Words of
    one path would meet from both sides: there the later word is the entry."""
    trie = Trie(entries)
    buf, off = letters(queries)
    start, size = off[:-1], np.diff(off)
    names, asked = np.array(entries, object), np.array(queries, object)
    found = [np.zeros((2, 0), np.int64)]
    for q, leaf, spent in trie.search(paths(buf, off)):
        many = trie.low[leaf + 1] - trie.low[leaf]
        cost = np.concatenate([[0], np.cumsum(many * size[q])])
        i = 0
        while i < len(q):
            j = max(i + 1, int(np.searchsorted(cost, cost[i] + VERIFY, side="right")) - 1)
            pq = np.repeat(q[i:j], many[i:j])
            pe = ragged(np.arange(len(names)), trie.low[leaf[i:j]], many[i:j])
            ok = one_edit((buf, start[pq], size[pq]), (trie.buf, trie.start[pe], trie.size[pe]))
            pq, pe = pq[ok], trie.words[pe[ok]]
            if spent == 0:
                later = (names[pe] > asked[pq]).astype(bool)
                pq, pe = pq[later], pe[later]
            found.append(np.stack([pq, pe]))
            i = j
    return tuple(np.concatenate(found, axis=1))


def near_words(words: DataFrame, limit: int = BLOCK_WORDS) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words one edit apart, from
    distinct (word, n). Words are runs of letters up to U+00FF."""
    words = words.select("word", F.col("n").cast("long").alias("n"))
    depth = cut_depth(words, limit)
    entries = prefixes(words, depth, np.zeros((1, depth), np.int32))
    cells = durable(entries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("blocks")))
    asked = durable(prefixes(words, depth, routes(depth)).join(cells, "cell"))
    cells = durable(asked.groupBy("cell", "blocks").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("asks")))

    def deal(rows: DataFrame, mine: str, own: str, other: str, copies: str, role: int) -> DataFrame:
        """Each row in one block of its side, beside every block of the other."""
        return (rows.withColumn(mine, F.pmod(F.xxhash64("word", F.lit(role)), F.col(own)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
                .select("cell", "block", "ask", F.lit(role).alias("role"), "word", "n"))

    dealt = (deal(entries.join(cells, "cell"), "block", "blocks", "ask", "asks", 0)
             .unionByName(deal(asked.join(cells.drop("blocks"), "cell"), "ask", "asks", "block", "blocks", 1)))

    def run(rows: pa.Table) -> pa.Table:
        role = rows["role"].to_numpy()
        e, q = [rows.select(["word", "n"]).take(pa.array(np.flatnonzero(role == k))).combine_chunks() for k in (0, 1)]
        if not len(e) or not len(q):
            return pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.string()), "near_n": pa.array([], pa.int64())})
        a, b = search_block(e["word"].to_pylist(), q["word"].to_pylist())
        left, right = q.take(pa.array(a)), e.take(pa.array(b))
        return pa.concat_tables([pa.table({"word": x["word"], "near": y["word"], "near_n": y["n"]}) for x, y in ((left, right), (right, left))])

    return dealt.groupBy("cell", "block", "ask").applyInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word of every chain of (word, form). A form is
    more frequent than its word, so chains end; each round doubles the steps."""
    now, moving = durable(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))), True
    while moving:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = durable(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moving = now.where("moved").limit(1).count() > 0
    return now.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, limit: int = BLOCK_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    ``n_near``: number of words one inserted, deleted or replaced letter away.
    ``form``: the most frequent of them (ties: first by code point) if it is
    at least ``ratio`` times as frequent as the word, else null. ``root``:
    where the chain of forms ends, the word itself if it has none. ``ratio``
    must be above 1. No words give no rows.
    """
    if ratio <= 1:
        raise ValueError("forms must be more frequent than their variants")
    words = durable(words.select("word", "n"))
    best = (near_words(words, limit).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("best")))
    form = -F.col("best.m") >= F.col("n") * ratio
    known = durable(words.join(best, "word", "left")
                    .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.near")).alias("form"),
                            F.when(form, -F.col("best.m")).alias("form_n")))
    return (known.join(roots(known.where("form is not null")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Variants among the words of all texts; see ``word_counts`` and
    ``variants``."""
    return variants(word_counts(docs, key, text))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their forms and roots."""
    return spelling_variants(table(spark, sf_dir, "documents"))
