"""Filter interaction audit: what each filter removes in every order.

Texts go through a byte transducer given by tables. Every byte has a class;
the state after a byte (in a word or between words) and the marks put out for
it (word begins, word ended, capital, code point, symbol) are looked up by
state and class. The state depends on the last byte alone, so a block of texts
is one array look-up per table, with the state carried from slice to slice.

The spans of the words that the pass marks go into an open-addressing hash
table; a span that meets a filled slot is compared byte by byte, and goes on
to the next slot if the bytes differ. So distinct words are counted exactly.

Documents then become five bits (which filters they fail). Counts per part
and bit set hold all that any order of the filters can do: at most 32 rows per
part, from which the 120 orders are replayed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamsift.llm.common import SpanHash, attach_groups, blocks, buffers, durable, fill, pick, ragged, sliced, table

FILTERS = "ABCDE"
MIN_WORDS = 200
SYMBOLS = b"#$%&*|"

# Byte classes of the transducer.
SPACE, PLAIN, CAPITAL, SYMBOL, CONTINUATION = range(5)
CLASS = np.full(256, PLAIN, np.uint8)
CLASS[0x80:0xC0] = CONTINUATION
CLASS[ord("A"):ord("Z") + 1] = CAPITAL
CLASS[list(SYMBOLS)] = SYMBOL
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE

# States and transitions; a text begins between words.
GAP, WORD = range(2)
NEXT = np.array([[GAP, WORD, WORD, WORD, WORD]] * 2, np.uint8)

# Marks, put out per state and class.
BEGIN, END, UPPER, POINT, SIGN = 1, 2, 4, 8, 16
OUT = np.array([
    [POINT, BEGIN | POINT, BEGIN | POINT | UPPER, BEGIN | POINT | SIGN, BEGIN],
    [END | POINT, POINT, POINT | UPPER, POINT | SIGN, 0],
], np.uint8)

#: Bytes that the transducer takes at once, and words that are inserted at once.
STEP = 1 << 20
INSERT = 1 << 18


class SpanTable:
    """Distinct (text, span) pairs of one buffer in an open-addressing table.
    Slots hold positions in the lists of distinct spans; the table doubles
    before it is half full."""

    def __init__(self, buf: np.ndarray):
        self.buf = buf
        none = np.zeros(0, np.int64)
        self.text, self.start, self.length, self.hash = none, none, none, none.astype(np.uint64)
        self.slot = np.full(1 << 10, -1, np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.slot) - 1)).astype(np.int64)

    def insert(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Spans by text, start and end; a span equal to a held one of the same
        text is dropped."""
        first = len(self.start)
        new = (text, start, end - start, hashes)
        for name, more in zip(("text", "start", "length", "hash"), new):
            setattr(self, name, np.concatenate([getattr(self, name), more]))
        if 2 * len(self.start) > len(self.slot):
            self.slot = np.full(1 << (2 * len(self.start)).bit_length(), -1, np.int64)
            self.place(np.arange(first), verify=False)
        kept = np.concatenate([np.arange(first), self.place(np.arange(first, len(self.start)), verify=True)])
        moved = np.zeros(len(self.start), np.int64)
        moved[kept] = np.arange(len(kept))
        used = self.slot >= 0
        self.slot[used] = moved[self.slot[used]]
        for name in ("text", "start", "length", "hash"):
            setattr(self, name, getattr(self, name)[kept])

    def place(self, todo: np.ndarray, verify: bool) -> np.ndarray:
        """Put spans into slots; returns those that took one. With ``verify``
        a span that meets an equal one is done, otherwise all take slots."""
        at, won = self.places(self.hash[todo]), []
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]    # of the spans that reach a free slot together, one takes it
            holder = self.slot[at]
            mine = holder == todo
            won.append(todo[mine])
            left = ~mine
            if verify:
                left[left] = ~self.equal(todo[left], holder[left])
            todo, at = todo[left], (at[left] + 1) & (len(self.slot) - 1)
        return np.sort(np.concatenate(won)) if won else todo

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Are the spans equal, byte by byte, and of one text?"""
        out = (self.length[a] == self.length[b]) & (self.text[a] == self.text[b])
        at = np.flatnonzero(out)
        for lo, hi in blocks(np.concatenate([[0], np.cumsum(self.length[a[at]])]), STEP):
            part = at[lo:hi]
            n = self.length[a[part]]
            other = ragged(self.buf, self.start[a[part]], n) != ragged(self.buf, self.start[b[part]], n)
            out[part] = np.add.reduceat(other, np.cumsum(n) - n) == 0
        return out

    def counts(self, texts: int) -> np.ndarray:
        return np.bincount(self.text, minlength=texts)


def transduce(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, 5) of words, distinct words, capitals, code points, symbols."""
    texts = len(off) - 1
    marks = np.empty(len(buf), np.uint8)
    state = GAP
    for a in range(0, len(buf), STEP):
        cls = CLASS[buf[a:a + STEP]]
        states = np.empty(len(cls), np.uint8)
        states[0] = state
        states[1:] = NEXT[0][cls[:-1]]          # both states lead on alike
        at = off[(off >= a) & (off < a + len(cls))] - a
        states[at] = GAP                        # a text begins between words
        marks[a:a + STEP] = OUT[states, cls]
        state = NEXT[0][cls[-1]]
    out = np.zeros((texts, 5), np.int64)
    filled = np.flatnonzero(np.diff(off))
    for k, mark in ((0, BEGIN), (2, UPPER), (3, POINT), (4, SIGN)):
        if len(filled):
            out[filled, k] = np.add.reduceat(((marks & mark) > 0).view(np.uint8), off[filled], dtype=np.int64)
    start = np.flatnonzero(marks & BEGIN)
    stops = np.flatnonzero(marks & END)
    del marks
    text = np.searchsorted(off, start, side="right") - 1
    # a word ends where the transducer leaves it, or with its text
    end = np.minimum(np.append(stops, len(buf))[np.searchsorted(stops, start)], off[text + 1])
    held = SpanTable(buf)
    hashes = SpanHash(buf)
    for i in range(0, len(start), INSERT):
        part = slice(i, i + INSERT)
        h = hashes(start[part], end[part]) + text[part].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        held.insert(text[part], start[part], end[part], h ^ (h >> np.uint64(29)))
    out[:, 1] = held.counts(texts)
    return out


def text_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, words, distinct_words, capitals, code_points, symbols) of every
    row; a null text counts as empty (all zero)."""
    rows = pick(docs, id=key, text=text)
    return counted(rows, []).withColumnRenamed("id", key)


COUNTS = ["words", "distinct_words", "capitals", "code_points", "symbols"]


def counted(rows: DataFrame, carry: list[str]) -> DataFrame:
    """Counts of rows (id, text, carried columns) beside id and ``carry``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            buf, off = buffers(fill(batch.column(1)))
            for i, j in blocks(off):
                n = transduce(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                kept = [batch.column(c)[i:j] for c in [0, *range(2, 2 + len(carry))]]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(n[:, k]) for k in range(5)]], ["id", *carry, *COUNTS])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["id", *carry]) + ", " + ", ".join(f"{c} long" for c in COUNTS)
    return rows.select("id", "text", *carry).mapInArrow(run, schema)


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, mask): the filters that each row fails, bit k for FILTERS[k].

    A: under 200 words. B: under half of the words distinct. C: over 3 % of the
    code points capitals A-Z. D: holds a symbol. E: its text is that of a row
    with a smaller key. A null text counts as empty, a null part as "". A row
    with a null key never fails E and makes no other fail; rows that repeat
    key and text do not fail E by each other.
    """
    rows = pick(docs, id=key, text=text, part=part)
    body = F.coalesce(F.col("text"), F.lit(""))
    named = rows.select("id", "text", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("sha"))
    bits = [F.col("words") < MIN_WORDS, 100 * F.col("distinct_words") < 50 * F.col("words"), 100 * F.col("capitals") > 3 * F.col("code_points"), F.col("symbols") > 0]
    mask = sum((F.when(b, F.lit(1 << k)).otherwise(F.lit(0)) for k, b in enumerate(bits)), F.lit(0))
    seen = durable(counted(named, ["part", "sha"]).select("id", "part", "sha", mask.alias("mask")))
    first = seen.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    out = attach_groups(seen, first, "sha", "n", seen.count())
    return out.select("id", "part", (F.col("mask") + F.when(F.col("id") > F.col("first"), F.lit(16)).otherwise(F.lit(0))).alias("mask"))


def replay(table_: np.ndarray) -> list[np.ndarray]:
    """All orders over the counts of one part. ``table_``: (32, 3) of rows,
    good rows and toxic rows per bit set. Returns columns in the order of
    ORDERS x steps: step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley."""
    sets = np.arange(32)
    bit = 1 << ORDER_BITS                                               # (120, 5): the filter of each step
    before = np.cumsum(bit, axis=1) - bit
    fails = (sets & bit[..., None]) > 0                                 # (120, 5, 32)
    gone = (sets & before[..., None]) > 0
    n, good, toxic = table_.T
    removed = (fails & ~gone) @ n
    share = np.zeros(len(FILTERS), np.int64)
    np.add.at(share, ORDER_BITS.ravel(), removed.ravel())
    out = [np.broadcast_to(np.arange(1, 6), bit.shape), ~(fails | gone) @ n, removed, (fails & gone) @ n, n[bit],
           (fails & ~gone) @ good, (fails & ~gone) @ toxic, share[ORDER_BITS]]
    return [np.ascontiguousarray(c).ravel() for c in out]


ORDER_BITS = np.array(list(permutations(range(len(FILTERS)))))
ORDERS = ["".join(FILTERS[k] for k in p) for p in ORDER_BITS]
REPORT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley): a row per part, order of the five filters
    and step.

    Filters and null rules as in ``failures``. A document is good (toxic) if
    any row of ``labels`` (key, quality, toxic) with its key has quality
    (toxic) 1; a null key has no labels. Repeated rows count as often as they
    occur. Extra columns are ignored; a table without rows gives no parts.
    """
    known = (pick(labels, id="doc_id", quality="quality", toxic="toxic").groupBy("id")
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad")))
    # equal outcomes of one key are one row before they meet its labels
    outcome = failures(docs, key, text, part).groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    sets = (outcome.join(known, "id", "left").groupBy("part", "mask")
            .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("bad", F.lit(0))).alias("toxic")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((32, 3), np.int64)
        counts[rows["mask"].to_numpy()] = rows[["n", "good", "toxic"]].to_numpy()
        cols = replay(counts)
        return pd.DataFrame({"part": rows["part"].iloc[0], "filter_order": np.repeat(ORDERS, len(FILTERS)), "step": cols[0].astype(np.int32),
                             **dict(zip(REPORT, cols[1:]))})

    return sets.groupBy("part").applyInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in REPORT))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY sha256(body)) THEN 16 ELSE 0 END AS mask
  FROM d),
k AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM f LEFT JOIN k USING (doc_id) GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT l1.c || l2.c || l3.c || l4.c || l5.c AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS bits
      FROM l l1, l l2, l l3, l l4, l l5 WHERE (l1.b | l2.b | l3.b | l4.b | l5.b) = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
