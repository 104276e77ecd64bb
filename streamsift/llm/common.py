"""Helpers shared by the corpus operators.

* tables: reading an input table, writing a durable intermediate table, key
  columns that cannot clash with a caller's own columns;
* groups of equal keys: one row per key with a representative, joined back
  without letting a hot key land in one task;
* numpy text helpers used inside Arrow tasks: byte buffers of whole batches,
  word spans, 64-bit span hashes, ragged gathers.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamsift.session import cut_lineage, prepare

#: A key that holds more than one row in this many is resolved by a broadcast
#: table, which therefore has fewer rows than this number for any input.
HOT_SHARE = 1000

#: Texts are handled inside a task in blocks of about this many bytes.
BLOCK_BYTES = 2 << 20


# --------------------------------------------------------------------- tables

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, after the package is shipped to the executors."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    return cut_lineage(df)


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Select ``new=old`` columns by exact name; other columns (also ones
    whose names clash with internal names) never reach an operator. The
    package is shipped to the executors here, as operators begin with it."""
    prepare(df.sparkSession)
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in cols.items()])


def broadcast_small(spark: SparkSession, value):
    """Broadcast a driver value whose size the caller has bounded."""
    return spark.sparkContext.broadcast(value)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ----------------------------------------------------------- equal-key groups

def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Join ``groups`` (one row per ``key``, with its row count in ``size``)
    to ``rows``.

    Keys above ``total / HOT_SHARE`` rows (fewer than HOT_SHARE of them, by
    counting) are joined by broadcast, so their rows never move; all other
    keys are joined by a shuffle in which no key has more than that share.
    """
    limit = max(1, total // HOT_SHARE)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit)
    return (rows.join(hot, key)
            .unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key)))


# ------------------------------------------------------------- text in tasks

def fill(arr) -> pa.Array:
    """A string column of a batch as one array, null as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return pc.fill_null(arr, "")


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a string array."""
    arr = arr.cast(pa.large_string())
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES):
    """Ranges (i, j) of texts with about ``limit`` bytes each; one long text
    is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


#: Rows of a batch are taken in slices of about this many bytes of text.
SLICE_BYTES = 8 << 20


def sliced(batches, col: int):
    """Slices of record batches with about SLICE_BYTES in a text column each,
    so that copies made in a task stay small whatever the batch size."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
        off = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        for i, j in blocks(off, SLICE_BYTES):
            yield batch.slice(i, j - i)


def word_table(extra: bytes = b"") -> np.ndarray:
    """Byte classes: True for a-z, 0-9, bytes from 0x80 on and ``extra``."""
    t = np.zeros(256, bool)
    t[ord("a"):ord("z") + 1] = True
    t[ord("A"):ord("Z") + 1] = True
    t[ord("0"):ord("9") + 1] = True
    t[0x80:] = True
    for b in extra:
        t[b] = True
    return t


WORD_BYTES = word_table()

#: Everything but the six ASCII white space characters.
TOKEN_BYTES = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])


def spans(buf: np.ndarray, off: np.ndarray, classes: np.ndarray = WORD_BYTES):
    """Starts, ends and text index of the maximal runs of word bytes. A run
    never crosses from one text into the next."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = classes[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]])
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
        out = []
        for b in (_BASE, inv):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POW[:] = out
    return _POW[0], _POW[1]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ np.uint64((seed * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Longest stretch of a buffer whose running sums are held at once.
HASH_BYTES = 4 << 20


class SpanHash:
    """64-bit hashes of byte spans of one buffer, given by ascending starts.

    A running sum over the bytes gives the hash of any span by subtraction.
    Long buffers are summed stretch by stretch, so that memory follows the
    longest span and not the text."""

    def __init__(self, buf: np.ndarray):
        self.buf, self.cum = buf, None
        if len(buf) <= HASH_BYTES:
            self.cum = self._sums(buf)

    @staticmethod
    def _sums(buf: np.ndarray) -> np.ndarray:
        p, _ = _powers(len(buf) + 1)
        cum = np.zeros(len(buf) + 1, np.uint64)
        part = buf.astype(np.uint64)
        part += np.uint64(1)
        part *= p[:len(buf)]
        np.cumsum(part, out=cum[1:])
        return cum

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.cum is not None:
            return mix((self.cum[ends] - self.cum[starts]) * _powers(len(self.cum))[1][starts])
        out = np.empty(len(starts), np.uint64)
        for a in range(0, len(self.buf), HASH_BYTES):
            lo, hi = np.searchsorted(starts, [a, a + HASH_BYTES])
            if lo < hi:
                s, e = starts[lo:hi] - a, ends[lo:hi] - a
                cum = self._sums(self.buf[a:a + int(e.max())])
                out[lo:hi] = mix((cum[e] - cum[s]) * _powers(len(cum))[1][s])
        return out


def ragged(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of values[s:s+n] for all (s, n)."""
    lens = np.asarray(lens, np.int64)
    total = int(lens.sum())
    if total == 0:
        return values[:0]
    ends = np.cumsum(lens)
    at = np.ones(total, np.int64)
    live = lens > 0
    first, s, n = (ends - lens)[live], np.asarray(starts, np.int64)[live], lens[live]
    at[0] = s[0]
    at[first[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return values[np.cumsum(at)]


def list_array(values: np.ndarray, lens: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and lengths."""
    off = np.zeros(len(lens) + 1, np.int32)
    np.cumsum(lens, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def binary_array(data: np.ndarray, lens: np.ndarray) -> pa.Array:
    """An Arrow binary column from one flat byte array and byte lengths."""
    off = np.zeros(len(lens) + 1, np.int32)
    np.cumsum(lens, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def file_system(uri: str):
    """The pyarrow file system and path of a shared-folder URI."""
    import pyarrow.fs as pafs
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


# ------------------------------------------------------------------- shingles

#: Words of a shingle.
SHINGLE = 5


def shingles(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE):
    """Hashes of all word shingles of lower-cased texts, in text order:
    (hash, text). A text with fewer than ``size`` words has one shingle of all
    its words; a text without words has none."""
    s, e, doc = spans(buf, off)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return word_shingles(SpanHash(buf)(s, e), doc, len(off) - 1, size)


def word_shingles(word: np.ndarray, doc: np.ndarray, texts: int, size: int = SHINGLE):
    """Shingle hashes from word hashes; see ``shingles``."""
    n = np.bincount(doc, minlength=texts)
    first = np.cumsum(n) - n
    acc = np.zeros(len(word), np.uint64)
    for k in range(size):  # windows may run over a text's end here; those are dropped below
        shifted = np.zeros(len(word), np.uint64)
        shifted[:len(word) - k] = word[k:]
        acc = acc * _BASE + shifted
    pos = np.arange(len(word)) - first[doc]
    whole = pos + size <= n[doc]
    out, owner = mix(acc[whole], size), doc[whole]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for k, d in enumerate(short):
            h = np.uint64(0)
            for w in word[first[d]:first[d] + n[d]]:
                h = np.uint64((int(h) * int(_BASE) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            extra[k] = mix(np.array([h]), int(n[d]))[0]
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def distinct_counts(h: np.ndarray, owner: np.ndarray, texts: int):
    """Sorted distinct hashes per text: (hash, count, distinct per text)."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.bincount(owner[at], minlength=texts)


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of minima over sum of maxima; a, b sorted distinct hashes."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    hit = b[at] == a
    low = np.minimum(wa[hit], wb[at[hit]]).sum()
    return float(low / (wa.sum() + wb.sum() - low))


class SpanCache:
    """Id sequences by 64-bit key, held by a worker between blocks.

    Keys live in two sorted layers; new ones enter the small layer, which is
    merged into the large one when it has grown to a quarter of it. A full
    cache starts anew."""

    def __init__(self, dtype, limit: int):
        self.dtype, self.limit = dtype, limit
        self.clear()

    def clear(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.large, self.small = none, none
        self.values, self.used = np.zeros(1 << 16, self.dtype), 0

    def __len__(self) -> int:
        return len(self.large[0]) + len(self.small[0])

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of every key's values, and whether it is held."""
        at, n, held = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        for keys, starts, sizes in (self.large, self.small):
            if len(keys):
                p = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[p] == key
                at[hit], n[hit] = starts[p[hit]], sizes[p[hit]]
                held |= hit
        return at, n, held

    def add(self, key: np.ndarray, values: np.ndarray, n: np.ndarray) -> None:
        """Keys that are not held yet."""
        end = self.used + len(values)
        if end > len(self.values):
            grown = np.zeros(max(end, 2 * len(self.values)), self.dtype)
            grown[:self.used] = self.values[:self.used]
            self.values = grown
        self.values[self.used:end] = values
        new = (key, self.used + np.cumsum(n) - n, n)
        self.used = end
        layers = [self.small, new]
        if len(self.small[0]) + len(key) > 20_000 + len(self.large[0]) // 4:
            layers.append(self.large)
        merged = [np.concatenate(x) for x in zip(*layers)]
        order = np.argsort(merged[0])
        merged = tuple(x[order] for x in merged)
        if len(layers) == 3:
            self.large, self.small = merged, tuple(x[:0] for x in merged)
        else:
            self.small = merged
