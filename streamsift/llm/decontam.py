"""Benchmark decontamination by SimHash of item-sized windows.

For an item of n words, every n-word window of a document is a possible copy.

1. Windows start where they can hold an item's word shingle (looked up for all
   positions of all texts); a window without one has similarity 0.
2. Each window's 64-bit SimHash of its words probes a multi-index of the items
   of n words: eight blocks of eight bits, each probed with all changes of up
   to RADIUS // 8 bits. Two fingerprints within RADIUS bits agree that far in
   some block, so the index finds every item within the radius.
3. Candidates are verified by the exact weighted similarity of their five-word
   shingles (shared occurrences over all occurrences).

The radius is what a copy at the threshold may be away: one with replaced
words at an edge can be over 20 bits off at similarity 0.8 (README: measured
recall). A wider ``radius`` loses less and probes more; 64 loses nothing.

Items are broadcast in passes of bounded bytes; every pass reads all texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamsift.llm.common import (SHINGLE, SpanHash, blocks, broadcast_small, buffers, fill, mix, pick, ragged,
                                   sliced, spans, table, word_shingles)

THRESHOLD = 0.8
#: Bits by which a window's fingerprint may differ from the item's.
RADIUS = 23
#: Blocks of a fingerprint, eight bits each.
PARTS = 8
#: Bytes of item texts in one pass.
PASS_BYTES = 8 << 20
#: Windows that probe the index at once.
PROBES = 8192


def flips(radius: int) -> np.ndarray:
    """All changes of a block by at most radius // PARTS bits."""
    most = min(8, radius // PARTS)
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(8), k)], np.uint8)


def bit_rows(word: np.ndarray) -> np.ndarray:
    """+1 / -1 for the 64 bits of every word's hash."""
    bits = np.unpackbits(mix(word, 41).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


#: Words whose fingerprint bits are in memory at once.
PRINT_WORDS = 1 << 14


def fingerprints(word: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the windows of up to ``n`` words at ascending ``starts``."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = int(np.searchsorted(starts, low + PRINT_WORDS))
        part = word[low:int(starts[j - 1]) + n]
        cum = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(bit_rows(part), axis=0, out=cum[1:])
        at = starts[i:j] - low
        out[i:j] = pack(cum[np.minimum(at + n, len(part))] - cum[at])
        i = j
    return out


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Items:
    """Benchmark items of one pass with their shingles and, for every item
    size, a block index of their fingerprints."""

    def __init__(self, ids: list, texts: list[str], radius: int = RADIUS):
        low = pc.utf8_lower(pa.array([t or "" for t in texts], pa.string()))
        buf, off = buffers(low)
        s, e, owner = spans(buf, off)
        word = SpanHash(buf)(s, e) if len(s) else np.zeros(0, np.uint64)
        n = np.bincount(owner, minlength=len(ids))
        use = np.flatnonzero(n > 0)                    # an item without words never matches
        first = np.cumsum(n) - n
        self.ids = [ids[k] for k in use]
        self.size = n[use]
        self.simhash = np.array([pack(bit_rows(word[first[k]:first[k] + n[k]]).sum(axis=0, keepdims=True))[0] for k in use], np.uint64)
        sh, who = word_shingles(word, owner, len(ids))  # in the order of the items
        ends = np.searchsorted(who, use, side="right")
        self.counts = [Counter(sh[i:j].tolist()) for i, j in zip(np.searchsorted(who, use), ends)]
        self.kinds = sorted({int(min(SHINGLE, x)) for x in self.size})   # shingle lengths in use
        flat = [(h, k) for k, c in enumerate(self.counts) for h in c]
        self.keys = np.array([h for h, _ in flat], np.uint64)
        self.of = np.array([k for _, k in flat], np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.of = self.keys[order], self.of[order]
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self.keys & np.uint64((1 << 22) - 1)] = True
        # multi-index: per item size and block, the items ordered by block value
        self.radius, self.flips, self.index = radius, flips(radius), {}
        for size in np.unique(self.size):
            mine = np.flatnonzero(self.size == size)
            value = np.ascontiguousarray(self.simhash[mine]).view(np.uint8).reshape(-1, PARTS)
            place = np.argsort(value, axis=0, kind="stable")
            bounds = [np.searchsorted(value[place[:, b], b], np.arange(257)) for b in range(PARTS)]
            self.index[int(size)] = mine, place, bounds

    def near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of one item size within the radius."""
        mine, place, bounds = self.index[size]
        uniq, back = np.unique(prints, return_inverse=True)
        found = [np.zeros(0, np.int64)]
        for i in range(0, len(uniq), PROBES):
            values = uniq[i:i + PROBES].view(np.uint8).reshape(-1, PARTS)
            for b in range(PARTS):
                probe = (values[:, b, None] ^ self.flips[None]).astype(np.int64)
                lo, hi = bounds[b][probe], bounds[b][probe + 1]
                w, f = np.nonzero(hi > lo)
                m = (hi - lo)[w, f]
                at = ragged(place[:, b], lo[w, f], m)
                who = np.repeat(w + i, m)
                close = popcount(uniq[who] ^ self.simhash[mine[at]]) <= self.radius
                found.append(who[close] * len(mine) + at[close])
        pair = np.unique(np.concatenate(found))
        who, item = pair // len(mine), mine[pair % len(mine)]
        by = np.argsort(back, kind="stable")            # back to the windows with that fingerprint
        n = np.bincount(back, minlength=len(uniq))
        return ragged(by, (np.cumsum(n) - n)[who], n[who]), np.repeat(item, n[who])

    def hits(self, word: np.ndarray, doc: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """(word position, item) for every item shingle in a block of texts."""
        n = np.bincount(doc, minlength=texts)
        last = np.cumsum(n)[doc]
        out_p, out_k = [], []
        for size in self.kinds:
            acc = np.zeros(len(word), np.uint64)
            for k in range(size):
                shifted = np.zeros(len(word), np.uint64)
                shifted[:len(word) - k] = word[k:]
                acc = acc * SHIFT + shifted
            acc = mix(acc, size)
            at = np.flatnonzero(self.sieve[acc & np.uint64((1 << 22) - 1)] & (np.arange(len(word)) + size <= last))
            lo, hi = np.searchsorted(self.keys, acc[at], side="left"), np.searchsorted(self.keys, acc[at], side="right")
            m = hi - lo
            out_p.append(np.repeat(at, m))
            out_k.append(self.of[np.repeat(lo, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)])
        return np.concatenate(out_p), np.concatenate(out_k)


SHIFT = np.uint64(0x9E3779B97F4A7C15 | 1)


def best_window(sh: np.ndarray, starts: np.ndarray, size: int, words: int, want: Counter) -> np.ndarray:
    """Exact similarity of the windows at ascending ``starts``; ``sh`` are the
    shingle hashes at the positions of the text. The shared count slides along."""
    length = min(SHINGLE, size)
    total = sum(want.values())
    have: Counter = Counter()
    shared, lo, hi, out = 0, 0, 0, np.zeros(len(starts))
    for i, p in enumerate(starts.tolist()):
        end = min(p + size, words) - length + 1      # one past the last shingle start
        if hi < p:
            lo = hi = p
            have.clear()
            shared = 0
        while hi < end:
            h = int(sh[hi])
            if h in want:
                shared += have[h] < want[h]
                have[h] += 1
            hi += 1
        while lo < p:
            h = int(sh[lo])
            if h in want:
                have[h] -= 1
                shared -= have[h] < want[h]
            lo += 1
        if end > p:
            out[i] = shared / (end - p + total - shared)
    return out


def leaks_in_block(items: Items, buf: np.ndarray, off: np.ndarray, threshold: float) -> list[tuple]:
    """(text, item, start word, words, distance, similarity) of the best
    window of each leaked item in each text of a block."""
    s, e, doc = spans(buf, off)
    if not len(s) or not len(items.ids):
        return []
    word = SpanHash(buf)(s, e)
    texts = len(off) - 1
    pos, item = items.hits(word, doc, texts)
    if not len(pos):
        return []
    n = np.bincount(doc, minlength=texts)
    first = np.cumsum(n) - n
    # windows around the hits, by text and item size
    group = doc[pos] * (int(items.size.max()) + 1) + items.size[item]
    order = np.lexsort((pos, group))
    pos, group = pos[order], group[order]
    groups, at, held = np.unique(group, return_index=True, return_counts=True)
    best: list[tuple] = []
    last = None
    for g, i, m in zip(groups.tolist(), at.tolist(), held.tolist()):
        d, size = divmod(g, int(items.size.max()) + 1)
        length = min(SHINGLE, size)
        own = word[first[d]:first[d] + n[d]]
        mine = np.unique(pos[i:i + m]) - first[d]
        mark = np.zeros(n[d] + 1, np.int64)
        np.add.at(mark, np.maximum(mine + length - size, 0), 1)
        np.add.at(mark, mine + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark) > 0)
        prints = fingerprints(own, starts, size)
        w, k = items.near(prints, size)
        if not len(w):
            continue
        if last != (d, length):
            last, sh = (d, length), np.zeros(n[d], np.uint64)
            for j in range(length):
                shifted = np.zeros(n[d], np.uint64)
                shifted[:n[d] - j] = own[j:]
                sh = sh * SHIFT + shifted
            sh = mix(sh, length)
        for kk in np.unique(k):
            near = np.sort(w[k == kk])
            sim = best_window(sh, starts[near], size, int(n[d]), items.counts[kk])
            top = sim.max()
            if top >= threshold:
                ok = near[sim == top]
                far = popcount(prints[ok] ^ items.simhash[kk])
                p = int(starts[ok[np.argmin(far)]])
                best.append((d, int(kk), p, min(size, int(n[d]) - p), int(far.min()), float(top)))
    return [(d, items.ids[kk], *rest) for d, kk, *rest in sorted(best)]


def passes(items: DataFrame, key: str, text: str) -> Iterator[tuple[list, list]]:
    """Items in passes of about PASS_BYTES."""
    rows = pick(items, id=key, text=text)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // PASS_BYTES))
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("id", "text").collect()
        yield [r["id"] for r in got], [r["text"] for r in got]


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(key, item_id, start, n_words, hamming, similarity): one row per text
    and leaked item, with the item's best window (then the nearest, then the
    first one).

    Words are lower-cased runs of letters and digits. Items of fewer than five
    words match as one shingle of all their words; items and texts without
    words never match. Windows more than ``radius`` bits from an item are not
    compared with it. Null texts count as empty. Repeated texts and repeated
    items each give their own rows. Extra columns are ignored; an empty table
    on either side gives no rows.
    """
    rows = pick(docs, id=key, text=text)
    kind, item_kind = dict(rows.dtypes)["id"], dict(items.dtypes)[item_key]
    schema = f"id {kind}, item_id {item_kind}, start int, n_words int, hamming int, similarity double"
    out = None
    for ids, texts in passes(items, item_key, item_text):
        shared = broadcast_small(docs.sparkSession, Items(ids, texts, radius))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 1):
                buf, off = buffers(pc.utf8_lower(fill(batch.column(1))))
                for i, j in blocks(off):
                    got = leaks_in_block(shared.value, buf[off[i]:off[j]], off[i:j + 1] - off[i], threshold)
                    if got:
                        cols = list(zip(*got))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i + d for d in cols[0]])), pa.array(cols[1]), *[pa.array(c, pa.int32()) for c in cols[2:5]], pa.array(cols[5])],
                                                         ["id", "item_id", "start", "n_words", "hamming", "similarity"])

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("id", key).withColumnRenamed("item_id", item_key)


def drop_leaked(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
                radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; all columns stay. The
    rows are filtered where they are read, without a join."""
    out = docs
    at = docs.columns.index(text)
    for ids, texts in passes(items, item_key, item_text):
        shared = broadcast_small(docs.sparkSession, Items(ids, texts, radius))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, at):
                keep = np.ones(len(batch), bool)
                buf, off = buffers(pc.utf8_lower(fill(batch.column(at))))
                for i, j in blocks(off):
                    for leak in leaks_in_block(shared.value, buf[off[i]:off[j]], off[i:j + 1] - off[i], threshold):
                        keep[i + leak[0]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
