"""Exact deduplication with static binary-fuse filters.

Rows arrive as immutable snapshots, oldest first, and one incoming batch.

1. Every text becomes a SHA-256 digest of its normalised form (A-Z lowered).
2. Each snapshot keeps its distinct digests in hash buckets. A task builds one
   three-wise binary-fuse filter per bucket; the filter table is written once
   and never changed.
3. The distinct digests of the incoming batch are screened by the filters of
   their bucket. Only positives are joined to the exact snapshot bucket, and
   the join compares the normalised bytes of one text per side.
4. Copies inside the incoming batch are grouped on their own, by a partial
   aggregation over (digest, length); groups of both kinds are then added up.

A repeated key never sits in one task: groups are partial aggregates, and the
join back to the rows resolves hot groups by a broadcast of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamsift.llm.common import ascii_lower, attach_groups, durable, mix, pick, table

#: Distinct digests in one filter (about); fixes the memory of a task.
BUCKET_KEYS = 100_000

#: Attempts with new seeds before a filter build is given up.
BUILD_TRIES = 100


class BinaryFuse8:
    """Three-wise binary-fuse filter over distinct 64-bit keys, 8 bits each.

    Slots are split into overlapping windows of three neighbouring segments;
    a key owns one slot in each of the three and its fingerprint is their
    XOR. Built by peeling: all keys alone in a slot leave together, round by
    round, and the fingerprints are set in reverse order.
    """

    def __init__(self, seed: int, seg: int, slots: np.ndarray):
        self.seed, self.seg, self.slots = seed, seg, slots

    @staticmethod
    def shape(n: int) -> tuple[int, int]:
        """Segment length (a power of two) and number of window starts."""
        if n < 2:
            return 4, 1
        seg = 1 << min(18, max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
        factor = max(1.125, 0.875 + 0.25 * np.log(1_000_000) / np.log(n))
        return seg, max(1, -(-int(round(n * factor)) // seg) - 2)

    @staticmethod
    def places(keys: np.ndarray, seed: int, seg: int, windows: int):
        h = mix(keys, seed + 1)
        low = h & np.uint64(0xFFFFFFFF)
        start = ((h >> np.uint64(32)) * np.uint64(windows)) >> np.uint64(32)
        mask = np.uint64(seg - 1)
        h2 = mix(h, 77)
        p0 = start * np.uint64(seg) + (low & mask)
        p1 = (start + np.uint64(1)) * np.uint64(seg) + (h2 & mask)
        p2 = (start + np.uint64(2)) * np.uint64(seg) + ((h2 >> np.uint64(32)) & mask)
        print8 = ((h ^ (h2 >> np.uint64(20))) >> np.uint64(13)).astype(np.uint8)
        return np.stack([p0, p1, p2]).astype(np.int64), print8

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse8:
        keys = np.unique(np.asarray(keys, np.uint64))
        seg, windows = cls.shape(len(keys))
        size = (windows + 2) * seg
        for seed in range(BUILD_TRIES):
            at, fp = cls.places(keys, seed, seg, windows)
            flat = at.ravel()
            count = np.bincount(flat, minlength=size)
            owner = np.zeros(size, np.int64)  # XOR of the keys in a slot
            np.bitwise_xor.at(owner, flat, np.tile(np.arange(len(keys)), 3))
            rounds = []
            alone = np.flatnonzero(count == 1)
            left = len(keys)
            while len(alone):
                key, first = np.unique(owner[alone], return_index=True)
                rounds.append((key, alone[first]))
                left -= len(key)
                gone = at[:, key].ravel()
                np.subtract.at(count, gone, 1)
                np.bitwise_xor.at(owner, gone, np.tile(key, 3))
                near = np.unique(gone)
                alone = near[count[near] == 1]
            if left == 0:
                break
            if seed % 10 == 9:
                windows += max(1, windows // 8)  # a little more room for unlucky sets
                size = (windows + 2) * seg
        else:
            raise RuntimeError("the filter could not be built")
        slots = np.zeros(size, np.uint8)
        for key, slot in reversed(rounds):
            p = at[:, key]
            slots[slot] = fp[key] ^ slots[p[0]] ^ slots[p[1]] ^ slots[p[2]]
        out = cls(seed, seg, slots)
        return out

    def contains(self, keys: np.ndarray) -> np.ndarray:
        windows = len(self.slots) // self.seg - 2
        at, fp = self.places(np.asarray(keys, np.uint64), self.seed, self.seg, windows)
        return fp == (self.slots[at[0]] ^ self.slots[at[1]] ^ self.slots[at[2]])


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, sha, norm): digest (hex) and normalised text of every row; null text
    counts as empty."""
    return pick(df, id=key, text=text).select("id", norm_digest(F.col("text")).alias("sha"), normal(F.col("text")).alias("norm"))


def normal(text):
    return ascii_lower(F.coalesce(text, F.lit("")))


def norm_digest(text):
    """SHA-256 of the normalised text in UTF-8, lower-case hex."""
    return F.sha2(normal(text).cast("binary"), 256)


def _bucket(buckets: int):
    """Bucket of a digest from its last eight hex digits."""
    return F.pmod(F.conv(F.substring("sha", 57, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def _keys64(sha: pd.Series) -> np.ndarray:
    """64-bit filter keys: the first sixteen hex digits."""
    return np.array([int(x[:16], 16) for x in sha], np.uint64)


def snapshot_filters(distinct: DataFrame, buckets: int) -> DataFrame:
    """One immutable filter row per bucket: (bucket, seed, seg, slots)."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuse8.build(_keys64(pdf["sha"]))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [f.seed], "seg": [f.seg], "slots": [f.slots.tobytes()]})

    keyed = distinct.select("sha", _bucket(buckets).alias("bucket"))
    return durable(keyed.groupBy("bucket").applyInPandas(build, "bucket int, seed int, seg int, slots binary"))


def screen(distinct: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Digests that the snapshot's filters may hold (no false negatives)."""
    def probe(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        if not len(old) or not len(new):
            return new[["sha"]][:0]
        r = old.iloc[0]
        f = BinaryFuse8(int(r["seed"]), int(r["seg"]), np.frombuffer(r["slots"], np.uint8))
        return new[["sha"]][f.contains(_keys64(new["sha"]))]

    keyed = distinct.select("sha", _bucket(buckets).alias("bucket"))
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "sha string")


def group_copies(rows: DataFrame) -> DataFrame:
    """Copies inside one batch: (sha, n, top, low) from partial aggregates."""
    return rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))


def dedup(batches: list[DataFrame], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep one row of equal texts over snapshots and an incoming batch.

    ``batches``: oldest first; all but the last are immutable snapshots. The
    row with the largest key stays; of rows that repeat that key, each counts
    as the row that stays. Returns (key, keep_id, group_size, kept,
    text_sha256), one row per input row. Null and empty texts are equal. A
    null key is smaller than any other: it stays only if all keys of its group
    are null (keep_id null). Extra columns are ignored; empty tables give no
    rows.
    """
    parts = [digests(b, key, text) for b in batches]
    slim = [durable(p.select("id", "sha")) for p in parts]
    groups = group_copies(slim[0])
    for i in range(1, len(batches)):
        # everything before batch i is the snapshot that batch i meets
        old = durable(groups)
        buckets = max(1, -(-old.count() // BUCKET_KEYS))
        filters = snapshot_filters(old, buckets)
        fresh = durable(group_copies(slim[i]))
        positive = durable(screen(fresh, filters, buckets))
        equal = verified(positive, old, fresh, parts[:i], parts[i])
        merged = (old.unionByName(fresh.join(equal, "sha", "left_semi"))
                  .groupBy("sha").agg(F.sum("n").alias("n"), F.max("top").alias("top")))
        groups = merged.unionByName(fresh.join(equal, "sha", "left_anti"))
    groups = durable(groups)
    rows = slim[0]
    for s in slim[1:]:
        rows = rows.unionByName(s)
    total = groups.agg(F.sum("n")).first()[0] or 0
    out = attach_groups(rows, groups, "sha", "n", total)
    return out.select(F.col("id").alias(key), F.col("top").alias("keep_id"), F.col("n").cast("long").alias("group_size"),
                      F.col("id").eqNullSafe(F.col("top")).alias("kept"), F.col("sha").alias("text_sha256"))


def verified(positive: DataFrame, old: DataFrame, fresh: DataFrame, old_parts: list[DataFrame], new_part: DataFrame) -> DataFrame:
    """Positives whose bytes equal those of the snapshot's text.

    One text per digest and side is read (that of the largest key); a filter's
    false positive finds no partner and drops out here. Two texts of one
    digest with other bytes raise an error, as the digest would be broken.
    """
    def texts(part: DataFrame, groups: DataFrame, name: str) -> DataFrame:
        wanted = positive.join(groups, "sha").select("sha", F.col("top").alias("want"))
        hit = part.select("id", "norm").join(wanted, F.col("id").eqNullSafe(F.col("want")))
        return (hit.where(F.sha2(F.col("norm").cast("binary"), 256) == F.col("sha"))
                .groupBy("sha").agg(F.min("norm").alias(name)))

    before = old_parts[0]
    for p in old_parts[1:]:
        before = before.unionByName(p)
    both = texts(new_part, fresh, "new_text").join(texts(before, old, "old_text"), "sha")
    return durable(both.select("sha", F.when(F.col("new_text") == F.col("old_text"), F.lit(True))
                               .otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("boolean")).alias("same"))
                   .where("same").select("sha"))


def split_in_two(docs: DataFrame, key: str = "doc_id") -> list[DataFrame]:
    """The older half of the key range as snapshot, the newer half as batch."""
    lo, hi = docs.agg(F.min(key), F.max(key)).first()
    mid = 0 if lo is None else (int(lo) + int(hi)) // 2
    old = F.coalesce(F.col(key) <= F.lit(mid), F.lit(True))
    return [docs.where(old), docs.where(~old)]


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the older half of the ids is the snapshot that screens
    the newer half."""
    return dedup(split_in_two(table(spark, sf_dir, "documents")))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
