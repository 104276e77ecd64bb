"""Rendezvous (highest random weight) sharding of stable record keys.

Every (key, shard) pair has a fixed pseudo-random score; a record goes to the
shard with the highest one. Adding a shard adds one score per record and
leaves all others as they are, so rows move only into the new shard. A shard
of weight w scores ``-w / ln(u)``, which gives it a w-share of the records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from streamsift.llm.common import durable, pick, table

#: Rows of one shard that one task numbers at most (about).
SLOT_ROWS = 200_000


def score(key: Column, shard: int, weight: float) -> Column:
    """Score of one shard: -weight / ln(u), u from 52 hash bits, in (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12)
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.lit(-float(weight)) / F.log(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """struct(score, shard) of the winning shard. Equal scores: higher shard."""
    return F.greatest(*[F.struct(score(key, s, w).alias("score"), F.lit(s).alias("shard"))
                        for s, w in enumerate(weights)])


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text",
                  weights: Sequence[float] = (1.0,) * 24, next_weight: float = 1.0) -> DataFrame:
    """Shard, grown shard and slot of every row.

    Returns (key, size, text_crc32, shard, grown_shard, slot). ``size`` is the
    UTF-8 length of the text plus 8; a null text counts as 0 bytes (crc 0). A
    null key is a key like any other. Rows that repeat a key go to the same
    shard; slots number the rows of a shard from 0 without gaps, ordered by a
    hash bucket of key, size and crc and then by these, so that no task sorts
    a whole shard. Rows equal in all three are counted before they are
    numbered, and expanded in chunks, so neither a key nor a row that repeats
    very often falls to one task. Extra columns are ignored; an empty table
    gives an empty result.
    """
    if len(weights) < 2 or min(weights) <= 0 or next_weight <= 0:
        raise ValueError("at least two shards with positive weights")
    rows = pick(df, key=key, text=text)
    name = F.coalesce(F.col("key").cast("string"), F.lit("\x00null"))
    best = rendezvous(name, weights)
    new = score(name, len(weights), next_weight)
    body = F.coalesce(F.col("text"), F.lit(""))
    keyed = (
        rows.select("key", (F.octet_length(body) + 8).cast("long").alias("size"),
                    F.crc32(body.cast("binary")).alias("text_crc32"), best.alias("best"), new.alias("new"), name.alias("name"))
        .select("key", "size", "text_crc32", F.col("best.shard").alias("shard"),
                F.when(F.col("new") > F.col("best.score"), F.lit(len(weights)))
                .otherwise(F.col("best.shard")).cast("int").alias("grown_shard"),
                F.xxhash64("name", "size", "text_crc32", F.lit("slot")).alias("h")))
    kinds = durable(keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n")))
    most, widest = kinds.groupBy("shard").agg(F.sum("n").alias("n"), F.max("n").alias("top")).agg(F.max("n"), F.max("top")).first()
    buckets = max(1, -(-(most or 0) // SLOT_ROWS), -(-kinds.sparkSession.sparkContext.defaultParallelism // len(weights)))
    cell = kinds.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    base = (cell.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
            .withColumn("base", F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n"))
            .select("shard", "bucket", "base"))
    place = W.partitionBy("shard", "bucket").orderBy("key", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    step = F.lit(SLOT_ROWS).cast("long")
    chunks = (cell.withColumn("at", F.coalesce(F.sum("n").over(place), F.lit(0))).join(base, ["shard", "bucket"])
              .withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step))))
    if (widest or 0) > SLOT_ROWS:
        chunks = chunks.repartition("shard", "bucket", "key", "size", "text_crc32", "low")
    return (chunks.withColumn("k", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + step, F.col("n")) - 1)))
            .select("key", "size", "text_crc32", "shard", "grown_shard",
                    (F.col("base") + F.col("at") + F.col("k")).cast("long").alias("slot"))
            .withColumnRenamed("key", key))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 24) -> None:
    """Write the rows of ``df`` into one folder per shard. The assignment is a
    row-wise expression, so nothing is shuffled."""
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\x00null"))
    df.withColumn("shard", rendezvous(name, weights)["shard"]).write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 equal shards under the law ``key``."""
    out = assign_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
