"""Mixing sources to target weights with deterministic repetition.

Tokens are summed per source, target weights become repetition rates, and a
document is emitted floor(rate) times plus one more copy when a hash of the
document falls below the rate's fraction. DataFrame functions only.

Targets share the total by weight; a source's target stops at ``ceiling``
times its size and the excess goes to the others by weight, until none is
above. This is the point t with sum(min(ceiling * size, weight * t)) = total,
found by Newton steps on sums over the table of sources: every step fixes the
sources that are above, so sums are exact integers and the steps end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from streamsift.llm.common import durable, pick, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at this many times the source's size.
CEILING = 3
#: White-space separated words.
WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of a document's hash that make its draw.
DIGITS = 13


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, text: Column) -> Column:
    """A number in [0, 1) from the document's key and text. Rows equal in both
    share it; a key that repeats with other texts draws for each."""
    seed = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(seed.cast("binary")), 1, DIGITS), 16, 10).cast("long").cast("double") / F.lit(float(16 ** DIGITS))


def source_key(source: Column) -> Column:
    """A key without nulls that sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``rank`` (from 0, by the distinct ``key``). Rows are sorted in
    ranges and a written table fixes each row's place, so that no task sorts
    all of them; the carried table has one row per range."""
    at = F.monotonically_increasing_id()   # range number and place in it
    placed = durable(rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("at", at)
                     .select("*", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    base = (placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
            .select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("base")))
    return placed.join(base, "range").withColumn("rank", F.col("base") + F.col("place")).drop("at", "range", "place", "base")


def rates(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(skey, source_size, target, rate) per source from (skey, source_size).

    Weights are positive integers given to the sources in the order of
    ``skey``, repeating. A source without words has target and rate 0; so has
    every source if there are no words at all.
    """
    if not weights or min(weights) <= 0 or any(w != int(w) for w in weights) or ceiling < 1 or ceiling != int(ceiling):
        raise ValueError("weights and ceiling must be positive integers")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    wide = "decimal(38,0)"
    src = durable(ranked(sizes, "skey").withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank"))
    cap = F.col("source_size").cast(wide) * int(ceiling)
    total, per_weight = src.agg(F.sum(F.col("source_size").cast(wide)), F.sum("weight").cast(wide)).first()
    over, under = int(total or 0), int(per_weight or 0)   # the common level is over / under words per unit of weight
    while under:
        stopped = cap * F.lit(under).cast(wide) < F.col("weight") * F.lit(over).cast(wide)
        full, rest = src.agg(F.sum(F.when(stopped, cap)), F.sum(F.when(~stopped, F.col("weight")))).first()
        new = int(total) - int(full or 0), int(rest or 0)
        if new == (over, under):
            break
        over, under = new
    level = F.lit(float(over)) / F.lit(float(max(under, 1))) * F.col("weight")
    target = F.when(F.lit(bool(under)), F.least(level, cap.cast("double"))).otherwise(cap.cast("double"))
    return src.select("skey", F.col("source_size").cast("long").alias("source_size"), target.alias("target"),
                      F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def copies(rate: Column, u: Column) -> Column:
    """floor(rate) and one more where the draw is below the fraction."""
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def plan_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
             weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(key, size, source_size, target, copies) of every row of ``docs``.

    A null text has 0 words. A null source is a source of its own, last in
    order. Equal rows (key and text) share their draw, so they are taken
    alike. Extra columns are ignored; an empty table gives no rows. Texts are
    read once: sizes and draws are written, and the sources' rates join them
    by broadcast if their file is small enough for Spark, else by a shuffle
    whose skewed keys are split.
    """
    rows = pick(docs, key=key, text=text, source=source)
    known = durable(rows.select("key", source_key(F.col("source")).alias("skey"), word_count(F.col("text")).alias("size"), draw(F.col("key"), F.col("text")).alias("u")))
    rate = durable(rates(known.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, ceiling))
    return known.join(rate, "skey").select(F.col("key").alias(key), "size", "source_size", "target", copies(F.col("rate"), F.col("u")).alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """The mixed corpus: every row of ``docs`` with all its columns, once per
    copy that it is taken. Null, empty and repeated rows as in ``plan_mix``;
    the texts stay where they are read unless the table of sources is too
    large to broadcast."""
    rows = pick(docs, key=key, text=text, source=source)
    sizes = rows.select(source_key(F.col("source")).alias("skey"), word_count(F.col("text")).alias("size")).groupBy("skey").agg(F.sum("size").alias("source_size"))
    rate = durable(rates(sizes, weights, ceiling)).select("skey", "rate")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    doc = F.col("doc")
    taken = copies(F.col("rate"), draw(doc[key], doc[text]))
    return (whole.withColumn("skey", source_key(doc[source])).join(rate, "skey")
            .withColumn("copy", F.explode(F.when(taken > 0, F.sequence(F.lit(1).cast("long"), taken)))).select("doc.*"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by the weights 5, 2, 1 with at most 3 repetitions."""
    out = plan_mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS DOUBLE)
           / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER w AS place, sum(source_size) OVER () - 3 * (sum(source_size) OVER w - source_size) AS over_,
         sum(weight) OVER () - (sum(weight) OVER w - weight) AS under_
  FROM s WINDOW w AS (ORDER BY source_size * 10 // weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (
  SELECT arg_min(CAST(over_ AS DOUBLE) / CAST(under_ AS DOUBLE), place) AS lev
  FROM o WHERE 3 * source_size * under_ >= weight * over_),
t AS (SELECT source, source_size, least(lev * weight, 3.0 * source_size) AS target FROM s, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
