"""Two-phase ordered scans that never put a whole group into one task.

Every helper splits the ordered sequence of a group into chunks of bounded
size, computes per-chunk totals with a partial aggregation, turns the small
chunk table into carries with a window over chunk ids, and finishes inside
each chunk.  A key holding a third of all rows is spread over many chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK_ROWS = 1 << 15
UNB_PREC = Window.unboundedPreceding
UNB_FOLL = Window.unboundedFollowing


def int_div(col: str | Column, divisor: int) -> Column:
    """Floor division of an integral column by a positive integer, exact."""
    c = F.col(col) if isinstance(col, str) else col
    d = F.lit(int(divisor)).cast("long")
    return ((c.cast("long") - F.pmod(c.cast("long"), d)) / d).cast("long")


def running_max(df: DataFrame, by: list[str], order: str, value: str, out: str,
                prev_out: str | None = None, chunk_rows: int = DEFAULT_CHUNK_ROWS,
                chunk_col: str | None = None) -> DataFrame:
    """Inclusive running max of ``value`` per ``by`` in ``order`` (and the
    exclusive one in ``prev_out``, null for the first row of a group).

    ``order`` must be unique inside a group; chunks are ranges of it (or the
    given ``chunk_col``).
    """
    ch = F.col(chunk_col) if chunk_col else int_div(order, chunk_rows)
    d = df.withColumn("_ch", ch)
    carry = (d.groupBy(*by, "_ch").agg(F.max(value).alias("_cm"))
             .withColumn("_carry", F.max("_cm").over(
                 Window.partitionBy(*by).orderBy("_ch").rowsBetween(UNB_PREC, -1)))
             .drop("_cm"))
    d = d.join(carry, [*by, "_ch"], "left")
    w = Window.partitionBy(*by, "_ch").orderBy(order)
    d = d.withColumn(out, F.greatest(F.col("_carry"), F.max(value).over(w.rowsBetween(UNB_PREC, 0))))
    if prev_out:
        d = d.withColumn(prev_out, F.greatest(F.col("_carry"), F.max(value).over(w.rowsBetween(UNB_PREC, -1))))
    return d.drop("_ch", "_carry")


def prefix_sum(df: DataFrame, by: list[str], order: list[str], value: str, out: str,
               bucket: Column, exclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` per ``by`` in ``order`` (exclusive by default).

    ``bucket`` must be a monotone function of ``order`` (e.g. a prefix of a
    hash used as the sort key) so bucket totals can be carried in bucket order.
    """
    d = df.withColumn("_bk", bucket)
    carry = (d.groupBy(*by, "_bk").agg(F.sum(value).alias("_bs"))
             .withColumn("_carry", F.coalesce(F.sum("_bs").over(
                 Window.partitionBy(*by).orderBy("_bk").rowsBetween(UNB_PREC, -1)), F.lit(0)))
             .drop("_bs"))
    d = d.join(carry, [*by, "_bk"], "left")
    w = Window.partitionBy(*by, "_bk").orderBy(*order)
    frame = w.rowsBetween(UNB_PREC, -1) if exclusive else w.rowsBetween(UNB_PREC, 0)
    d = d.withColumn(out, F.col("_carry") + F.coalesce(F.sum(value).over(frame), F.lit(0)))
    return d.drop("_bk", "_carry")


def last_known(df: DataFrame, by: list[str], order: str, values: dict[str, Column], chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Per row and ``out -> value``: the last non-null value of the earlier
    rows of its ``by`` group in ``order`` (null if there is none)."""
    d = df.withColumn("_ch", int_div(order, chunk_rows)).withColumns({f"_v_{o}": v for o, v in values.items()})
    earlier = Window.partitionBy(*by).orderBy("_ch").rowsBetween(UNB_PREC, -1)
    carry = (d.groupBy(*by, "_ch").agg(*[F.max_by(f"_v_{o}", F.when(F.col(f"_v_{o}").isNotNull(), F.col(order))).alias(f"_l_{o}") for o in values])
             .select(*by, "_ch", *[F.last(f"_l_{o}", ignorenulls=True).over(earlier).alias(f"_c_{o}") for o in values]))
    d = d.join(carry, [*by, "_ch"], "left")
    w = Window.partitionBy(*by, "_ch").orderBy(order).rowsBetween(UNB_PREC, -1)
    d = d.withColumns({o: F.coalesce(F.last(f"_v_{o}", ignorenulls=True).over(w), F.col(f"_c_{o}")) for o in values})
    return d.drop("_ch", *[f"_{x}_{o}" for o in values for x in "vc"])


def numbered(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """Adds the 1-based place of every row in its ``by`` group in ``order``.

    Rows are sorted in ranges of (by, order), so a group of any size spreads
    over tasks; a written table fixes the places, and what is carried between
    ranges is one row per range and group in it."""
    from ..session import cut_lineage
    ranged = df.repartitionByRange(*[F.col(c) for c in [*by, *order]]).sortWithinPartitions(*by, *order)
    d = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_at", 33)))
    w = Window.partitionBy(*by).orderBy("_p")
    per = (d.groupBy(*by, "_p").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
           .select(*by, "_p", (F.sum("_n").over(w) - F.col("_n") - F.col("_first") + 1).alias("_base")))
    return d.join(per, [*by, "_p"]).withColumn(out, F.col("_at") + F.col("_base")).drop("_at", "_p", "_base")
