"""Time windows over packet captures.

Anchored windows: per capture and in capture order, a frame opens a new
window when its timestamp exceeds ``start + width``; the window start is
that frame's timestamp.  Every frame counts, accepted or not.

Only a frame that raises the running maximum of the timestamps can open a
window, so the anchors are the greedy chain over the distinct running
maxima ``T``: ``a0 = first T``, ``a(k+1) = min{T : T > a(k) + width}``.
Spark plan (all exact integer microseconds):

1. ``T`` = running max per capture (two-phase, ``prefix.running_max``),
   written once with the frames; the candidates are the rows where it grows.
2. Time is cut into segments of many window widths (fewer where frames are
   dense, so that a segment holds a bounded number of candidates on average).
   A chain can enter a segment only in its first width or at the first
   candidate after it. One pass over the candidates, a group per segment,
   finds where each of these entries leaves the segment. A segment that holds
   more candidates than its share is cut into single widths; there every
   candidate is an entry and leaves at once, which needs no group.
3. The entries are linked to the first entry after they leave (a running
   minimum in bounded chunks), and the chain's entries are marked by pointer
   doubling on that table alone.
4. A second pass over the segments expands each marked entry to its anchors;
   in a single width the entry is the anchor.
5. A bucket of one width holds at most one anchor (anchors are more than a
   width apart), so a frame's window is the anchor of its bucket when that is
   not after it, else the anchor of the bucket before: one equi-join with a
   table of at most two rows per window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .prefix import DEFAULT_CHUNK_ROWS, int_div, running_max

NONE = np.zeros(0, np.int64)

#: Candidates of one segment, about; with ``CROWDED`` times as many it is cut into single widths.
SEGMENT_ROWS = 200_000
CROWDED = 2


def _follow(x: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Last anchor of the chains that start at positions ``start`` of the
    sorted candidates, and every position's successor."""
    nxt = np.searchsorted(x, x + width, side="right")
    pos = start.copy()
    live = np.flatnonzero(nxt[pos] < len(x))
    while len(live):
        pos[live] = nxt[pos[live]]
        live = live[nxt[pos[live]] < len(x)]
    return pos, nxt


def _frame(name: str, value, **cols) -> pd.DataFrame:
    """A result frame with one constant first column, kept as plain objects."""
    n = len(next(iter(cols.values())))
    return pd.DataFrame({name: pd.Series([value] * n, dtype=object), **cols})


def _double(state: DataFrame, cap: str) -> DataFrame:
    """One pointer-doubling step: jump := jump(jump), on := on + jump(on)."""
    j2 = state.select(cap, F.col("x").alias("jump"), F.col("jump").alias("jump2"))
    hits = (state.where(F.col("on") & F.col("jump").isNotNull())
            .select(cap, F.col("jump").alias("x"), F.lit(True).alias("hit")))
    return (state.join(j2, [cap, "jump"], "left").join(hits, [cap, "x"], "left")
            .select(cap, "x", "seg", "alone", F.col("jump2").alias("jump"),
                    (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on")))


def window_anchors(running: DataFrame, width_us: int, capture: str = "capture_id",
                   segment_rows: int = SEGMENT_ROWS, max_rounds: int = 64) -> DataFrame:
    """Anchors (window starts) of every capture: (capture, anchor_us), from
    frames with their running maximum ``_T`` and the one before it ``_Tp``."""
    cap, w = capture, int(width_us)
    kind = dict(running.dtypes)[cap]
    cand = running.where((F.col("_Tp").isNull() | (F.col("_T") > F.col("_Tp"))) & F.col("_T").isNotNull()).select(cap, F.col("_T").alias("x"))
    span = cand.groupBy(cap).agg(F.min("x").alias("t0"), F.max("x").alias("t1"), F.count(F.lit(1)).alias("n"))
    widths = F.greatest(F.lit(1), F.floor(F.lit(segment_rows) * ((F.col("t1") - F.col("t0")) / F.lit(w) + 1) / F.col("n")))
    # time per chunk of the links: no more than a width, and a bounded number of candidates on average
    pace = F.greatest(F.lit(1), F.least(F.lit(w), F.floor(F.lit(segment_rows) * (F.col("t1") - F.col("t0")) / F.col("n"))))
    # written, so that Spark knows how small it is and does not deal the candidates by capture
    span = cut_lineage(span.select(cap, "t0", (widths * F.lit(w)).cast("long").alias("step"), pace.cast("long").alias("pace")))
    cand = cut_lineage(cand.join(span, cap).select(cap, "x", F.expr("(x - t0) div step").alias("seg"), F.expr("t0 + ((x - t0) div step) * step").alias("base"),
                                                   "t0", "pace", "step"))
    single = cut_lineage(cand.groupBy(cap, "seg").agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("step"))
                         .where((F.col("step") <= w) | (F.col("n") > CROWDED * segment_rows)).select(cap, "seg"))
    alone, shared = cand.join(single, [cap, "seg"]), cand.join(single, [cap, "seg"], "left_anti")

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["x"].to_numpy())
        first = int(np.searchsorted(x, pdf["base"].iloc[0] + w)) + 1   # those of the first width and one more
        start = np.arange(min(first, len(x)))
        pos, _ = _follow(x, start, w)
        return _frame(cap, pdf[cap].iloc[0], seg=np.full(len(start), pdf["seg"].iloc[0]), x=x[start], theta=x[pos] + w)

    left = (shared.select(cap, "seg", "x", "base").groupBy(cap, "seg").applyInPandas(exits, f"{cap} {kind}, seg long, x long, theta long")
            .join(span.drop("step"), cap))
    entry = cut_lineage(left.select(cap, "seg", "x", "theta", "t0", "pace", F.lit(False).alias("alone")).unionByName(
        alone.select(cap, "seg", "x", (F.col("x") + w).alias("theta"), "t0", "pace", F.lit(True).alias("alone"))))
    # the first entry after theta: a running maximum of -x from late to early, where an entry comes after a theta of the same time
    ends = entry.select(cap, "seg", "x", "alone", "t0", "pace", F.col("theta").alias("p"), F.lit(None).cast("long").alias("y"), (F.col("theta") * -2 - 1).alias("o"))
    places = entry.select(cap, "seg", "x", "alone", "t0", "pace", F.col("x").alias("p"), -F.col("x"), F.col("x") * -2)
    both = ends.unionAll(places).withColumn("chunk", F.expr("-((p - t0) div pace)"))
    linked = running_max(both, [cap], "o", "y", "jump", chunk_col="chunk").where("y is null").select(cap, "x", "seg", (-F.col("jump")).alias("jump"), "alone")
    roots = entry.groupBy(cap).agg(F.min("x").alias("x")).withColumn("root", F.lit(True))
    state = cut_lineage(linked.join(roots, [cap, "x"], "left").select(cap, "x", "seg", "alone", "jump", F.coalesce("root", F.lit(False)).alias("on")))
    for _ in range(max_rounds):
        # a marked entry with a jump means some chain goes on past its marked prefix
        if state.where(F.col("on") & F.col("jump").isNotNull()).limit(1).count() == 0:
            break
        state = cut_lineage(_double(_double(state, cap), cap))
    else:
        raise RuntimeError("anchored windows: chain longer than 4^max_rounds")

    def expand(all_: pd.DataFrame, on: pd.DataFrame) -> pd.DataFrame:
        if not len(on) or not len(all_):
            return _frame(cap, None, anchor_us=NONE)
        x = np.sort(all_["x"].to_numpy())
        nxt = np.searchsorted(x, x + w, side="right")
        out, k = [], int(np.searchsorted(x, on["y"].min()))
        while k < len(x):
            out.append(int(x[k]))
            k = int(nxt[k])
        return _frame(cap, all_[cap].iloc[0], anchor_us=np.array(out, np.int64))

    marked = state.where("on AND NOT alone").select(F.col(cap).alias("in_cap"), F.col("seg").alias("at"), F.col("x").alias("y"))
    inside = (shared.select(cap, "seg", "x").groupBy(cap, "seg").cogroup(marked.groupBy("in_cap", "at"))
              .applyInPandas(expand, f"{cap} {kind}, anchor_us long"))
    return inside.unionByName(state.where("on AND alone").select(cap, F.col("x").alias("anchor_us")))


def anchored_windows(packets: DataFrame, width_us: int, capture: str = "capture_id", seq: str = "seq",
                     ts: str = "ts_us", out: str = "window_start_us", segment_rows: int = SEGMENT_ROWS,
                     chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Adds ``out`` (window start in µs) to every frame of ``packets``."""
    cap = capture
    d = cut_lineage(running_max(packets, [cap], seq, ts, "_T", prev_out="_Tp", chunk_rows=chunk_rows))
    anchors = window_anchors(d, width_us, cap, segment_rows)
    ab = anchors.withColumn("b", int_div("anchor_us", width_us))
    own = ab.select(cap, "b", F.col("anchor_us").alias("own"), F.lit(None).cast("long").alias("prev"))
    prev = ab.select(cap, (F.col("b") + 1).alias("b"), F.lit(None).cast("long").alias("own"),
                     F.col("anchor_us").alias("prev"))
    lookup = cut_lineage(own.unionByName(prev).groupBy(cap, "b").agg(F.max("own").alias("own"), F.max("prev").alias("prev")))
    d = d.withColumn("b", int_div("_T", width_us)).join(lookup, [cap, "b"], "left")
    start = F.when(F.col("own").isNotNull() & (F.col("own") <= F.col("_T")), F.col("own")).otherwise(F.col("prev"))
    return d.withColumn(out, start).drop("b", "own", "prev", "_T", "_Tp")


def anchored_windows_sql(width_us: int, src: str = "pk") -> str:
    """DuckDB oracle: recursive chain over the distinct running maxima."""
    return f"""
    cand AS (SELECT DISTINCT capture_id, max(ts_us) OVER (PARTITION BY capture_id ORDER BY seq
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_max_us FROM {src}),
    chain(capture_id, a) AS (
        SELECT capture_id, min(run_max_us) FROM cand GROUP BY capture_id
        UNION ALL
        SELECT ch.capture_id, (SELECT min(c.run_max_us) FROM cand c WHERE c.capture_id = ch.capture_id
                                 AND c.run_max_us > ch.a + {int(width_us)})
        FROM chain ch WHERE ch.a IS NOT NULL),
    anchors AS (SELECT capture_id, a FROM chain WHERE a IS NOT NULL),
    win AS (SELECT p.*, (SELECT max(an.a) FROM anchors an WHERE an.capture_id = p.capture_id AND an.a <= p.run_max_us)
                   AS window_start_us
            FROM (SELECT *, max(ts_us) OVER (PARTITION BY capture_id ORDER BY seq
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_max_us FROM {src}) p)"""
