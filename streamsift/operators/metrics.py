"""Detection metrics, score comparisons and reference distances
(A7-A15, J5, J6, F5, F8, R6).

All reports are conditional aggregations; the only non-relational step is
the distance to a reference set, done with numpy on pairs of blocks.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import safe_div

# Fixed values of the report sink: column headers in output order.
REPORT_HEADER = ["Model", "Time", "Packets", "Samples", "DDOS%", "Accuracy", "F1Score",
                 "TPR", "FPR", "TNR", "FNR", "Source"]
VALIDATION_HEADER = ["Model", "Samples", "Accuracy", "F1Score", "Hyper-parameters", "Validation Set"]


def alert(score: Column, threshold: float | Column) -> Column:
    """strictly above the threshold."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (score > thr).cast("int")


def confusion_report(preds: DataFrame, group: list[str], label: str = "label", pred: str = "pred",
                     packets: str | None = None) -> DataFrame:
    """Tn, fp, fn, tp and the derived rates per group.

    Accuracy and F1 (0 when undefined); TPR, FPR, TNR, FNR null on 0/0;
    DDOS% = share of positive predictions.  Labels and predictions above 0
    are positive, so every row with both values is in one of the four cells.
    """
    y, p = F.col(label) > 0, F.col(pred) > 0
    agg = [F.sum(F.when(~y & ~p, 1).otherwise(0)).alias("tn"), F.sum(F.when(~y & p, 1).otherwise(0)).alias("fp"),
           F.sum(F.when(y & ~p, 1).otherwise(0)).alias("fn"), F.sum(F.when(y & p, 1).otherwise(0)).alias("tp"),
           F.count("*").alias("samples"), F.avg(p.cast("double")).alias("ddos_pct")]
    if packets:
        agg.append(F.sum(packets).alias("packets"))
    r = preds.groupBy(*group).agg(*agg)
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    return r.select(
        *group, *[F.col(c).cast("long").alias(c) for c in ("tn", "fp", "fn", "tp", "samples")],
        *([F.col("packets").cast("long")] if packets else []),
        "ddos_pct",
        ((tp + tn) / F.col("samples").cast("double")).alias("accuracy"),
        safe_div(2 * tp, 2 * tp + fp + fn, F.lit(0.0)).alias("f1"),
        safe_div(tp, tp + fn).alias("tpr"), safe_div(fp, fp + tn).alias("fpr"),
        safe_div(tn, tn + fp).alias("tnr"), safe_div(fn, fn + tp).alias("fnr"))


def validation_report(preds: DataFrame, model: str, parameters: dict, source: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """One row with model, samples, accuracy, F1 (0 when undefined), the
    parameters as JSON by name and the validation set. No row without predictions."""
    r = confusion_report(preds.withColumn("model", F.lit(model)).withColumn("source", F.lit(source)), ["model", "source"], label, pred)
    return r.select("model", "samples", "accuracy", "f1", F.lit(json.dumps(parameters, sort_keys=True)).alias("parameters"), "source")


def align_scores(before: DataFrame, after: DataFrame, keys: list[str], score: str = "rmse") -> DataFrame:
    """Positional alignment = inner join on the packet identity; rows
    present in only one version are dropped (truncation to the shorter)."""
    return (before.select(*keys, F.col(score).alias("before"))
            .join(after.select(*keys, F.col(score).alias("after")), keys))


def remove_outliers(aligned: DataFrame, extend: float = 2.0, vector: str | None = None) -> DataFrame:
    """F8: zero an after-score above extend*before or above extend*mean(before);
    adds ``removed`` (0/1), whose sum is the number of removed rows.  With
    ``vector`` the row's feature array is zeroed too.  The mean is one global
    aggregate."""
    mean_before = aligned.agg(F.avg("before").alias("m")).first()["m"] or 0.0
    out = (F.col("after") > F.col("before") * extend) | (F.col("after") > F.lit(mean_before * extend))
    if vector:
        zeros = F.transform(vector, lambda v: F.lit(0.0))
        aligned = aligned.withColumn(vector, F.when(out, zeros).otherwise(F.col(vector)))
    return (aligned.withColumn("removed", out.cast("int"))
            .withColumn("after", F.when(out, F.lit(0.0)).otherwise(F.col("after"))))


def score_summary(scores: DataFrame, threshold: float, score: str = "rmse", group: list[str] | None = None) -> DataFrame:
    """A10 (and A9 via max): alerts above threshold, total, mean, max."""
    g = scores.groupBy(*(group or []))
    return g.agg(F.sum(alert(F.col(score), threshold)).cast("long").alias("alerts"),
                 F.count("*").cast("long").alias("total"), F.avg(score).alias("mean"), F.max(score).alias("max"))


def robustness(before: DataFrame, after: DataFrame, threshold: float, t: str = "t", score: str = "rmse",
               crafted: str | None = "crafted") -> DataFrame:
    """Duration, size, score and detection reductions (after vs
    before), as one row from a single aggregation over both versions."""
    both = (before.select(F.lit("before").alias("_v"), t, score)
            .unionByName(after.select(F.lit("after").alias("_v"), t, score)))
    aggs = []
    for name in ("before", "after"):
        on = F.col("_v") == name
        aggs += [(F.max(F.when(on, F.col(t))) - F.min(F.when(on, F.col(t)))).alias(f"dur_{name}"),
                 F.count(F.when(on, F.lit(1))).cast("long").alias(f"n_{name}"),
                 F.avg(F.when(on, F.col(score))).alias(f"mean_{name}"),
                 F.sum(F.when(on, alert(F.col(score), threshold)).otherwise(0)).cast("long").alias(f"det_{name}")]
    j = both.agg(*aggs)
    return j.select(
        "dur_before", "dur_after", safe_div(F.col("dur_after") - F.col("dur_before"), F.col("dur_before")).alias("duration_rate"),
        "n_before", "n_after",
        safe_div((F.col("n_after") - F.col("n_before")).cast("double"), F.col("n_before").cast("double")).alias("size_rate"),
        "mean_before", "mean_after",
        safe_div(F.col("mean_before") - F.col("mean_after"), F.col("mean_before")).alias("score_reduction"),
        "det_before", "det_after",
        safe_div((F.col("det_before") - F.col("det_after")).cast("double"), F.col("det_before").cast("double"))
        .alias("detection_reduction"))


#: Rows of one block of queries or references in ``reference_distances``.
BLOCK_ROWS = 1024

#: Values of the queries or references that one group of blocks holds at most (32 MB).
GROUP_VALUES = 1 << 22


def reference_distances(queries: DataFrame, reference: DataFrame, id_col: str, vec_col: str,
                        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per query row, min and max Euclidean distance to every reference row.

    Both sides are dealt into groups; every pair of groups is one group of a
    cogroup, which compares blocks of ``block_rows`` rows and returns a partial
    min and max per query row.  A side is copied once per group of the other
    side, so there are no more groups than keep the tasks busy and a group
    below ``GROUP_VALUES`` values.  The same plan serves any size, nothing
    passes through the driver, and no pair of rows is emitted.  Rows that
    repeat an id stay rows of their own; without reference rows the distances
    are null.
    """
    from ..session import cut_lineage
    kind = dict(queries.dtypes)[id_col]
    q = cut_lineage(queries.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
                    .withColumn("row", F.monotonically_increasing_id()))
    r = cut_lineage(reference.select(F.col(vec_col).cast("array<double>").alias("v")))
    nq, nr = _groups(*((s["n"], max(1, s["width"] or 1)) for s in (d.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first() for d in (q, r))),
                     block_rows, q.sparkSession.sparkContext.defaultParallelism)
    rid = F.monotonically_increasing_id()
    qs = (q.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(nq)))
          .withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nr - 1).cast("long")))))
    rs = (r.withColumn("rb", F.pmod(F.xxhash64(rid), F.lit(nr)))
          .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long")))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"row": [], "lo": [], "hi": []}).astype({"row": "int64"})
        x, y = (np.stack(d["v"].to_numpy()).astype(np.float64) for d in (left, right))
        norm, lo, hi = (y * y).sum(axis=1), np.full(len(x), np.inf), np.full(len(x), -np.inf)
        for a in range(0, len(x), block_rows):
            own = slice(a, a + block_rows)
            for b in range(0, len(y), block_rows):
                other = y[b:b + block_rows]
                square = norm[None, b:b + block_rows] - 2.0 * (x[own] @ other.T)   # distance squared less |x|^2
                near, far = (np.sqrt(((x[own] - other[k]) ** 2).sum(axis=1)) for k in (square.argmin(axis=1), square.argmax(axis=1)))
                lo[own], hi[own] = np.minimum(lo[own], near), np.maximum(hi[own], far)
        return pd.DataFrame({"row": left["row"].to_numpy(), "lo": lo, "hi": hi})

    part = (qs.select("qb", "rb", "row", "v").groupBy("qb", "rb").cogroup(rs.groupBy("qb", "rb"))
            .applyInPandas(run, "row long, lo double, hi double"))
    best = part.groupBy("row").agg(F.min("lo").alias("min_dist"), F.max("hi").alias("max_dist"))
    return q.select("row", F.col("id").cast(kind).alias(id_col)).join(best, "row", "left").select(id_col, "min_dist", "max_dist")


def _groups(queries: tuple[int, int], reference: tuple[int, int], block_rows: int, tasks: int) -> tuple[int, int]:
    """Groups of both sides, given as (rows, width): as many as ``GROUP_VALUES``
    asks for, then more queries' groups (the smaller side is the one to copy)
    until there are four a task, but no group below a block."""
    (n, wn), (m, wm) = queries, reference
    nq, nr = max(1, -(-n * wn // GROUP_VALUES)), max(1, -(-m * wm // GROUP_VALUES))
    most_q, most_r = max(nq, -(-n // block_rows)), max(nr, -(-m // block_rows))
    if n >= m:
        nq = min(most_q, max(nq, -(-4 * tasks // nr)))
        nr = min(most_r, max(nr, -(-4 * tasks // nq)))
    else:
        nr = min(most_r, max(nr, -(-4 * tasks // nq)))
        nq = min(most_q, max(nq, -(-4 * tasks // nr)))
    return nq, nr


def euclidean(a: Column, b: Column) -> Column:
    """R6 as a Catalyst expression."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def proximity_ratio(before_dist: DataFrame, after_dist: DataFrame) -> DataFrame:
    """1 - sum(min distance after) / sum(max distance before), one aggregation."""
    both = (before_dist.select(F.col("max_dist").alias("_b"), F.lit(None).cast("double").alias("_a"))
            .unionByName(after_dist.select(F.lit(None).cast("double").alias("_b"), F.col("min_dist").alias("_a"))))
    r = both.agg(F.sum("_b").alias("org_dis"), F.sum("_a").alias("mut_dis"))
    return r.select("org_dis", "mut_dis", (F.lit(1.0) - F.col("mut_dis") / F.col("org_dis")).alias("proximity_ratio"))
