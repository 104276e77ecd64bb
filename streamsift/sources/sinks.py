"""Sinks and stored datasets.

Tensors, flow stores and reports are Parquet/CSV tables; dataset parameters
(time window, maximum flow length, dataset id) are columns, not file names.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import VALIDATION_HEADER
from ..operators.prefix import numbered


def save_samples(samples: DataFrame, path: str, time_window: float, max_flow_len: int, dataset_id: str,
                 split_col: str | None = "split") -> None:
    """(set_x, set_y[, split]) as Parquet, partitioned by split when given."""
    d = (samples.withColumn("time_window", F.lit(float(time_window)))
         .withColumn("max_flow_len", F.lit(int(max_flow_len))).withColumn("dataset_id", F.lit(dataset_id)))
    w = d.write.mode("overwrite")
    (w.partitionBy(split_col) if split_col and split_col in d.columns else w).parquet(path)


def load_samples(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Read a stored tensor dataset (optionally one split)."""
    d = spark.read.parquet(path)
    return d.where(F.col("split") == split) if split and "split" in d.columns else d


def merge_datasets(*dfs: DataFrame) -> DataFrame:
    """Concatenation of tensor datasets."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def check_flow_stores(stores: DataFrame) -> tuple[float, int, str]:
    """Stored flow sets must share time window and flow length; the id
    becomes 'IDS201X' when several ids are mixed.  One aggregate job."""
    r = stores.agg(F.countDistinct("time_window").alias("tw"), F.countDistinct("max_flow_len").alias("n"),
                   F.countDistinct("dataset_id").alias("ids"), F.first("time_window").alias("tw0"),
                   F.first("max_flow_len").alias("n0"), F.first("dataset_id").alias("id0")).first()
    if r["tw"] > 1 or r["n"] > 1:
        raise ValueError("flow stores differ in time window or maximum flow length")
    return r["tw0"], r["n0"], (r["id0"] if r["ids"] <= 1 else "IDS201X")


def cross_dataset_balance(samples: DataFrame, dataset_col: str = "dataset_id", split_col: str = "split",
                          order_col: str = "sample_id") -> DataFrame:
    """T4: per split, keep the first m rows of every dataset, m = size of the
    smallest dataset in that split. Rows are numbered in ranges, so no dataset
    is sorted in one task."""
    counts = samples.groupBy(split_col, dataset_col).count()
    m = counts.groupBy(split_col).agg(F.min("count").alias("_m"))
    d = numbered(samples, [split_col, dataset_col], [order_col], "_rn")
    return d.join(m, split_col).where(F.col("_rn") <= F.col("_m")).select(*samples.columns)


def write_report(report: DataFrame, path: str) -> None:
    """Prediction report as CSV with the fixed headers; numbers with 4
    decimals, N/A where no labels (null rates)."""
    def fmt(c):
        return F.coalesce(F.format_number(F.col(c), 4), F.lit("N/A"))
    cols = report.columns
    out = report.select(
        F.col("model").alias("Model") if "model" in cols else F.lit("").alias("Model"),
        (fmt("time") if "time" in cols else F.lit("N/A")).alias("Time"),
        (F.col("packets").cast("string") if "packets" in cols else F.lit("N/A")).alias("Packets"),
        F.col("samples").cast("string").alias("Samples"),
        fmt("ddos_pct").alias("DDOS%"), fmt("accuracy").alias("Accuracy"), fmt("f1").alias("F1Score"),
        fmt("tpr").alias("TPR"), fmt("fpr").alias("FPR"), fmt("tnr").alias("TNR"), fmt("fnr").alias("FNR"),
        (F.col("source") if "source" in cols else F.lit("")).alias("Source"))
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_validation_report(report: DataFrame, path: str) -> None:
    """Validation report as CSV with its header; numbers with 4 decimals."""
    cols = [F.col("model"), F.col("samples").cast("string"), F.format_string("%.4f", "accuracy"), F.format_string("%.4f", "f1"),
            F.col("parameters"), F.col("source")]
    out = report.select(*[c.alias(n) for c, n in zip(cols, VALIDATION_HEADER)])
    out.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_run_history(spark: SparkSession, path: str, **fields) -> None:
    """One row per run appended to a Parquet history table."""
    row = {"run_time": _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S"),
           **{k: str(v) for k, v in fields.items()}}
    spark.createDataFrame([row]).write.mode("append").parquet(path)
