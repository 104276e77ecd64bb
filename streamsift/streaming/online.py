"""Structured Streaming sources, windows and stateless scores (S11, ST3, ST4).

* ``replay_files``: lands a table as files in capture order, a fixed number per
  part, so that a file stream replays it; tests and the registered queries use
  it with ``trigger(availableNow=True)``: no port, no server.
* ``stream_flow_windows``: event-time windows with a watermark; flows are
  summarised per window and labelled by a stream-static join.
* ``stream_scores``: the detector's stateless scoring inside a streaming
  projection (``mapInPandas`` works on streams unchanged).

Jobs that keep state over micro-batches are in ``epochs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packet as P
from ..session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:10]}"


#: Rows of a replayed file, at least.
FILE_ROWS = 1000


def replay_files(df: DataFrame, path: str, seq: str, parts: int, files: int | None = None) -> int:
    """Write ``df`` as ``parts`` successive appends ordered by ``seq``, each of
    the same number of files, which is returned: a stream that takes so many
    files per trigger gets one part per micro-batch. Parts too small for
    several files have one. ``files``: at most so many (by default as many as
    tasks run at a time, four at least), so that large parts keep all of them busy."""
    files = max(4, df.sparkSession.sparkContext.defaultParallelism) if files is None else files
    lo, hi = df.agg(F.min(seq), F.max(seq)).first()
    if lo is None:
        df.write.mode("append").parquet(path)
        return 1
    step = (int(hi) - int(lo)) // parts + 1
    part = F.floor((F.col(seq) - int(lo)) / step)
    least = df.groupBy(part).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    n = max(1, min(files, least // FILE_ROWS))
    for i in range(parts):
        rows = df.where(part == i)
        (rows.coalesce(1) if n == 1 else rows.repartition(n)).write.mode("append").parquet(path)
    return n


def replayed(df: DataFrame, seq: str, parts: int) -> DataFrame:
    """A stream over ``df`` with one micro-batch per part."""
    path = scratch(df.sparkSession, "replay")
    n = replay_files(df, path, seq, parts)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", n).parquet(path)


def run_available_now(sdf: DataFrame, out_path: str, mode: str = "append") -> None:
    """Process everything available, then stop. A stateful query has as many
    state partitions as the session has shuffle partitions when it first
    starts."""
    (sdf.writeStream.format("parquet").option("path", out_path)
     .option("checkpointLocation", out_path + "-ckpt").outputMode(mode)
     .trigger(availableNow=True).start().awaitTermination())


def stream_flow_windows(stream: DataFrame, width: str, delay: str, labels: DataFrame | None = None) -> DataFrame:
    """ST1/ST4: per event-time window and direction-free flow: packets,
    bytes, first seq; rows later than the watermark are dropped by Spark.
    Labels come from a stream-static join on the flow's endpoints (broadcast
    by Spark if the table is small)."""
    t = P.five_tuple(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("ip_proto"))
    k = P.canonical_tuple(t)
    d = (stream.where(F.col("accepted")).withColumn("ts", F.timestamp_micros("ts_us"))
         .withWatermark("ts", delay)
         .groupBy(F.window("ts", width).alias("w"), k.alias("flow"))
         .agg(F.count("*").alias("packets"), F.sum("frame_len").alias("bytes"), F.min("seq").alias("first_seq")))
    out = d.select(F.unix_micros(F.col("w.start")).alias("window_start_us"), F.col("flow.src").alias("src"),
                   F.col("flow.sport").alias("sport"), F.col("flow.dst").alias("dst"),
                   F.col("flow.dport").alias("dport"), F.col("flow.proto").alias("proto"),
                   F.col("packets").cast("long").alias("packets"), "bytes", "first_seq")
    if labels is not None:
        lab = labels.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("label").alias("_l"))
        out = (out.join(lab, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left")
               .withColumn("label", F.coalesce("_l", F.lit(0))).drop("_s", "_d", "_l"))
    return out


def stream_scores(stream: DataFrame, score_fn) -> DataFrame:
    """ST3: apply a stateless scoring function (e.g. ``detector.score``
    bound to a trained model) to a stream."""
    return score_fn(stream)
