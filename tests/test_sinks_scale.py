import os
import uuid

from pyspark.sql import functions as F

from streamsift.operators import decay as DC
from streamsift.sources import sinks as SK


def test_samples_roundtrip_and_report(spark, tmp_path):
    d = spark.createDataFrame([(1, [[0.0, 1.0]], 1, "train"), (2, [[0.5, 0.5]], 0, "test")],
                              "sample_id long, set_x array<array<double>>, set_y int, split string")
    path = str(tmp_path / "ds")
    SK.save_samples(d, path, 10.0, 1, "events")
    back = SK.load_samples(spark, path, "test").collect()
    assert len(back) == 1 and back[0]["set_y"] == 0 and back[0]["max_flow_len"] == 1
    tw, n, ident = SK.check_flow_stores(spark.read.parquet(path))
    assert (tw, n, ident) == (10.0, 1, "events")
    rep = spark.createDataFrame([("cnn", "x", 10, 0.5, 1.0, 1.0, None, 0.0, 1.0, None)],
                                "model string, source string, samples long, ddos_pct double, accuracy double, "
                                "f1 double, tpr double, fpr double, tnr double, fnr double")
    out = str(tmp_path / "rep")
    SK.write_report(rep, out)
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".csv"))
    assert text.splitlines()[0] == "Model,Time,Packets,Samples,DDOS%,Accuracy,F1Score,TPR,FPR,TNR,FNR,Source"
    assert "N/A" in text and "0.5000" in text
    hist = str(tmp_path / "hist")
    SK.append_run_history(spark, hist, samples=10)
    SK.append_run_history(spark, hist, samples=12)
    assert spark.read.parquet(hist).count() == 2


def test_cross_dataset_balance(spark):
    rows = [(i, "a", "train") for i in range(5)] + [(i, "b", "train") for i in range(3)] + [(i, "a", "test") for i in range(2)]
    d = spark.createDataFrame(rows, "sample_id long, dataset_id string, split string")
    got = SK.cross_dataset_balance(d).groupBy("split", "dataset_id").count().collect()
    assert sorted((r["split"], r["dataset_id"], r["count"]) for r in got) == [("test", "a", 2), ("train", "a", 3),
                                                                           ("train", "b", 3)]


def test_fx_hotkey_million_rows(spark):
    # 90 % of 1M rows from one host; chunked evaluation must equal the
    # single-chunk evaluation and every window partition includes the chunk id
    n = 1_000_000
    d = (spark.range(n).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("h"), (F.col("id") % 7).cast("string")))
                               .otherwise(F.lit("hot")).alias("k"),
                               F.col("id").alias("seq"), (F.col("id") / 3600.0).alias("t"),
                               (F.col("id") % 97).cast("double").alias("v")))
    a = DC.decayed_sums(d, ["k", "lam"], chunk_rows=50_000, lambdas=[1.0])
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "_ch" in plan
    b = DC.decayed_sums(d, ["k", "lam"], chunk_rows=1 << 30, lambdas=[1.0])
    j = a.select("seq", F.col("w").alias("wa"), F.col("cf1").alias("ca")).join(
        b.select("seq", F.col("w").alias("wb"), F.col("cf1").alias("cb")), "seq")
    worst = j.select(F.max(F.abs(F.col("wa") - F.col("wb")) / F.greatest(F.abs("wb"), F.lit(1.0))).alias("dw"),
                     F.max(F.abs(F.col("ca") - F.col("cb")) / F.greatest(F.abs("cb"), F.lit(1.0))).alias("dc"),
                     F.count("*").alias("n")).first()
    assert worst["n"] == n and worst["dw"] < 1e-9 and worst["dc"] < 1e-9
