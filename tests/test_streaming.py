import numpy as np
import pytest
from pyspark.sql import functions as F

from streamsift.functions import packet as P
from streamsift.operators import cnn as CN
from streamsift.operators import decay as DC
from streamsift.operators import detector as DT
from streamsift.operators import flows as FL
from streamsift.sources import tables as TB
from streamsift.streaming import epochs as EP
from streamsift.streaming import online as ON

SMALL = "/root/testdata/sf0.001"
HOUR_US = 3_600_000_000


def in_parts(spark, rows, step, states, parts):
    """The micro-batches of a job without a stream."""
    job = EP.Epochs(spark, ON.scratch(spark, "t-epochs"))
    lo, hi = rows.agg(F.min("seq"), F.max("seq")).first()
    size = (hi - lo) // parts + 1
    for e in range(parts):
        job.run(step, states)(rows.where((F.col("seq") >= lo + e * size) & (F.col("seq") < lo + (e + 1) * size)), e)
    return job


def close(a, b, cols):
    assert len(a) == len(b)
    for r in b:
        x = a[(r["seq"], r["lam"])]
        assert all(abs(x[c] - r[c]) <= 1e-9 * max(1.0, abs(r[c])) for c in cols), (x, r)


@pytest.mark.parametrize("jitter", [False, True])
def test_stream_decay_equals_batch(spark, jitter):
    """A real stream, out of order in time, against the batch operator."""
    rows = TB.keyed_values_from_orders(spark, SMALL).select(F.col("key").alias("k"), "seq", "t", "v")
    job = EP.Epochs(spark, ON.scratch(spark, "t-decay"))
    EP.run_epochs(ON.replayed(rows, "seq", 3), job, EP.decay_step([1.0, 0.01], jitter=jitter), ["streams"])
    assert job.next("streams") == 3
    got = {(r["seq"], r["lam"]): r for r in job.output("stats").collect()}
    close(got, DC.decayed_stats_1d(rows, ["k"], lambdas=[1.0, 0.01], jitter=jitter).collect(), ["w", "mean"])


def test_stream_pairs_equal_batch(spark):
    rows = (TB.packets_from_events(spark, SMALL).where("accepted")
            .select(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), "seq", "t", F.col("frame_len").alias("v")))
    want = DC.pair_stats_2d(rows, "src", "dst", [1.0, 0.1]).collect()
    job = in_parts(spark, rows, EP.pair_step([1.0, 0.1]), EP.PAIR_STATES, 4)
    got = {(r["seq"], r["lam"]): r for r in job.output("stats").collect()}
    assert len(got) == len(want)
    for r in want:
        x = got[(r["seq"], r["lam"])]
        assert abs(x["radius"] - r["radius"]) <= 1e-6 * max(1, r["radius"]) and abs(x["cov"] - r["cov"]) <= 1e-6 * max(1, abs(r["cov"]))


def late_frames(spark):
    """Frames with late times and repeated instants."""
    f = TB.flow_features(TB.packets_from_events(spark, SMALL))
    back = F.when(F.col("seq") % 7 == 0, F.lit(5 * HOUR_US)).otherwise(F.lit(0))
    return f.withColumn("ts_us", F.col("ts_us") - back - F.col("ts_us") % 1000)


def fragment_rows(df):
    return sorted(tuple(r) for r in df.select("window_start_us", "flow.src", "flow.sport", "flow.dst", "flow.dport", "seq", "pos", *FL.FEATURE_COLS, "label").collect())


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_stream_fragments_equal_batch(spark, parts):
    frames, labels = late_frames(spark), TB.label_pairs(spark)
    width = 30 * HOUR_US
    job = in_parts(spark, frames, EP.fragment_step(width, 3, labels), EP.FRAGMENT_STATES, parts)
    got = job.output("fragments").drop("epoch").unionByName(EP.open_fragments(job, 3, labels))
    assert fragment_rows(got) == fragment_rows(FL.build_fragments(frames, width, 3, labels=labels))
    # the buffer holds the open window only
    assert job.state(EP.FRAGMENT_STATES, parts)["open"].select("window_start_us").distinct().count() <= 1


def test_repeated_epoch_adds_nothing(spark):
    """A step that runs again, as after a failure, replaces its own results."""
    frames = late_frames(spark)
    lo, hi = frames.agg(F.min("seq"), F.max("seq")).first()
    mid = (lo + hi) // 2
    mins, maxs = P.feature_bounds_a(3600.0)
    job = EP.Epochs(spark, ON.scratch(spark, "t-again"))
    run = job.run(EP.classify_step(30 * HOUR_US, 10, mins, maxs, CN.init_cnn(11, kernels=2), TB.label_pairs(spark)), EP.FRAGMENT_STATES)
    run(frames.where(F.col("seq") <= mid), 0)
    run(frames.where(F.col("seq") > mid), 1)
    once = sorted(map(str, job.output("reports").collect())), fragment_rows(job.output("fragments"))
    samples = [r["samples"] for r in job.output("reports").orderBy("epoch").collect()]
    predicted = [r["count"] for r in job.output("predictions").groupBy("epoch").count().orderBy("epoch").collect()]
    assert len(samples) == 2 and samples == predicted
    run(frames.where(F.col("seq") > mid), 1)
    assert (sorted(map(str, job.output("reports").collect())), fragment_rows(job.output("fragments"))) == once
    assert job.next("anchors") == 2


def test_expired_streams_leave_the_state(spark):
    """10,000 streams of two rows each: the state holds those that the clock
    has not passed, and the results do not depend on the micro-batches."""
    rows = spark.range(20_000).select((F.col("id") / 2).cast("long").alias("k"), F.col("id").alias("seq"), (F.col("id") / 10.0).alias("t"), (F.col("id") % 13).cast("double").alias("v"))
    got = []
    for parts in (1, 4):
        job = in_parts(spark, rows, EP.expiry_step([0.1], ttl=20.0, delay=5.0), EP.EXPIRY_STATES, parts)
        states = [job.state(EP.EXPIRY_STATES, e + 1)["streams"].count() for e in range(parts)]
        assert max(states) <= 10 * 25 / 2 + 2
        got.append({(r["seq"], r["lam"]): r for r in job.output("stats").collect()})
    close(got[0], got[1].values(), ["w", "mean", "var"])
    assert job.output("late").count() == 0 and len(got[0]) == 20_000


def test_expiry_and_late_rows(spark):
    rows = [("a", 0, 0.0, 1.0), ("a", 1, 1.0, 2.0), ("b", 2, 50.0, 3.0), ("a", 3, 2.0, 9.0), ("a", 4, 49.0, 4.0), ("b", 5, 50.5, 5.0), ("a", 6, 48.0, 6.0), ("c", 7, 10.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, seq long, t double, v double")
    for parts in (1, 3, 8):
        job = in_parts(spark, df, EP.expiry_step([1.0], ttl=10.0, delay=5.0), EP.EXPIRY_STATES, parts)
        assert sorted((r["k"], r["seq"]) for r in job.output("late").collect()) == [("a", 3), ("c", 7)]
        w = {r["seq"]: (r["w"], r["mean"]) for r in job.output("stats").collect()}
        assert w[4] == (1.0, 4.0) and w[6] == (2.0, 5.0)          # anew after 48, then a late but not too late row
        assert abs(w[1][0] - 1.5) < 1e-12 and abs(w[5][0] - (1 + 2 ** -0.5)) < 1e-12


def test_replay_has_one_part_per_trigger(spark, monkeypatch):
    monkeypatch.setattr(ON, "FILE_ROWS", 50)
    rows = spark.range(1000).withColumnRenamed("id", "seq")
    seen = []
    stream = ON.replayed(rows, "seq", 4)
    (stream.writeStream.foreachBatch(lambda df, e: seen.append(tuple(df.agg(F.min("seq"), F.max("seq"), F.count("seq")).first())))
     .option("checkpointLocation", ON.scratch(spark, "t-ck")).trigger(availableNow=True).start().awaitTermination())
    assert seen == [(k * 250, k * 250 + 249, 250) for k in range(4)]


def test_stream_scoring(spark):
    # ST3: a stateless detector applied to a stream equals the batch scoring
    rng = np.random.RandomState(0)
    vec = spark.createDataFrame([(i, rng.rand(4).tolist()) for i in range(60)], "seq long, x array<double>")
    fmap = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 3)], "ae int, pos int, feature int")
    model = DT.train_detector(spark, vec, fmap, steps=2)
    src = ON.scratch(spark, "t-vec")
    vec.write.parquet(src)
    stream = spark.readStream.schema(vec.schema).parquet(src)
    out = ON.scratch(spark, "t-score")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    ON.run_available_now(ON.stream_scores(stream, lambda s: DT.score(s, model)), out)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    a = {r["seq"]: r["rmse"] for r in spark.read.parquet(out).collect()}
    b = {r["seq"]: r["rmse"] for r in DT.score(vec, model).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_large_parts_are_replayed_in_many_files(spark, tmp_path):
    from streamsift.streaming import online as ON
    n = ON.replay_files(spark.range(40_000).withColumnRenamed("id", "seq"), str(tmp_path / "r"), "seq", 2, 12)
    assert n == 12 and ON.replay_files(spark.range(40).withColumnRenamed("id", "seq"), str(tmp_path / "s"), "seq", 2) == 1


def test_a_step_writes_its_frames_once(spark, monkeypatch):
    """The frames of a micro-batch are written with their running maximum, not again with their windows."""
    written, cut = [], EP.cut_lineage
    monkeypatch.setattr(EP, "cut_lineage", lambda d: written.append(d.columns) or cut(d))
    rows = [("c", i, i * 10, True, ("a", 1, "b", 2, 6), *[float(i)] * 10) for i in range(20)]
    names = [f"f{i}" for i in range(1, 11)]
    frames = spark.createDataFrame(rows, "capture_id string, seq long, ts_us long, accepted boolean, id_fwd struct<src:string,sport:int,dst:string,dport:int,proto:int>, "
                                   + ", ".join(f"{c} double" for c in names))
    out, state = EP.fragment_step(50, 3)(frames, {})
    assert not [c for c in written if "f1" in c and "pos" not in c]
    assert out["fragments"].count() == 9 and state["open"].count() == 2
