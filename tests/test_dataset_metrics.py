import math

from pyspark.sql import functions as F

from streamsift.operators import dataset as DS
from streamsift.operators import metrics as MT

FLOW = "struct<src:string,sport:int,dst:string,dport:int,proto:int>"


def test_fx_scale_and_nan(spark):
    d = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0), (20.0, 5.0)], "f0 double, f1 double")
    out = DS.normalize(d, [0.0, 5.0], [10.0, 5.0], cols=["f0", "f1"]).collect()
    assert [r["f0"] for r in out] == [0.0, 1.0, 2.0]
    assert [r["f1"] for r in out] == [0.0, 0.0, 0.0]  # zero-width bound: NaN -> 0


def test_fx_pad_and_packet_count(spark):
    d = spark.createDataFrame([("c", ("A", 1, "B", 2, 6), 0, 1, 0.0, 0.0, 1), ("c", ("A", 1, "B", 2, 6), 0, 2, 0.5, 1.0, 1)],
                              f"capture_id string, flow {FLOW}, window_start_us long, pos int, f0 double, f1 double, label int")
    p = DS.pad_long(d, 4, cols=["f0", "f1"])
    assert p.count() == 4
    counted = p.select(F.sum(DS.count_packets(None, ["f0", "f1"]))).first()[0]
    assert counted == 1  # the all-zero packet row and the padding are not packets
    s = DS.to_samples(d, 4, cols=["f0", "f1"]).first()
    assert s["set_x"] == [[0.0, 0.0], [0.5, 1.0], [0.0, 0.0], [0.0, 0.0]]


def test_fx_flowvec_iat(spark):
    rows = [("c", ("A", 1, "B", 2, 6), 0, 1, 0.0), ("c", ("A", 1, "B", 2, 6), 10, 1, 0.0),
            ("c", ("A", 1, "B", 2, 6), 10, 2, 2.0), ("c", ("A", 1, "B", 2, 6), 10, 3, 6.0)]
    d = spark.createDataFrame(rows, f"capture_id string, flow {FLOW}, window_start_us long, pos int, f0 double")
    for c in ["f1", "f3", "f4", "f5", "f7", "f8", "f9", "f10"]:
        d = d.withColumn(c, F.lit(0.0))
    v = {r["window_start_us"]: r for r in DS.flow_vectors(d.withColumn("label", F.lit(0))).collect()}
    assert v[0]["v0"] == 0.0 and v[10]["v0"] == 2.0 and v[10]["v20"] == 3.0


def _flows(spark, sizes_labels):
    rows = [("c", (f"h{i}", 1, "x", 2, 6), n, lab) for i, (n, lab) in enumerate(sizes_labels)]
    return spark.createDataFrame(rows, f"capture_id string, flow {FLOW}, fragments long, label int")


def test_fx_balance(spark):
    # benign 12 fragments, ddos 5: limit 5 per class, whole flows only
    f = _flows(spark, [(4, 0), (3, 0), (2, 0), (2, 0), (1, 0), (2, 1), (2, 1), (1, 1)])
    b = DS.balance_flows(f).collect()
    per = {}
    for r in b:
        per[r["label"]] = per.get(r["label"], 0) + r["fragments"]
    assert per[1] == 5
    assert 5 <= per[0] < 5 + 4
    one = _flows(spark, [(4, 0), (3, 0)])
    assert DS.balance_flows(one).count() == 2


def test_fx_split_flow_level(spark):
    f = _flows(spark, [((i % 4) + 1, i % 2) for i in range(20)])
    s = DS.split_flows(f).collect()
    assert len(s) == 20 and len({tuple(r["flow"]) for r in s}) == 20
    tot = sum(r["fragments"] for r in s)
    test = sum(r["fragments"] for r in s if r["split"] == "test")
    assert test >= tot * 0.1 - 1e-9


def test_fx_metrics(spark):
    d = spark.createDataFrame([("m", "s", 0, 0), ("m", "s", 0, 0), ("m", "t", 1, 1), ("m", "t", 0, 1)],
                              "model string, source string, label int, pred int")
    r = {x["source"]: x for x in MT.confusion_report(d, ["model", "source"]).collect()}
    assert r["s"]["tpr"] is None and r["s"]["f1"] == 0.0 and r["s"]["accuracy"] == 1.0
    assert r["t"]["tp"] == 1 and r["t"]["fp"] == 1 and math.isclose(r["t"]["f1"], 2 / 3)


def test_fx_robust_and_proximity(spark):
    b = spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, 3.0), (2, 2.0, 0.5), (3, 3.0, 4.0)], "seq long, t double, rmse double")
    a = spark.createDataFrame([(0, 0.0, 0.5), (1, 1.5, 1.0), (2, 2.5, 0.5), (3, 4.0, 2.5), (4, 4.5, 0.1)],
                              "seq long, t double, rmse double")
    r = MT.robustness(b, a, 2.0).first()
    assert math.isclose(r["duration_rate"], (4.5 - 3.0) / 3.0) and math.isclose(r["size_rate"], 0.25)
    assert r["det_before"] == 2 and r["det_after"] == 1 and math.isclose(r["detection_reduction"], 0.5)
    q = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "id long, x array<double>")
    ref = spark.createDataFrame([([0.0, 0.0],), ([6.0, 8.0],)], "x array<double>")
    d = {x["id"]: x for x in MT.reference_distances(q, ref, "id", "x").collect()}
    assert d[0]["min_dist"] == 0.0 and d[0]["max_dist"] == 10.0 and d[1]["min_dist"] == 5.0
    # chunked path gives the same answer
    d2 = {x["id"]: x for x in MT.reference_distances(q, ref, "id", "x", block_rows=1).collect()}
    assert d2 == d
