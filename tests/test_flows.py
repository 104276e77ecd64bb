import ipaddress
import random
from pyspark.sql import functions as F

from streamsift.functions import packet as P
from streamsift.operators import flows as FL
from seq_oracles import fragments as seq_fragments

SCHEMA = "capture_id string, seq long, ts_us long, accepted boolean, src string, sport int, dst string, dport int, proto int"


def _frames(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA)
    d = d.withColumn("id_fwd", P.five_tuple(F.col("src"), F.col("sport"), F.col("dst"), F.col("dport"), F.col("proto")))
    for i in range(1, 11):
        d = d.withColumn(f"f{i}", F.lit(float(i)))
    return d.drop("src", "sport", "dst", "dport", "proto")


def _run(spark, rows, width, n, **kw):
    out = FL.build_fragments(_frames(spark, rows), width, n, **kw)
    return sorted((r["capture_id"], tuple(r["flow"]), r["window_start_us"], r["pos"], r["seq"]) for r in out.collect())


def test_fx_bidir_orientation_kept_across_windows(spark):
    rows = [("c", 0, 0, True, "A", 1, "B", 2, 6), ("c", 1, 1, True, "B", 2, "A", 1, 6),
            ("c", 2, 20_000_000, True, "B", 2, "A", 1, 6)]
    got = _run(spark, rows, 10_000_000, 10)
    assert {g[1] for g in got} == {("A", 1, "B", 2, 6)}
    assert [g[2] for g in got] == [0, 0, 20_000_000]


def test_fx_two_captures_never_merge(spark):
    rows = [("c1", 0, 0, True, "A", 1, "B", 2, 6), ("c2", 0, 0, True, "A", 1, "B", 2, 6)]
    got = _run(spark, rows, 10_000_000, 10)
    assert len({(g[0], g[1]) for g in got}) == 2


def test_fx_truncate_first_n(spark):
    rows = [("c", i, i, True, "A", 1, "B", 2, 6) for i in range(4)] + [("c", 4, 20_000_000, True, "A", 1, "B", 2, 6)]
    got = _run(spark, rows, 10_000_000, 2)
    assert [(g[2], g[4]) for g in got] == [(0, 0), (0, 1), (20_000_000, 4)]


def test_fx_max_flows(spark):
    rows = [("c", 0, 0, True, "A", 1, "B", 2, 6), ("c", 1, 1, True, "A", 1, "B", 2, 6),
            ("c", 2, 2, True, "C", 1, "B", 2, 6), ("c", 3, 3, True, "A", 1, "B", 2, 6),
            ("c", 4, 4, True, "D", 1, "B", 2, 6)]
    got = _run(spark, rows, 10_000_000, 10, max_flows=2)
    assert [g[4] for g in got] == [0, 1, 2]


def test_random_against_sequential(spark):
    rnd = random.Random(11)
    hosts = ["10.0.0.%d" % i for i in range(4)]
    rows, pk, t = [], [], 0
    for i in range(300):
        t += rnd.choice([1, 10, 100, 3000]) * 1000
        s, d = rnd.sample(hosts, 2)
        sp, dp = rnd.choice([1, 2]), rnd.choice([1, 2])
        ok = rnd.random() > 0.1
        rows.append(("c", i, t, ok, s, sp, d, dp, 6))
        pk.append((t, ok, (s, sp, d, dp, 6)))
    exp = seq_fragments(pk, 5_000_000, 3)
    got = FL.build_fragments(_frames(spark, rows), 5_000_000, 3).collect()
    gm = {}
    for r in got:
        gm.setdefault((tuple(r["flow"]), r["window_start_us"]), []).append(r["seq"])
    assert {k: sorted(v) for k, v in gm.items()} == {(k, s): v for (k, s), v in exp.items()}


def test_fx_labels_cidr(spark):
    nets = FL.label_nets(spark, [("11.0.0.0/24", "10.42.0.2")])
    pairs = spark.createDataFrame([("11.0.0.1", "10.42.0.2"), ("10.42.0.2", "11.0.0.254"), ("11.0.0.1", "10.42.0.3"),
                                   ("11.0.0.0", "10.42.0.2"), ("11.0.0.255", "10.42.0.2")], "src string, dst string")
    got = {(r["src"], r["dst"]): r["label"] for r in FL.labels_for_pairs(pairs, nets).collect()}
    assert [got[(r["src"], r["dst"])] for r in pairs.collect()] == [1, 1, 0, 0, 0]


def test_nested_specs(spark):
    """10,000 specs, most of them nested, against a plain search; the largest
    label counts, and both directions."""
    rnd = random.Random(4)
    text = lambda x: f"{x >> 24}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"
    net = lambda: f"{text((10 << 24) + rnd.randrange(1 << 12))}/{rnd.randint(18, 32)}"
    few, many = [(net(), net()) for _ in range(12)], [(f"{text((11 << 24) + rnd.randrange(1 << 10))}/{rnd.randint(22, 32)}", net()) for _ in range(10_000)]
    nets = FL.label_nets(spark, few, 3).unionByName(FL.label_nets(spark, few[:4], 7)).unionByName(FL.label_nets(spark, many, 1))
    pairs = [(text((rnd.choice([10, 11]) << 24) + rnd.randrange(1 << 12)), text((10 << 24) + rnd.randrange(1 << 12))) for _ in range(300)]
    pairs += [(b, a) for a, b in pairs[:100]] + pairs[:5] + [("10.0.0.1", None)]
    specs = [(FL._net_row(a), FL._net_row(v), lab) for group, lab in ((few, 3), (few[:4], 7), (many, 1)) for a, v in group]

    def plain(s, d):
        if d is None:
            return 0
        s, d = (int(ipaddress.IPv4Address(x)) for x in (s, d))
        return max((lab for a, v, lab in specs if (a[2] <= s <= a[3] and v[2] <= d <= v[3]) or (a[2] <= d <= a[3] and v[2] <= s <= v[3])), default=0)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, src string, dst string")
    got = {r["i"]: r["label"] for r in FL.labels_for_pairs(df, nets).collect()}
    want = {i: plain(*p) for i, p in enumerate(pairs)}
    assert got == want and {0, 1, 3} <= set(want.values())


def test_presets(spark):
    pairs = spark.createDataFrame([("11.0.0.9", "10.42.0.2"), ("192.168.50.4", "172.16.0.5"), ("172.16.0.1", "192.168.10.50")], "src string, dst string")
    for name, want in (("SYN2020", [1, 0, 0]), ("DOS2019", [0, 1, 0]), ("DOS2017", [0, 0, 1]), ("DOS2018", [0, 0, 0])):
        got = {r["src"]: r["label"] for r in FL.labels_for_pairs(pairs, FL.preset_nets(spark, name)).collect()}
        assert [got[s] for s in ("11.0.0.9", "192.168.50.4", "172.16.0.1")] == want


def test_count_flows_rollup(spark):
    frag = spark.createDataFrame([("c", ("A", 1, "B", 2, 6), 0, 1), ("c", ("A", 1, "B", 2, 6), 10, 1),
                                  ("c", ("C", 1, "B", 2, 6), 0, 0)],
                                 "capture_id string, flow struct<src:string,sport:int,dst:string,dport:int,proto:int>, "
                                 "window_start_us long, label int")
    got = {r["traffic_class"]: (r["flows"], r["fragments"]) for r in FL.count_flows(frag).collect()}
    assert got == {"total": (2, 3), "ddos": (1, 2), "benign": (1, 1)}


def test_packet_limit_below_the_shuffle(spark):
    d = spark.range(10).selectExpr("'c' capture_id", "id % 2 flow_key", "0L window_start_us", "id seq")
    plan = FL.first_packets(d, 3)._jdf.queryExecution().executedPlan().toString()
    partial, final = plan.index("Partial"), plan.index("Final")
    exchange = plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan and final < exchange < partial   # printed from the top down


def test_hot_flow(spark):
    """One flow with nine tenths of 300,000 packets; the limit cuts it in every window."""
    d = spark.range(300_000).selectExpr(
        "'c' capture_id", "id seq", "id * 1000 ts_us", "true accepted",
        "if(id % 10 < 9, named_struct('src', '10.0.0.1', 'sport', 1, 'dst', '10.0.0.2', 'dport', 2, 'proto', 6), "
        "named_struct('src', '10.0.0.3', 'sport', int(id % 1000), 'dst', '10.0.0.4', 'dport', 2, 'proto', 6)) id_fwd",
        *[f"0.0D f{i}" for i in range(1, 11)])
    got = FL.build_fragments(d, 10_000_000, 4)
    hot = got.where("flow.src = '10.0.0.1'").groupBy("window_start_us").count().collect()
    assert len(hot) == 30 and all(r["count"] == 4 for r in hot)
    assert got.agg(F.max("pos")).first()[0] == 4
