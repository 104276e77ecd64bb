"""Bidirectional flows, fragments and labels.

A fragment is one flow inside one anchored window, holding its first
``max_flow_len`` accepted packets.  A flow's orientation is the 5-tuple of
its first accepted packet in the capture; flows never merge across
captures.  The first n packets are taken directly on the packets by a
group-limited ``row_number``, which Spark evaluates partially before the
shuffle, so a hot flow never sends more than ``n`` rows per map task. Those
rows are written once; orientation, flow cap, relative time and labels work
on them alone.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import packet as P
from .windows import anchored_windows

FEATURE_COLS = [f"f{i}" for i in range(11)]


def finish_features(d: DataFrame) -> DataFrame:
    """P2 and P3 (f2, f4) from the kept layer and protocol names, where the
    frames come from ``sources.tables.flow_features``."""
    if "hl" not in d.columns:
        return d
    return (d.withColumn("f2", P.layer_hash(F.col("hl")).cast("double"))
            .withColumn("f4", P.protocol_mask(F.col("fp")).cast("double")).drop("hl", "fp"))


def flow_orientation(accepted: DataFrame, capture: str = "capture_id") -> DataFrame:
    """(capture, flow_key) -> flow (5-tuple of the first packet), first_seq."""
    return (accepted.groupBy(capture, "flow_key")
            .agg(F.min_by("id_fwd", "seq").alias("flow"), F.min("seq").alias("first_seq")))


def max_flows_cut(orient: DataFrame, max_flows: int, capture: str = "capture_id") -> DataFrame:
    """per capture, the seq of the packet that created the k-th flow.

    ``row_number() <= k`` is planned as a group limit, so each map task
    forwards at most k rows per capture.
    """
    w = Window.partitionBy(capture).orderBy("first_seq")
    return (orient.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_flows)
            .groupBy(capture).agg(F.max("first_seq").alias("cut_seq"), F.count("*").alias("_n"))
            .where(F.col("_n") >= max_flows).select(capture, "cut_seq"))


def fragment_key(capture: str = "capture_id") -> list[str]:
    return [capture, "flow_key", "window_start_us"]


def first_packets(d: DataFrame, n: int, capture: str = "capture_id") -> DataFrame:
    """The first n packets of every fragment with their position. Spark
    plans a partial and a final group limit around the shuffle."""
    ordered = Window.partitionBy(*fragment_key(capture)).orderBy("seq")
    return d.withColumn("pos", F.row_number().over(ordered)).where(F.col("pos") <= n)


def build_fragments(frames: DataFrame, width_us: int, max_flow_len: int, labels: DataFrame | None = None,
                    traffic_type: str = "all", max_flows: int = 0, capture: str = "capture_id") -> DataFrame:
    """Frames (flow feature rows, see ``sources.tables.flow_features``) ->
    long-form fragment packets.

    Output: capture, flow struct, window_start_us, pos (1-based, capture
    order), seq, f0..f10 (f0 = seconds since the fragment's first packet),
    label.
    """
    from ..session import cut_lineage
    d = anchored_windows(frames, width_us, capture=capture)
    d = d.where(F.col("accepted")).withColumn("flow_key", P.canonical_tuple(F.col("id_fwd")))
    # a flow's first packet is the first of its window, so orientation and the
    # flow cap need no packets beyond the first n of each fragment
    d = cut_lineage(first_packets(d, max_flow_len, capture))
    orient = flow_orientation(d.where(F.col("pos") == 1), capture)
    if max_flows and max_flows > 0:
        # one row per capture; the join type follows its size
        cut = max_flows_cut(orient, max_flows, capture)
        keep = F.col("cut_seq").isNull()
        d = d.join(cut, capture, "left").where(keep | (F.col("seq") <= F.col("cut_seq"))).drop("cut_seq")
        orient = orient.join(cut, capture, "left").where(keep | (F.col("first_seq") <= F.col("cut_seq"))).drop("cut_seq")
    d = d.join(orient.select(capture, "flow_key", "flow"), [capture, "flow_key"])
    d = d.withColumn("f0", (F.col("ts_us") - F.min("ts_us").over(Window.partitionBy(*fragment_key(capture)))).cast("double") / F.lit(1e6))
    d = apply_labels(d, labels)
    d = filter_traffic(finish_features(d), traffic_type)
    return d.select(capture, "flow", "window_start_us", "pos", "seq", *FEATURE_COLS, "label")


def apply_labels(d: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Exact (src, dst) match of the flow orientation, default 0.

    ``labels`` may be any pair table; Spark broadcasts it only if its size
    allows. A pair listed twice counts once, with its largest label.
    """
    if labels is None:
        return d.withColumn("label", F.lit(0))
    lab = (labels.groupBy(F.col("src").alias("_ls"), F.col("dst").alias("_ld"))
           .agg(F.max("label").alias("_lab")))
    return (d.join(lab, (d["flow"]["src"] == F.col("_ls")) & (d["flow"]["dst"] == F.col("_ld")), "left")
            .withColumn("label", F.coalesce(F.col("_lab"), F.lit(0)).cast("int"))
            .drop("_ls", "_ld", "_lab"))


# Attackers and victims of the public capture datasets.
PRESETS = {
    "DOS2017": (["172.16.0.1"], ["192.168.10.50"]),
    "DOS2018": (["18.218.115.60", "18.219.9.1", "18.219.32.43", "18.218.55.126", "52.14.136.135", "18.219.5.43", "18.216.200.189",
                 "18.218.229.235", "18.218.11.51", "18.216.24.42"], ["18.218.83.150", "172.31.69.28"]),
    "SYN2020": (["11.0.0.0/24"], ["10.42.0.2"]),
    "DOS2019": (["172.16.0.5"], ["192.168.50.1", "192.168.50.4"]),
}


def preset_nets(spark: SparkSession, dataset: str, label: int = 1) -> DataFrame:
    """The label specs of a known dataset."""
    attackers, victims = PRESETS[dataset]
    return label_nets(spark, [(a, v) for a in attackers for v in victims], label)


def label_nets(spark: SparkSession, specs: list[tuple[str, str]], label: int = 1) -> DataFrame:
    """J2 for networks: (attacker, victim) IPs or CIDRs -> one row per spec with
    both sides as (prefix length, network number, first host, last host)."""
    rows = list(dict.fromkeys((*_net_row(att), *_net_row(vic), int(label)) for att, vic in specs))
    return spark.createDataFrame(rows, "a_len int, a_net long, a_lo long, a_hi long, "
                                       "v_len int, v_net long, v_lo long, v_hi long, label int")


def _net_row(spec: str) -> tuple[int, int, int, int]:
    net = ipaddress.IPv4Network(spec if "/" in spec else spec + "/32", strict=False)
    plen = net.prefixlen
    first, last = int(net.network_address), int(net.broadcast_address)
    if plen < 31:  # hosts() skips network and broadcast addresses
        first, last = first + 1, last - 1
    return plen, int(net.network_address) >> (32 - plen), first, last


def labels_for_pairs(pairs: DataFrame, nets: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label (src, dst) pairs against CIDR specs, both directions: the largest
    label of the specs that hold, default 0. All columns of ``pairs`` stay, also
    of pairs that repeat.

    The number of joins does not depend on the specs: every distinct address
    is looked up once under its 33 prefixes, which gives the networks of the
    specs that hold it (at most 33), and the networks of a pair's two ends meet
    the specs in one equi-join.
    """
    from ..session import cut_lineage
    side = ["len", "net", "lo", "hi"]
    ends = F.explode(F.array(*[F.struct(*[F.col(f"{x}_{c}").alias(c) for c in side]) for x in "av"])).alias("n")
    known = nets.select(ends).select("n.*").distinct()
    d = cut_lineage(pairs.withColumn("_s", P.ipv4_to_long(F.col(src))).withColumn("_t", P.ipv4_to_long(F.col(dst))))
    both = d.select("_s", "_t").distinct()
    address = both.select(F.explode(F.array("_s", "_t")).alias("ip")).distinct().where("ip is not null")
    prefix = address.select("ip", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("len")).withColumn("net", F.expr("shiftright(ip, 32 - len)"))
    held = (prefix.join(known, ["len", "net"]).where("ip between lo and hi")
            .groupBy("ip").agg(F.collect_set(F.struct("len", "net")).alias("nets")))   # at most 33
    spec = nets.groupBy("a_len", "a_net", "v_len", "v_net").agg(F.max("label").alias("_l"))
    pair = (both.join(held.select(F.col("ip").alias("_s"), F.col("nets").alias("of_s")), "_s")
            .join(held.select(F.col("ip").alias("_t"), F.col("nets").alias("of_t")), "_t")
            .select("_s", "_t", "of_t", F.explode("of_s").alias("x")).select("_s", "_t", "x", F.explode("of_t").alias("y")))
    ways = F.explode(F.array(*[F.struct(a["len"].alias("a_len"), a["net"].alias("a_net"), b["len"].alias("v_len"), b["net"].alias("v_net"))
                               for a, b in ((F.col("x"), F.col("y")), (F.col("y"), F.col("x")))]))
    label = (pair.select("_s", "_t", ways.alias("w")).select("_s", "_t", "w.*").join(spec, ["a_len", "a_net", "v_len", "v_net"])
             .groupBy("_s", "_t").agg(F.max("_l").alias("_l")))
    return (d.join(label, ["_s", "_t"], "left").select(*pairs.columns, F.coalesce("_l", F.lit(0)).cast("int").alias("label")))


def filter_traffic(d: DataFrame, traffic_type: str) -> DataFrame:
    """'ddos' keeps label != 0, 'benign' keeps label == 0, else all."""
    if traffic_type == "ddos":
        return d.where(F.col("label") != 0)
    if traffic_type == "benign":
        return d.where(F.col("label") == 0)
    return d


def flow_table(fragments: DataFrame, capture: str = "capture_id") -> DataFrame:
    """One row per flow: fragments count and label (input of balance/split)."""
    return (fragments.groupBy(capture, "flow", "window_start_us").agg(F.max("label").alias("label"))
            .groupBy(capture, "flow").agg(F.count("*").alias("fragments"), F.max("label").alias("label")))


def count_flows(fragments: DataFrame, capture: str = "capture_id") -> DataFrame:
    """A1: flows and fragments, total / ddos / benign (a rollup over class)."""
    flows = flow_table(fragments, capture).withColumn(
        "traffic_class", F.when(F.col("label") > 0, F.lit("ddos")).otherwise(F.lit("benign")))
    return (flows.rollup("traffic_class")
            .agg(F.count("*").cast("long").alias("flows"), F.sum("fragments").cast("long").alias("fragments"))
            .select(F.coalesce("traffic_class", F.lit("total")).alias("traffic_class"), "flows", "fragments"))
