"""Registered queries: Spark plans over the driver tables and their oracles.

Each entry is ``name -> (spark_fn(spark, sf_dir) -> DataFrame, sql or None)``.
Column names and types are aligned between the two sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..functions import packet as P
from ..operators import cnn as CN
from ..operators import dataset as DS
from ..operators import detector as DT
from ..operators import decay as DC
from ..operators import flows as FL
from ..operators import hoststats as HS
from ..operators import metrics as MT
from ..operators import reduce as RD
from ..operators import training as TR
from ..operators.windows import anchored_windows
from ..sources import tables as TB
from . import oracle as O

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
MAX_FLOW_LEN = 10
ORDERS_DIGITS = (4, 2, -2)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TB.flow_features(TB.packets_from_events(spark, sf_dir))


def fragments(spark: SparkSession, sf_dir: str, width_us: int = DAY_US, n: int = MAX_FLOW_LEN) -> DataFrame:
    return FL.build_fragments(_frames(spark, sf_dir), width_us, n, labels=TB.label_pairs(spark))


def q_flow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.count_flows(fragments(spark, sf_dir))


FLOW_CAP = 150


def q_flow_counts_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stop each capture right after the packet that creates its k-th flow."""
    f = FL.build_fragments(_frames(spark, sf_dir), DAY_US, MAX_FLOW_LEN, labels=TB.label_pairs(spark),
                           max_flows=FLOW_CAP)
    return FL.count_flows(f)


CIDR_SPECS = [("10.0.0.0/30", "10.0.0.4/31"), ("10.0.0.8", "10.0.0.12/30")]


def q_cidr_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 with networks: distinct directed host pairs labelled by CIDR specs."""
    pairs = (TB.packets_from_events(spark, sf_dir).where(F.col("accepted"))
             .select(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst")).distinct())
    return FL.labels_for_pairs(pairs, FL.label_nets(spark, CIDR_SPECS)).select("src", "dst", "label")


def _cidr_ranges():
    out = []
    for a, v in CIDR_SPECS:
        _, _, alo, ahi = FL._net_row(a)
        _, _, vlo, vhi = FL._net_row(v)
        out.append((alo, ahi, vlo, vhi))
    return out


def q_anchored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = anchored_windows(TB.packets_from_events(spark, sf_dir), HOUR_US)
    return (w.groupBy("capture_id", "window_start_us")
            .agg(F.count("*").cast("long").alias("frames"),
                 F.sum(F.when(F.col("accepted"), 1).otherwise(0)).cast("long").alias("accepted_frames"),
                 F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")))


def q_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fragment_rows(fragments(spark, sf_dir, HOUR_US))


def _fragment_rows(f: DataFrame) -> DataFrame:
    return f.select("capture_id", F.col("flow.src").alias("src"), F.col("flow.sport").alias("sport"),
                    F.col("flow.dst").alias("dst"), F.col("flow.dport").alias("dport"),
                    F.col("flow.proto").alias("proto"), "window_start_us", F.col("pos").cast("int").alias("pos"),
                    "seq", *[rnd(f"f{i}", 6).alias(f"f{i}") for i in range(11)], "label")


def _ip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TB.packets_from_events(spark, sf_dir).where(F.col("accepted"))


def _round_1d(d: DataFrame, digits=(4, 3, 1)) -> DataFrame:
    return d.select("seq", "lam", rnd("w", digits[0]).alias("w"), rnd("mean", digits[1]).alias("mean"),
                    rnd("var", digits[2]).alias("var"))


def q_decay_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ip_rows(spark, sf_dir).select(F.col("src_ip").alias("k"), "seq", "t", F.col("frame_len").alias("v"))
    return _round_1d(DC.decayed_stats_1d(rows, ["k"]))


def q_decay_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    # prices are ~1e5, variances ~1e10: compare on a grid matching that scale
    return _round_1d(DC.decayed_stats_1d(TB.keyed_values_from_orders(spark, sf_dir), ["key"]), ORDERS_DIGITS)


def q_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ip_rows(spark, sf_dir).select(F.concat_ws("|", "src_ip", "dst_ip").alias("k"), "seq", "t",
                                          F.lit(0.0).alias("v"))
    return _round_1d(DC.decayed_stats_1d(rows, ["k"], jitter=True))


def q_decay_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ip_rows(spark, sf_dir).select("src_ip", "dst_ip", "seq", "t", F.col("frame_len").alias("v"))
    d = DC.pair_stats_2d(rows, "src_ip", "dst_ip")
    return d.select("seq", "lam", rnd("radius", 3).alias("radius"), rnd("magnitude", 3).alias("magnitude"),
                    rnd("cov", 1).alias("cov"), rnd("pcc", 3).alias("pcc"))


TIME_WINDOW_S = HOUR_US / 1e6
MINS_A, MAXS_A = P.feature_bounds_a(TIME_WINDOW_S)


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fragments(spark, sf_dir, HOUR_US)
    return DS.pad_long(DS.normalize(f, MINS_A, MAXS_A), MAX_FLOW_LEN)


def _flat_flow(d: DataFrame) -> list:
    return ["capture_id", F.col("flow.src").alias("src"), F.col("flow.sport").alias("sport"),
            F.col("flow.dst").alias("dst"), F.col("flow.dport").alias("dport"), F.col("flow.proto").alias("proto")]


def q_normalized_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _normalized(spark, sf_dir)
    return d.select(*_flat_flow(d), "window_start_us", "pos", "label", *[rnd(f"f{i}", 6).alias(f"f{i}") for i in range(11)])


def q_packet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _normalized(spark, sf_dir).withColumn("p", DS.count_packets(None)).withColumn(
        "traffic_class", F.when(F.col("label") > 0, F.lit("ddos")).otherwise(F.lit("benign")))
    return (d.rollup("traffic_class").agg(F.sum("p").cast("long").alias("packets"), F.count("*").cast("long").alias("rows"))
            .select(F.coalesce("traffic_class", F.lit("total")).alias("traffic_class"), "packets", "rows"))


def q_feature_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = DS.find_min_max(fragments(spark, sf_dir, HOUR_US), TIME_WINDOW_S)
    return b.select("feature", rnd("min", 4).alias("min"), rnd("max", 4).alias("max"))


def q_flow_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = DS.flow_vectors(fragments(spark, sf_dir, HOUR_US))
    return v.select(*_flat_flow(v), "window_start_us", *[rnd(f"v{i}", 4).alias(f"v{i}") for i in range(21)], "label")


def _balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import cut_lineage
    flows = cut_lineage(FL.flow_table(fragments(spark, sf_dir, HOUR_US)))
    return DS.balance_flows(flows, seed=1)


def q_balanced_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _balanced(spark, sf_dir)
    return b.select(*_flat_flow(b), F.col("fragments").cast("long").alias("fragments"), "label")


def q_dataset_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import cut_lineage
    s = DS.split_flows(cut_lineage(_balanced(spark, sf_dir)), 0.9, seeds=(2, 3))
    return s.select(*_flat_flow(s), F.col("fragments").cast("long").alias("fragments"), "label", "split")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TB.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


def q_detection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    z = F.lit(0.0)
    for i in range(8):
        z = e["x"][i] if i == 0 else z + e["x"][i]
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-4.0) * z))
    preds = e.select(F.lit("probe").alias("model"),
                     F.concat(F.lit("part-"), (F.col("vec_id") % 3).cast("string")).alias("source"),
                     F.when(F.col("label") >= 5, 1).otherwise(0).alias("label"),
                     MT.alert(p, 0.5).alias("pred"))
    r = MT.confusion_report(preds, ["model", "source"])
    return r.select("model", "source", "tn", "fp", "fn", "tp", "samples",
                    *[rnd(c, 6).alias(c) for c in ("ddos_pct", "accuracy", "f1", "tpr", "fpr", "tnr", "fnr")])


ROBUST_THRESHOLD = 1.5


def _versions(spark: SparkSession, sf_dir: str):
    b = _ip_rows(spark, sf_dir).select("seq", "t", "src_ip", F.col("frame_len").alias("v"))
    crafted = (b.where(F.col("src_ip").isin(TB.ATTACKERS))
               .select((F.col("seq") + F.lit(1_000_000_000)).alias("seq"), (F.col("t") + F.lit(1.0 / 3600.0)).alias("t"),
                       "src_ip", F.lit(60.0).alias("v")))
    a = b.unionByName(crafted)

    def score(d):
        st = d.groupBy("src_ip").agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
        return (d.join(st, "src_ip").withColumn("rmse", F.abs(F.col("v") - F.col("_m")) / (F.col("_s") + F.lit(1.0)))
                .drop("_m", "_s"))
    return score(b), score(a)


def q_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    sb, sa = _versions(spark, sf_dir)
    r = MT.robustness(sb, sa, ROBUST_THRESHOLD)
    dbl = ["dur_before", "dur_after", "duration_rate", "size_rate", "mean_before", "mean_after", "score_reduction",
           "detection_reduction"]
    return r.select(*[rnd(c, 6).alias(c) if c in dbl else F.col(c) for c in r.columns])


def q_score_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    sb, sa = _versions(spark, sf_dir)
    j = MT.remove_outliers(MT.align_scores(sb, sa, ["seq"]))
    return j.select("seq", rnd("before", 6).alias("before"), rnd("after", 6).alias("after"), "removed")


def q_reference_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    d = MT.reference_distances(e.where(F.col("label") != 0), e.where(F.col("label") == 0), "vec_id", "x")
    return d.select("vec_id", rnd("min_dist", 6).alias("min_dist"), rnd("max_dist", 6).alias("max_dist"))


def q_proximity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    q, ref = e.where(F.col("label") != 0), e.where(F.col("label") == 0)
    after = q.withColumn("x", F.transform("x", lambda v: v * F.lit(0.5)))
    r = MT.proximity_ratio(MT.reference_distances(q, ref, "vec_id", "x"),
                           MT.reference_distances(after, ref, "vec_id", "x"))
    return r.select(*[rnd(c, 6).alias(c) for c in r.columns])


def host_vectors(spark: SparkSession, sf_dir: str, key_mode: str = "typed", in_sequence: bool = False) -> DataFrame:
    return HS.host_stats(HS.packets_for_stats(_ip_rows(spark, sf_dir)), key_mode=key_mode, in_sequence=in_sequence)


def q_host_stats(spark: SparkSession, sf_dir: str, key_mode: str = "typed") -> DataFrame:
    v = host_vectors(spark, sf_dir, key_mode)
    kinds = []
    for role, width in HS.LAYOUT:
        parts = ("w", "mean", "var") if width == 3 else ("radius", "magnitude", "cov", "pcc")
        kinds += [p for _ in range(5) for p in parts]
    return v.select("seq", *[rnd(v["x"][i], O.HOST_DIGITS[k]).alias(f"x{i}") for i, k in enumerate(kinds)])


DET_M = 10


def _ranked_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = TB.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"),
                                                      F.col("embedding").cast("array<double>").alias("x"))
    return DT.with_rank(e)


def q_correlation_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, A18 over all embeddings."""
    d = DT.correlation_distance(DT.correlation_matrix(_ranked_embeddings(spark, sf_dir)))
    return d.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), rnd("d", 6).alias("d"))


def q_feature_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = DT.correlation_distance(DT.correlation_matrix(_ranked_embeddings(spark, sf_dir)))
    return DT.feature_map(spark, d, 64, DET_M)


def detector_scores(spark: SparkSession, sf_dir: str):
    """Host vectors -> feature map -> ensemble training on all packets ->
    saved and loaded model -> masked scoring."""
    from ..session import checkpoint_dir, release
    import uuid
    made = host_vectors(spark, sf_dir, in_sequence=True)
    v = DT.in_sequence(made)
    release(made)
    fmap = DT.feature_map(spark, DT.correlation_distance(DT.correlation_matrix(v)), 100, DET_M)
    path = f"{checkpoint_dir(spark).rstrip('/')}/detector-{uuid.uuid4().hex[:10]}"
    DT.train_detector(spark, v, fmap).save(spark, path)
    model = DT.Detector.load(spark, path)
    return DT.score(v.withColumn("x", HS.mask_columns(F.col("x"), HS.PCC_COLS)), model), model.threshold


def q_anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, threshold = detector_scores(spark, sf_dir)
    return scores.withColumn("alert", MT.alert(F.col("rmse"), threshold))


FIXED_GROUP, FIXED_HIDDEN = 8, 6


def fixed_member(low: float, high: float) -> DT.Member:
    """An autoencoder whose parameters follow a formula, as in the SQL twin."""
    import numpy as np
    i, h = np.indices((FIXED_GROUP, FIXED_HIDDEN))
    return DT.Member(((i * 7 + h * 3) % 11 - 5) / 10.0, np.arange(FIXED_HIDDEN) / 10.0, -np.arange(FIXED_GROUP) / 20.0,
                     np.full(FIXED_GROUP, low), np.full(FIXED_GROUP, high))


def _fixed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 with fixed parameters: 8 members of 8 features over all embeddings."""
    groups = [list(range(k * FIXED_GROUP, (k + 1) * FIXED_GROUP)) for k in range(8)]
    model = DT.Detector(groups, [fixed_member(-1.0, 1.0) for _ in groups], fixed_member(0.0, 1.0), 0.0)
    return DT.score(_embeddings(spark, sf_dir), model, keys=("vec_id",))


def q_detector_score_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed_scores(spark, sf_dir).select("vec_id", rnd("rmse", 9).alias("rmse"))


def q_detector_training_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: summed gradients of one step for the first feature group."""
    g = DT.gradient_sums(_embeddings(spark, sf_dir), [list(range(FIXED_GROUP))], [fixed_member(-1.0, 1.0)])[0]
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(g)], "k int, g double").select("k", rnd("g", 5).alias("g"))


ROUND_REPLICAS, ROUND_RATE = 4, 0.1


def q_detector_averaging_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: one averaging round of all feature groups; every replica takes one
    Adam step over its rows in id order, with the range running along."""
    import numpy as np
    groups = [list(range(k * FIXED_GROUP, (k + 1) * FIXED_GROUP)) for k in range(8)]
    start = DT.Learner.fresh(FIXED_GROUP)
    learners = [DT.Learner(fixed_member(np.inf, -np.inf), start.first, start.second) for _ in groups]
    rows = (_embeddings(spark, sf_dir).withColumn("replica", F.col("vec_id") % ROUND_REPLICAS)
            .repartition("replica").sortWithinPartitions("replica", "vec_id"))
    got = DT.averaging_round(rows, groups, learners, ROUND_RATE, 1 << 20)
    return spark.createDataFrame([(g, k, float(v)) for g, w in enumerate(got) for k, v in enumerate(
        np.concatenate([w.member.flat(), w.member.low, w.member.high]))], "grp int, k int, v double").select("grp", "k", rnd("v", 7).alias("v"))


def q_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """threshold = largest score of the even ids, summary over all."""
    s = _fixed_scores(spark, sf_dir)
    threshold = s.where("vec_id % 2 = 0").agg(F.max("rmse")).first()[0] or 0.0
    r = MT.score_summary(s, threshold)
    return r.select("alerts", "total", rnd("mean", 6).alias("mean"), rnd("max", 6).alias("max"), rnd(F.lit(float(threshold)), 6).alias("threshold"))


def q_distances_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 with ids that repeat: one row per query row."""
    e = _embeddings(spark, sf_dir).withColumn("gid", F.col("vec_id") % 7)
    d = MT.reference_distances(e.where(F.col("label") != 0), e.where(F.col("label") == 0), "gid", "x", block_rows=100)
    return d.select("gid", rnd("min_dist", 6).alias("min_dist"), rnd("max_dist", 6).alias("max_dist"))


def q_decay_large_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5 with a mean of a million and a variance near 1."""
    rows = _ip_rows(spark, sf_dir).select(F.col("src_ip").alias("k"), "seq", "t", (F.lit(1e6) + F.col("seq") % 3).alias("v"))
    return _round_1d(DC.decayed_stats_1d(rows, ["k"]), (4, 6, 6))


def q_cidr_duplicate_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = (TB.packets_from_events(spark, sf_dir).where(F.col("accepted"))
             .select(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst")).distinct())
    return FL.labels_for_pairs(pairs, FL.label_nets(spark, CIDR_SPECS + CIDR_SPECS)).select("src", "dst", "label")


def q_report_label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 with label values from 0 to 9."""
    e = _embeddings(spark, sf_dir)
    r = MT.confusion_report(e.select(F.lit("all").alias("model"), F.col("label"), (F.col("vec_id") % 4).alias("pred")), ["model"])
    return r.select("model", "tn", "fp", "fn", "tp", "samples", rnd("accuracy", 6).alias("accuracy"), rnd("f1", 6).alias("f1"))


def _flat_fragments(f: DataFrame) -> DataFrame:
    return f.select(*_flat_flow(f), "window_start_us", F.col("pos").cast("int").alias("pos"), "seq",
                    *[rnd(f"f{i}", 6).alias(f"f{i}") for i in range(11)], "label")


CUT_WIDTH, CUT_N = 60 * DAY_US, 3


def q_fragments_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 on windows so long that the packet limit cuts."""
    return _flat_fragments(fragments(spark, sf_dir, CUT_WIDTH, CUT_N))


def q_fragments_ddos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attack traffic only."""
    return _flat_fragments(FL.build_fragments(_frames(spark, sf_dir), CUT_WIDTH, CUT_N, labels=TB.label_pairs(spark), traffic_type="ddos"))


def q_fragments_benign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_fragments(FL.build_fragments(_frames(spark, sf_dir), CUT_WIDTH, CUT_N, labels=TB.label_pairs(spark), traffic_type="benign"))


def q_packet_counts_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: packets per label from the vectors' packet column."""
    return DS.count_packets_b(DS.flow_vectors(fragments(spark, sf_dir, CUT_WIDTH, CUT_N))).select("label", F.col("packets").cast("long").alias("packets"))


def q_stat_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all packets update the statistics, every tenth is returned."""
    rows = _ip_rows(spark, sf_dir)
    stats = DC.decayed_stats_1d(rows.select(F.col("src_ip").alias("k"), "seq", "t", F.col("frame_len").alias("v")), ["k"])
    return _round_1d(HS.select_positions(stats, rows.where("seq % 10 = 0").select("seq")))


def q_masked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 on the embeddings: the pcc positions that exist there are zeroed."""
    x = HS.mask_columns(F.col("x"), [c for c in HS.PCC_COLS if c < 64])
    return _embeddings(spark, sf_dir).select("vec_id", F.posexplode(x).alias("j", "v")).select("vec_id", "j", rnd("v", 6).alias("v"))


def q_minmax_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of the even ids applied to all."""
    e = _embeddings(spark, sf_dir)
    z = DT.minmax_transform(e, DT.minmax_fit(e.where("vec_id % 2 = 0")))
    return z.select("vec_id", F.posexplode("x").alias("j", "v")).select("vec_id", "j", rnd("v", 6).alias("v"))


def q_running_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row by the range of the rows so far."""
    z = DT.running_minmax_transform(_ranked_embeddings(spark, sf_dir), chunk_rows=128)
    return z.select("rank", F.posexplode("x").alias("j", "v")).select("rank", "j", rnd("v", 6).alias("v"))


def q_rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the last five values per host, with a zero start."""
    rows = _ip_rows(spark, sf_dir).select(F.col("src_ip").alias("k"), "seq", F.col("frame_len").alias("v"))
    return DC.rolling_mean(rows, 5, ["k"]).select("k", "seq", rnd("rollmean", 6).alias("rollmean"))


def _last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ip_rows(spark, sf_dir).select(F.col("src_ip").alias("k"), "seq", "t", F.col("frame_len").alias("v"))
    return DC.latest_state(DC.decayed_stats_1d(rows, ["k"]), ["k", "lam"])


EVICT_AFTER_H, EVICT_WEIGHT = 2.0, 0.5


HIST_BINS, HIST_LO, HIST_HI, HIST_GRACE = 12, 5.0, 80.0, 30


def _histogram(spark: SparkSession, sf_dir: str, **bounds) -> DataFrame:
    rows = _ip_rows(spark, sf_dir).select(F.col("src_ip").alias("k"), "seq", "t", F.col("frame_len").alias("v"))
    d = DC.histogram_score(rows, ["k"], HIST_BINS, **bounds)
    score = F.when(F.col("score") == float("inf"), F.lit(-1.0)).otherwise(F.col("score"))   # SQL has no such number
    return d.select("k", "seq", "lam", "bin", rnd(score, 5).alias("score"))


def q_histogram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11 with given bounds, which some values lie outside of."""
    return _histogram(spark, sf_dir, lo=HIST_LO, hi=HIST_HI)


def q_histogram_score_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the bins at most two away."""
    return _histogram(spark, sf_dir, lo=HIST_LO, hi=HIST_HI, window=2)


def q_histogram_score_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11 with bounds learned from each stream's first rows."""
    return _histogram(spark, sf_dir, grace=HIST_GRACE)


def q_extrapolated_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two directions of every host pair as streams."""
    rows = _ip_rows(spark, sf_dir).select(F.concat_ws("|", F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip")).alias("pair"),
                                          (F.col("src_ip") > F.col("dst_ip")).alias("side"), "seq", "t", F.col("frame_len").alias("v"))
    return DC.extrapolated_cov(rows, ["pair"], "side").select("pair", "seq", "lam", rnd("cov", 1).alias("cov"))


def q_evicted_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams whose weight is above the cut two hours after the last packet."""
    now = _ip_rows(spark, sf_dir).agg(F.max("t")).first()[0] + EVICT_AFTER_H
    kept = DC.evict_old_streams(_last_state(spark, sf_dir), EVICT_WEIGHT, now)
    return kept.select("k", "lam", "seq", rnd("w", 4).alias("w"))


def q_nd_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radius and magnitude over all hosts' last states, per rate."""
    d = DC.nd_stats(_last_state(spark, sf_dir), ["lam"])
    return d.select("lam", rnd("radius", 3).alias("radius"), rnd("magnitude", 3).alias("magnitude"))


def q_vector_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 reshape, flatten, distance of first and last row."""
    e = _embeddings(spark, sf_dir).withColumn("m", DS.reshape(F.col("x"), 8, 8))
    return e.select("vec_id", rnd(MT.euclidean(F.col("m")[0], F.col("m")[7]), 6).alias("dist"), rnd(DS.flatten_x(F.col("m"))[63], 6).alias("last"))


def q_all_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7 over columns of the embeddings."""
    e = _embeddings(spark, sf_dir).withColumn("dims", F.size("x"))
    return spark.createDataFrame([(c, DS.all_same(e, c)) for c in ("dims", "label")], "col string, same boolean")


def q_balanced_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: equal rows of every dataset per split."""
    from ..sources import sinks as SK
    e = _embeddings(spark, sf_dir).select(F.col("vec_id").alias("sample_id"), (F.col("label") % 3).alias("dataset_id"), (F.col("vec_id") % 2).alias("split"))
    return SK.cross_dataset_balance(e).select("sample_id", "dataset_id", "split")


def q_tensor_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save two tensor datasets, check them, load one split of each, merge."""
    from ..sources import sinks as SK
    from ..streaming.online import scratch
    e = _embeddings(spark, sf_dir).select(F.col("x").alias("set_x"), F.when(F.col("label") >= 5, 1).otherwise(0).alias("set_y"),
                                          F.when(F.col("vec_id") % 10 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"), "vec_id")
    paths = []
    for k, name in enumerate(("DOS2018", "DOS2019")):
        paths.append(scratch(spark, f"tensors-{name}"))
        SK.save_samples(e.where(F.col("vec_id") % 2 == k), paths[-1], 10.0, 10, name)
    merged = SK.merge_datasets(*[SK.load_samples(spark, p, "train") for p in paths])
    width, n, name = SK.check_flow_stores(merged)
    return (merged.groupBy("dataset_id", "set_y").agg(F.count("*").alias("rows"), rnd(F.sum(F.col("set_x")[0]), 6).alias("x0"))
            .withColumns({"time_window": F.lit(width), "max_flow_len": F.lit(int(n)), "merged_id": F.lit(name)}))


def q_vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature matrix written and read again."""
    from ..streaming.online import scratch
    path = scratch(spark, "vectors")
    HS.save_vectors(_embeddings(spark, sf_dir).select(F.col("vec_id").alias("seq"), "x"), path)
    v = HS.load_vectors(spark, path)
    return v.select("seq", F.size("x").alias("dims"), rnd(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


def q_stream_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity and subnet of every frame; refused frames act as ARP."""
    p = TB.packets_from_events(spark, sf_dir)
    e = F.lit("")
    tcp, udp = F.col("ip_proto") == 6, F.col("ip_proto") == 17
    port = lambda on, c: F.when(on, F.col(c).cast("string")).otherwise(e)
    ip = lambda c: F.coalesce(F.col(c), e)
    arp = F.col("ip_proto").isNull()
    ident = P.stream_identity(ip("src_ip"), ip("dst_ip"), e, e, port(tcp, "src_port"), port(tcp, "dst_port"), port(udp, "src_port"),
                              port(udp, "dst_port"), F.col("eth_src"), F.col("eth_dst"), F.when(arp, F.lit("1")).otherwise(e),
                              F.when(arp, F.lit("10.9.0.1")).otherwise(e), F.when(arp, F.lit("10.9.0.2")).otherwise(e),
                              F.when(F.col("ip_proto") == 1, F.lit("8")).otherwise(e))
    d = p.select("seq", "eth_src", *[c.alias(n) for n, c in ident.items()])
    return d.select("seq", "ip_type", "src_ip", "dst_ip", "src_proto", "dst_proto", P.subnet(F.col("ip_type"), F.col("src_ip"), F.col("eth_src")).alias("subnet"))


def q_outliers_zeroed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 with the feature vector and the number of removed rows."""
    e = _embeddings(spark, sf_dir)
    s = e.select("vec_id", "x", F.abs(e["x"][0]).alias("before"), F.abs(e["x"][1]).alias("after"))
    r = MT.remove_outliers(s, vector="x")
    return r.agg(F.sum("removed").cast("long").alias("removed"), rnd(F.sum("after"), 6).alias("after"),
                 rnd(F.sum(F.abs(F.col("x")[2])), 6).alias("x2"))


def q_proximity_ratio_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15 as the reference defines it: both versions and the reference rows
    are scaled by the range of the reference rows first."""
    e = _embeddings(spark, sf_dir)
    q, ref = e.where(F.col("label") != 0), e.where(F.col("label") == 0)
    after = q.withColumn("x", F.transform("x", lambda v: v * F.lit(0.5)))
    bounds = DT.minmax_fit(ref)
    q, ref, after = (DT.minmax_transform(d, bounds) for d in (q, ref, after))
    r = MT.proximity_ratio(MT.reference_distances(q, ref, "vec_id", "x"), MT.reference_distances(after, ref, "vec_id", "x"))
    return r.select(*[rnd(c, 6).alias(c) for c in r.columns])


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    return e.withColumn("label", F.when(F.col("label") >= 5, 1).otherwise(0).cast("double"))


def q_standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    z = RD.standardize_transform(e, RD.standardize_fit(e))
    return z.select("vec_id", F.posexplode("x").alias("j", "z")).select(
        "vec_id", F.col("j").cast("int").alias("j"), rnd("z", 6).alias("z"))


PCA_K = 9


def q_pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    z = RD.standardize_transform(e, RD.standardize_fit(e))
    _, ev = RD.pca_fit(z, PCA_K)
    # the explained variances are k numbers produced by the fit; expose them as a table
    rows = [(i, float(v), float(sum(ev[:i + 1]))) for i, v in enumerate(ev)]
    return spark.createDataFrame(rows, "component int, explained double, cumulative double")


def q_pca_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: components that reach 80 and 90 % of the variance."""
    e = _vectors(spark, sf_dir)
    z = RD.standardize_transform(e, RD.standardize_fit(e))
    return spark.createDataFrame([(s, RD.pca_to_share(z, s)[1]) for s in (0.8, 0.9)], "share double, components int")


def q_pca_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: a full set of components diagonalises the covariance. With q the
    quadratic forms of the components, their sum is the trace and their sum of
    squares the squared norm of the covariance, which SQL takes from the rows;
    the components are orthonormal and explain q / sum(q)."""
    import numpy as np
    e = _embeddings(spark, sf_dir)
    model, explained = RD.pca_fit(e, 64)
    v, c = model.pc.toArray(), RD.covariance(e)
    q = np.einsum("ik,ij,jk->k", v, c, v)
    row = (float(q.sum()), float((q ** 2).sum()), float(abs(v.T @ v - np.eye(64)).max()), float(abs(q / q.sum() - explained).max()))
    d = spark.createDataFrame([row], "trace double, squares double, ortho double, share double")
    return d.select(*[rnd(k, n).alias(k) for k, n in zip(d.columns, (7, 9, 6, 6))])


def _split_vectors(spark: SparkSession, sf_dir: str):
    e = _vectors(spark, sf_dir)
    z = RD.standardize_transform(e, RD.standardize_fit(e))
    model, _ = RD.pca_fit(z, PCA_K)
    p = RD.pca_transform(model, z).select("vec_id", F.col("pc").alias("x"), "label")
    is_test = F.pmod(F.xxhash64("vec_id"), F.lit(10)) == 0
    return p.where(~is_test), p.where(is_test)


def _report(preds: DataFrame, model: str) -> DataFrame:
    r = MT.confusion_report(preds.withColumn("model", F.lit(model)).withColumn("source", F.lit("embeddings")),
                            ["model", "source"])
    return r


def q_svm_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split_vectors(spark, sf_dir)
    m = RD.linear_svm(train)
    return _report(RD.predict(m, test), "linear-svm")


def q_mlp_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split_vectors(spark, sf_dir)
    m = RD.mlp(train, PCA_K, hidden=8, layers=2)
    return _report(RD.predict(m, test), "mlp")


def q_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _split_vectors(spark, sf_dir)
    cs = [0.1, 1.0, 10.0]
    _, scores = RD.grid_search_svm(train, cs, folds=2)
    return spark.createDataFrame([(float(c), float(s)) for c, s in zip(cs, scores)], "c double, cv_accuracy double")


def _epochs(spark: SparkSession, rows: DataFrame, step, states: list[str], parts: int):
    """A job over ``rows`` replayed in ``parts`` micro-batches."""
    from ..streaming import epochs as EP
    from ..streaming import online as ON
    job = EP.Epochs(spark, ON.scratch(spark, "epochs"))
    EP.run_epochs(ON.replayed(rows, "seq", parts), job, step, states)
    return job


def q_stream_decay_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import epochs as EP
    rows = _ip_rows(spark, sf_dir).select(F.col("src_ip").alias("k"), "seq", "t", F.col("frame_len").alias("v"))
    return _round_1d(_epochs(spark, rows, EP.decay_step(DC.LAMBDAS), ["streams"], 4).output("stats"))


def q_stream_decay_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2 for pairs: sender, receiver and pair states over four micro-batches."""
    from ..streaming import epochs as EP
    rows = _ip_rows(spark, sf_dir).select(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), "seq", "t", F.col("frame_len").alias("v"))
    d = _epochs(spark, rows, EP.pair_step(DC.LAMBDAS), EP.PAIR_STATES, 4).output("stats")
    return d.select("seq", "lam", rnd("radius", 3).alias("radius"), rnd("magnitude", 3).alias("magnitude"),
                    rnd("cov", 1).alias("cov"), rnd("pcc", 3).alias("pcc"))


def q_stream_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: fragments that go on over micro-batches; the last windows are read
    from the state."""
    from ..streaming import epochs as EP
    labels = TB.label_pairs(spark)
    job = _epochs(spark, _frames(spark, sf_dir), EP.fragment_step(HOUR_US, MAX_FLOW_LEN, labels), EP.FRAGMENT_STATES, 4)
    f = job.output("fragments").drop("epoch").unionByName(EP.open_fragments(job, MAX_FLOW_LEN, labels))
    return _fragment_rows(f)


EXPIRY_H, LATE_DAYS, EXPIRY_DAYS = 24.0, 1200.0, 100.0


def q_stream_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that begin anew after a day without rows."""
    from ..streaming import epochs as EP
    rows = _ip_rows(spark, sf_dir).select(F.concat_ws("|", "src_ip", "dst_ip").alias("k"), "seq", "t", F.col("frame_len").alias("v"))
    return _round_1d(_epochs(spark, rows, EP.expiry_step(DC.LAMBDAS, EXPIRY_H, 2.0), EP.EXPIRY_STATES, 4).output("stats"))


def _expired_orders(spark: SparkSession, sf_dir: str):
    from ..streaming import epochs as EP
    rows = TB.keyed_values_from_orders(spark, sf_dir).withColumnRenamed("key", "k")
    return _epochs(spark, rows, EP.expiry_step(DC.LAMBDAS, EXPIRY_DAYS, LATE_DAYS), EP.EXPIRY_STATES, 3)


def q_stream_expired_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on orders, which come in any order: late ones change nothing."""
    return _round_1d(_expired_orders(spark, sf_dir).output("stats"), ORDERS_DIGITS)


def q_stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The late rows themselves, counted by stream."""
    return (_expired_orders(spark, sf_dir).output("late").groupBy("k")
            .agg(F.count(F.lit(1)).alias("late_rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")))


STREAM_DELAY_US = 2 * HOUR_US


def q_stream_flow_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import online as ON
    pk = TB.packets_from_events(spark, sf_dir)
    stream = ON.replayed(pk, "seq", 4)
    out = ON.scratch(spark, "stream-windows")
    ON.run_available_now(ON.stream_flow_windows(stream, "1 hour", "2 hours", TB.label_pairs(spark)), out)
    r = spark.read.parquet(out)
    return r.select(*[rnd(c, 4).alias(c) if c == "bytes" else F.col(c) for c in r.columns])


def q_merged_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.capture import merge_captures
    ev = TB.table(spark, sf_dir, "events").select(F.col("event_type").alias("capture_id"),
                                                  F.col("event_id").alias("seq"), "value")
    m = merge_captures(ev, chunk_rows=4096)
    return m.select("capture_id", "seq", "source_capture", "source_seq")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DS.to_samples(DS.normalize(fragments(spark, sf_dir, HOUR_US), MINS_A, MAXS_A), MAX_FLOW_LEN)


def stored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared samples with a key each, written and read back."""
    from ..session import cut_lineage
    return cut_lineage(_samples(spark, sf_dir).select(
        F.concat_ws("|", F.col("flow.src"), F.col("flow.sport"), F.col("flow.dst"), F.col("flow.dport"),
                    F.col("flow.proto"), F.col("window_start_us").cast("string")).alias("sample_id"), "set_x"))


def predict_stored(samples: DataFrame) -> DataFrame:
    return CN.predict_cnn(samples, CN.init_cnn(11, kernels=64), ["sample_id"]).select("sample_id", rnd("p", 6).alias("p"), "pred")


def q_cnn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: prediction with fixed start weights from stored samples."""
    return predict_stored(stored_samples(spark, sf_dir))


#: Queries whose bench times inference alone: (prepare, run).
STORED = {"cnn_predict": (stored_samples, predict_stored)}


def q_cnn_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments -> normalised, padded samples -> flow-level split -> CNN
    training (data parallel) -> predictions on the test flows -> report."""
    from ..session import cut_lineage
    samples = _samples(spark, sf_dir)
    bucket = F.pmod(F.xxhash64(F.col("flow.src"), F.col("flow.sport"), F.col("flow.dst"), F.col("flow.dport"),
                               F.col("flow.proto")), F.lit(10))
    samples = cut_lineage(samples.withColumn("split", F.when(bucket == 0, F.lit("test"))
                                             .when(bucket == 1, F.lit("val")).otherwise(F.lit("train"))))
    params, _ = CN.train_cnn(spark, samples.where(F.col("split") == "train"),
                             samples.where(F.col("split") == "val"), 11, kernels=8, lr=0.01, epochs=8, patience=3)
    test = samples.where(F.col("split") == "test").withColumn("sample_id", F.concat_ws(
        "|", F.col("flow.src"), F.col("flow.dst"), F.col("window_start_us").cast("string")))
    preds = CN.predict_cnn(test, params, ["sample_id", "set_y"]).withColumnRenamed("set_y", "label")
    return MT.confusion_report(preds.withColumn("model", F.lit("cnn")).withColumn("source", F.lit("events")),
                               ["model", "source"])


def q_tsv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All packets as dissector lines, some broken, read back: lines
    and packet bytes by reason (``good``: none)."""
    from ..session import checkpoint_dir
    from ..sources import capture as CP
    import uuid
    folder = f"{checkpoint_dir(spark).rstrip('/')}/tsv-{uuid.uuid4().hex[:10]}"
    pk = TB.packets_from_events(spark, sf_dir)
    broken = F.col("seq") % 11
    ports = {f"{proto}.{side}port": F.when(F.col("ip_proto") == n, F.col(f"{side}_port").cast("string"))
             for proto, n in (("tcp", 6), ("udp", 17)) for side in ("src", "dst")}
    ports["tcp.srcport"] = F.when(broken == 9, "70000").otherwise(ports["tcp.srcport"])
    cols = {"frame.time_epoch": F.when(broken == 5, "n/a").otherwise((F.col("ts_us") / F.lit(1e6)).cast("decimal(20,6)").cast("string")),
            "frame.len": F.when(broken == 7, "-5").otherwise(F.col("ip_len").cast("string")),
            "eth.src": F.col("eth_src"), "eth.dst": F.col("eth_dst"), "ip.src": F.col("src_ip"), "ip.dst": F.col("dst_ip"), **ports}
    fields = F.array(*[F.coalesce(cols[f], F.lit("")) if f in cols else F.lit("") for f in CP.TSV_FIELDS])
    sent = F.when(broken == 3, F.slice(fields, 1, 12)).when(broken == 1, F.concat(fields, F.array(F.lit("more")))).otherwise(fields)
    header = spark.createDataFrame([("\t".join(CP.TSV_FIELDS),)], "line string")
    header.unionAll(pk.select(F.array_join(sent, "\t"))).write.text(f"{folder}/in")
    good = CP.load_packet_tsv(spark, f"{folder}/in", f"{folder}/rejects")
    bad = spark.read.parquet(f"{folder}/rejects")
    both = good.select(F.lit("good").alias("reason"), F.col("frame_len").cast("long").alias("n")).unionAll(bad.select("reason", F.lit(0).cast("long")))
    return both.groupBy("reason").agg(F.count("*").alias("lines"), F.sum("n").alias("bytes"))


# ------------------------------------------------------------------ networks
STEP_DROPOUT, STEP_L1, STEP_L2, STEP_RATE = 0.25, 0.01, 0.02, 0.5
FIXED_CONV, FIXED_DENSE = TR.ConvNet(8, 8, 4), TR.DenseNet(64, (6, 4))


def fixed_params(net):
    """Parameters that follow a formula, as in the SQL twin."""
    import numpy as np
    return ((np.arange(net.size) * 7) % 13 - 6) / 20.0


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir).select(F.col("vec_id").cast("long").alias("key"), "x", (F.col("label") >= 5).cast("double").alias("y"))


def _predict_fixed(spark: SparkSession, sf_dir: str, net) -> DataFrame:
    r = TR.predict(_labelled(spark, sf_dir), net, fixed_params(net), ["key"])
    return r.select(F.col("key").alias("vec_id"), rnd("p", 9).alias("p"), "pred")


def _one_step(spark: SparkSession, sf_dir: str, net) -> DataFrame:
    """Parameters after one seeded step over all rows with dropout and penalties."""
    c = TR.Candidate(net, STEP_RATE, "sgd", 1 << 20, STEP_DROPOUT, STEP_L1, STEP_L2, seed=3)
    state, _, _ = TR.averaged_epoch(_labelled(spark, sf_dir), [(c, TR.State.fresh(fixed_params(net)))], 1)[0]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(state.flat)], "i int, v double").select("i", rnd("v", 8).alias("v"))


def q_cnn_predict_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 over embeddings as 8 x 8 samples."""
    return _predict_fixed(spark, sf_dir, FIXED_CONV)


def q_cnn_training_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 over embeddings as 8 x 8 samples."""
    return _one_step(spark, sf_dir, FIXED_CONV)


def q_mlp_predict_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 over embeddings."""
    return _predict_fixed(spark, sf_dir, FIXED_DENSE)


def q_mlp_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 over embeddings."""
    return _one_step(spark, sf_dir, FIXED_DENSE)


def _validation(test: DataFrame, best, setting: dict, model: str, source: str) -> DataFrame:
    preds = TR.predict(test, best.candidate.net, best.state.flat, ["key", "y"])
    return MT.validation_report(preds, model, setting, source, label="y")


def q_cnn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid over rate, batch, kernels, penalty and dropout
    trained side by side on the training flows; validation report of the best."""
    from ..session import cut_lineage
    key = F.xxhash64("flow.src", "flow.sport", "flow.dst", "flow.dport", "flow.proto", "window_start_us")
    part = F.pmod(F.xxhash64("flow.src", "flow.sport", "flow.dst", "flow.dport", "flow.proto"), F.lit(10))
    rows = cut_lineage(_samples(spark, sf_dir).select(key.alias("key"), part.alias("part"), F.flatten("set_x").alias("x"),
                                                      F.col("set_y").cast("double").alias("y")))
    settings = TR.grid(rate=[0.1, 0.01], batch=[1024, 2048], kernels=[32], l1=[0.0, 0.01], dropout=[0.0, 0.2])

    def make(rate, batch, kernels, l1, dropout):
        return TR.Candidate(TR.ConvNet(MAX_FLOW_LEN, 11, kernels), rate, "adam", batch, dropout, l1)
    best, table = TR.search(rows.where("part > 1"), rows.where("part = 1"), make, settings, epochs=SEARCH_EPOCHS, patience=SEARCH_PATIENCE)
    return _validation(rows.where("part = 1"), best, _setting(best, table, make), "events-cnn", "events")


def q_mlp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random search over a dense network's settings with two folds."""
    train, test = (d.select(F.col("vec_id").cast("long").alias("key"), "x", F.col("label").cast("double").alias("y"))
                   for d in _split_vectors(spark, sf_dir))
    settings = TR.random_settings(8, 1, rate=[0.001, 0.01], optimizer=["sgd", "adam"], units=[16, 32], dropout=[0.0, 0.5])

    def make(rate, optimizer, units, dropout):
        return TR.Candidate(TR.DenseNet(PCA_K, (units, units)), rate, optimizer, 100, dropout)
    best, table = TR.search(train, None, make, settings, folds=2, epochs=SEARCH_EPOCHS, patience=SEARCH_PATIENCE)
    return _validation(test, best, _setting(best, table, make), "embeddings-mlp", "embeddings")


SEARCH_EPOCHS, SEARCH_PATIENCE = 25, 4


def _setting(best, table: list[dict], make) -> dict:
    """The setting whose candidate ``best`` is."""
    plain = [{k: v for k, v in t.items() if k not in ("accuracy", "epochs")} for t in table]
    return next(s for s in plain if make(**s) == best.candidate)


def q_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 of fixed predictions over all embeddings."""
    preds = _embeddings(spark, sf_dir).select("label", (F.col("vec_id") % 4).alias("pred"))
    r = MT.validation_report(preds, "probe", {"rate": 0.1, "batch": 1024}, "all")
    return r.select("model", "samples", rnd("accuracy", 6).alias("accuracy"), rnd("f1", 6).alias("f1"), "parameters", "source")


_PK = TB.packets_from_events_sql()

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "flow_counts": (q_flow_counts, O.flow_counts_sql(DAY_US, MAX_FLOW_LEN)),
    "flow_counts_capped": (q_flow_counts_capped, O.flow_counts_sql(DAY_US, MAX_FLOW_LEN, FLOW_CAP)),
    "cidr_labels": (q_cidr_labels, O.cidr_labels_sql(_cidr_ranges())),
    "anchored_windows": (q_anchored_windows, O.windows_sql(HOUR_US)),
    "fragments": (q_fragments, O.fragments_sql(HOUR_US, MAX_FLOW_LEN)),
    "decay_1d": (q_decay_1d, O.decay_1d_sql(_PK, "src_ip", "frame_len", "accepted")),
    "decay_out_of_order": (q_decay_out_of_order, O.decay_1d_sql(TB.keyed_values_from_orders_sql(), "key", "v",
                                                              digits=ORDERS_DIGITS)),
    "jitter": (q_jitter, O.decay_1d_sql(_PK, "src_ip || '|' || dst_ip", "0.0", "accepted", jitter=True)),
    "normalized_fragments": (q_normalized_fragments, O.normalized_fragments_sql(HOUR_US, MAX_FLOW_LEN, MINS_A, MAXS_A)),
    "packet_counts": (q_packet_counts, O.packet_counts_sql(HOUR_US, MAX_FLOW_LEN, MINS_A, MAXS_A)),
    "feature_bounds": (q_feature_bounds, O.feature_bounds_sql(HOUR_US, MAX_FLOW_LEN, TIME_WINDOW_S)),
    "flow_vectors": (q_flow_vectors, O.flow_vectors_sql(HOUR_US, MAX_FLOW_LEN)),
    "balanced_flows": (q_balanced_flows, O.balanced_flows_sql(HOUR_US, MAX_FLOW_LEN)),
    "dataset_split": (q_dataset_split, O.dataset_split_sql(HOUR_US, MAX_FLOW_LEN)),
    "detection_report": (q_detection_report, O.detection_report_sql()),
    "robustness": (q_robustness, O.robustness_sql(TB.ATTACKERS, ROBUST_THRESHOLD)),
    "score_alignment": (q_score_alignment, O.score_alignment_sql(TB.ATTACKERS)),
    "reference_distances": (q_reference_distances, O.reference_distances_sql()),
    "proximity_ratio": (q_proximity_ratio, O.proximity_ratio_sql()),
    "host_stats": (q_host_stats, O.host_stats_sql()),
    "host_stats_concat_keys": (lambda spark, sf: q_host_stats(spark, sf, "concat"), O.host_stats_sql("concat")),
    "correlation_distance": (q_correlation_distance, O.correlation_distance_sql()),
    "detector_score_fixed": (q_detector_score_fixed, O.detector_score_sql()),
    "detector_training_step": (q_detector_training_step, O.detector_step_sql()),
    "distances_repeated_ids": (q_distances_repeated_ids, O.reference_distances_sql("any_value(q.vec_id) % 7 AS gid")),
    "decay_large_offset": (q_decay_large_offset, O.decay_1d_sql(_PK, "src_ip", "1e6 + seq % 3", "accepted", digits=(4, 6, 6))),
    "cidr_duplicate_specs": (q_cidr_duplicate_specs, O.cidr_labels_sql(_cidr_ranges())),
    "report_label_values": (q_report_label_values, O.report_label_values_sql()),
    "fragments_cut": (q_fragments_cut, O.fragments_sql(CUT_WIDTH, CUT_N)),
    "fragments_ddos": (q_fragments_ddos, O.fragments_sql(CUT_WIDTH, CUT_N) + " WHERE label <> 0"),
    "fragments_benign": (q_fragments_benign, O.fragments_sql(CUT_WIDTH, CUT_N) + " WHERE label = 0"),
    "packet_counts_vectors": (q_packet_counts_vectors, O.packet_counts_vectors_sql(CUT_WIDTH, CUT_N)),
    "stat_positions": (q_stat_positions, O.decay_1d_sql(_PK, "src_ip", "frame_len", "accepted") + " WHERE seq % 10 = 0"),
    "masked_vectors": (q_masked_vectors, O.masked_vectors_sql([c for c in HS.PCC_COLS if c < 64])),
    "minmax_normalised": (q_minmax_normalised, O.minmax_sql()),
    "running_minmax": (q_running_minmax, O.running_minmax_sql()),
    "rolling_mean": (q_rolling_mean, O.rolling_mean_sql(_PK)),
    "histogram_score": (q_histogram_score, O.histogram_sql(_PK, "src_ip", "frame_len", "accepted", HIST_BINS, HIST_LO, HIST_HI)),
    "histogram_score_window": (q_histogram_score_window, O.histogram_sql(_PK, "src_ip", "frame_len", "accepted", HIST_BINS, HIST_LO, HIST_HI, window=2)),
    "histogram_score_learned": (q_histogram_score_learned, O.histogram_sql(_PK, "src_ip", "frame_len", "accepted", HIST_BINS, grace=HIST_GRACE)),
    "extrapolated_cov": (q_extrapolated_cov, O.extrapolated_cov_sql(_PK, "accepted")),
    "evicted_streams": (q_evicted_streams, O.evicted_sql(_PK, EVICT_AFTER_H, EVICT_WEIGHT)),
    "nd_stats": (q_nd_stats, O.nd_stats_sql(_PK)),
    "vector_shapes": (q_vector_shapes, O.vector_shapes_sql()),
    "all_same": (q_all_same, """SELECT 'dims' AS col, count(DISTINCT len(embedding)) <= 1 AS same FROM embeddings
        UNION ALL SELECT 'label', count(DISTINCT label) <= 1 FROM embeddings"""),
    "balanced_datasets": (q_balanced_datasets, O.balanced_datasets_sql()),
    "tensor_store": (q_tensor_store, O.tensor_store_sql()),
    "vector_store": (q_vector_store, O.vector_store_sql()),
    "stream_identity": (q_stream_identity, O.stream_identity_sql(_PK)),
    "outliers_zeroed": (q_outliers_zeroed, O.outliers_sql()),
    "proximity_ratio_normalised": (q_proximity_ratio_normalised, O.proximity_ratio_normalised_sql()),
    "feature_map": (q_feature_map, None),
    "anomaly_scores": (q_anomaly_scores, None),
    "score_summary": (q_score_summary, O.score_summary_sql()),
    "standardized": (q_standardized, O.standardized_sql()),
    "pca_variance": (q_pca_variance, None),
    "pca_share": (q_pca_share, None),
    "pca_residual": (q_pca_residual, O.pca_residual_sql()),
    "svm_report": (q_svm_report, None),
    "mlp_report": (q_mlp_report, None),
    "grid_search": (q_grid_search, None),
    "stream_decay_1d": (q_stream_decay_1d, O.decay_1d_sql(_PK, "src_ip", "frame_len", "accepted")),
    "stream_decay_2d": (q_stream_decay_2d, O.decay_2d_sql(_PK, "src_ip", "dst_ip", "frame_len", "accepted")),
    "stream_fragments": (q_stream_fragments, O.fragments_sql(HOUR_US, MAX_FLOW_LEN)),
    "stream_expired": (q_stream_expired, O.expired_sql(_PK, "src_ip || '|' || dst_ip", "frame_len", EXPIRY_H, 2.0, where="accepted")),
    "stream_expired_late": (q_stream_expired_late, O.expired_sql(TB.keyed_values_from_orders_sql(), "key", "v", EXPIRY_DAYS, LATE_DAYS, digits=ORDERS_DIGITS)),
    "stream_late_rows": (q_stream_late_rows, O.late_rows_sql(TB.keyed_values_from_orders_sql(), "key", LATE_DAYS)),
    "stream_flow_windows": (q_stream_flow_windows, O.stream_flow_windows_sql(HOUR_US, STREAM_DELAY_US)),
    "merged_captures": (q_merged_captures, """SELECT 'merged' AS capture_id,
        row_number() OVER (ORDER BY event_type, event_id) - 1 AS seq, event_type AS source_capture,
        event_id AS source_seq FROM events"""),
    "cnn_report": (q_cnn_report, None),
    "cnn_predict": (q_cnn_predict, None),
    "tsv_rejects": (q_tsv_rejects, f"""SELECT CASE WHEN seq % 11 IN (1, 3) THEN 'columns' WHEN seq % 11 = 5 THEN 'time'
        WHEN seq % 11 = 7 THEN 'length' WHEN seq % 11 = 9 THEN 'port' ELSE 'good' END AS reason, CAST(count(*) AS BIGINT) AS lines,
        CAST(sum(CASE WHEN seq % 11 IN (1, 3, 5, 7, 9) THEN 0 ELSE ip_len END) AS BIGINT) AS bytes FROM ({_PK}) GROUP BY 1"""),
    "detector_averaging_round": (q_detector_averaging_round, O.averaging_round_sql(ROUND_REPLICAS, ROUND_RATE)),
    "cnn_predict_fixed": (q_cnn_predict_fixed, O.conv_predict_sql()),
    "cnn_training_step": (q_cnn_training_step, O.conv_step_sql(STEP_DROPOUT, STEP_L1, STEP_L2, STEP_RATE)),
    "mlp_predict_fixed": (q_mlp_predict_fixed, O.dense_predict_sql()),
    "mlp_step": (q_mlp_step, O.dense_step_sql(STEP_DROPOUT, STEP_L1, STEP_L2, STEP_RATE)),
    "cnn_search": (q_cnn_search, None),
    "mlp_search": (q_mlp_search, None),
    "validation_report": (q_validation_report, O.validation_report_sql()),
    "decay_2d": (q_decay_2d, O.decay_2d_sql(_PK, "src_ip", "dst_ip", "frame_len", "accepted")),
}
