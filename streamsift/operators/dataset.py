"""Fragments -> training tensors.

Fragments stay in long form (one row per packet position) until the sink;
arrays are only built per fragment, whose size is bounded by the maximum
flow length.  Balancing and splitting work on whole flows in a seeded hash
order (reproducible in SQL), with two-phase prefix sums over hash buckets so
that a class (there are only two) is never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packet as P
from ..functions.numeric import nan_to_num
from .flows import FEATURE_COLS
from .prefix import prefix_sum

FLOW_KEY = ["capture_id", "flow"]
FRAG_KEY = ["capture_id", "flow", "window_start_us"]


def scale_linear(x: Column, lo: float, hi: float, high: float = 1.0, low: float = 0.0) -> Column:
    """P10: high - ((high-low) * (max-x)) / (max-min); zero width -> NaN/inf,
    cleaned afterwards by ``nan_to_num`` exactly like the reference."""
    rng = F.lit(float(hi) - float(lo))
    num = F.lit(high - low) * (F.lit(float(hi)) - x)
    q = F.when(rng != 0, num / rng).otherwise(
        F.when(num == 0, F.lit(float("nan"))).when(num > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
    return F.lit(high) - q


def normalize(frag: DataFrame, mins: list[float], maxs: list[float], cols: list[str] = FEATURE_COLS) -> DataFrame:
    """R2 without padding: scale every feature column, NaN -> 0."""
    return frag.select(*[c for c in frag.columns if c not in cols],
                       *[nan_to_num(scale_linear(F.col(c), lo, hi)).alias(c)
                         for c, lo, hi in zip(cols, mins, maxs)])


def pad_long(frag: DataFrame, n: int, key: list[str] = FRAG_KEY, cols: list[str] = FEATURE_COLS) -> DataFrame:
    """R1 in long form: every fragment gets positions 1..n; missing rows are 0.

    One aggregation per fragment: its rows (at most n) as an array, filled up
    with zero rows and spread out again.
    """
    rows = frag.groupBy(*key).agg(F.max("label").alias("label"),
                                  F.sort_array(F.collect_list(F.struct("pos", *cols))).alias("_r"))
    body = F.transform("_r", lambda r: F.struct(*[r[c].alias(c) for c in cols]))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in cols])
    full = F.concat(body, F.array_repeat(zero, F.lit(int(n)) - F.size("_r")))
    out = rows.select(*key, "label", F.posexplode(full).alias("_p", "_x"))
    return out.select(*key, (F.col("_p") + 1).alias("pos"), *[F.col("_x")[c].alias(c) for c in cols], "label")


def to_samples(frag_long: DataFrame, n: int, key: list[str] = FRAG_KEY, cols: list[str] = FEATURE_COLS,
               pad: bool = True) -> DataFrame:
    """Long fragments -> one row per fragment: set_x array<array<double>> (n x F
    when padded), set_y label.  ``collect_list`` is bounded by n per group."""
    rows = frag_long.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("pos", F.array(*[F.col(c) for c in cols]).alias("x")))).alias("_r"),
        F.max("label").alias("set_y"))
    x = F.transform(F.slice(F.col("_r"), 1, int(n)), lambda r: r["x"])
    if pad:
        zero = F.array_repeat(F.lit(0.0), len(cols))
        x = F.concat(x, F.array_repeat(zero, F.greatest(F.lit(0), F.lit(int(n)) - F.size(x))))
    return rows.select(*key, x.alias("set_x"), F.col("set_y").cast("int").alias("set_y"))


def count_packets(frag_long_scaled: DataFrame | None = None, cols: list[str] = FEATURE_COLS) -> Column:
    """A2 expression: 1 when the scaled row has a non-zero feature sum."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.col(c)
    return F.when(total != 0, F.lit(1)).otherwise(F.lit(0))


def find_min_max(frag: DataFrame, time_window: float | None = None,
                 cols: list[str] = FEATURE_COLS) -> DataFrame:
    """A4: per feature, max (never below 0) and min over all packet rows;
    with ``time_window`` the timestamp bounds become [0, time_window]."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(c).alias(f"min_{i}"), F.greatest(F.max(c), F.lit(0.0)).alias(f"max_{i}")]
    wide = frag.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"min_{i}").alias("min"),
                                        F.col(f"max_{i}").alias("max")) for i in range(len(cols))]))
    out = wide.select(rows.alias("r")).select("r.*")
    if time_window is not None:
        out = (out.withColumn("min", F.when(F.col("feature") == 0, F.lit(0.0)).otherwise(F.col("min")))
               .withColumn("max", F.when(F.col("feature") == 0, F.lit(float(time_window))).otherwise(F.col("max"))))
    return out


def flow_vectors(frag: DataFrame, key: list[str] = FRAG_KEY) -> DataFrame:
    """A6 (+P12): catalogue-B 21-value vector per fragment from its packets.

    Expects columns f0 (relative seconds), f1 (length), f3 (IP flags),
    f4 (protocols), f5 (TCP length), f7 (TCP flags), f8 (window), f9 (UDP
    length), f10 (ICMP type).  IAT mean = (last - first) / n.
    """
    d = frag
    # flags are numeric here; split them with integer arithmetic
    v = F.col("f3").cast("long")
    d = (d.withColumn("ip_df", F.shiftright(v, 14).bitwiseAND(1)).withColumn("ip_mf", F.shiftright(v, 13).bitwiseAND(1))
         .withColumn("ip_rb", F.shiftright(v, 15).bitwiseAND(1)).withColumn("ip_frag_off", v.bitwiseAND(0x1FFF)))
    tf = F.col("f7").cast("long")
    for name, bit in P.TCP_FLAG_BITS:
        d = d.withColumn(f"tcp_{name}", F.shiftright(tf, bit).bitwiseAND(1))
    g = d.groupBy(*key).agg(
        ((F.max_by("f0", "pos") - F.min_by("f0", "pos")) / F.count("*")).alias("v0"),
        F.avg("f1").alias("v1"),
        F.sum("ip_df").cast("double").alias("v2"), F.sum("ip_mf").cast("double").alias("v3"),
        F.sum("ip_rb").cast("double").alias("v4"),
        F.avg("ip_frag_off").alias("v5"), F.avg("f4").alias("v6"), F.avg("f5").alias("v7"),
        *[F.sum(f"tcp_{name}").cast("double").alias(f"v{8 + i}") for i, (name, _) in enumerate(P.TCP_FLAG_BITS)],
        F.avg("f8").alias("v17"), F.avg("f9").alias("v18"), F.avg("f10").alias("v19"),
        F.count("*").cast("double").alias("v20"),
        F.max("label").alias("label"))
    return g


def flows_in_hash_order(flows: DataFrame, seed: int, key_cols: list[Column]) -> DataFrame:
    """Seeded permutation = order by md5(seed | flow identity)."""
    return flows.withColumn("_hk", F.md5(F.concat_ws("|", F.lit(str(seed)), *key_cols)))


def flow_identity(flow_col: str = "flow", capture: str = "capture_id") -> list[Column]:
    f = F.col(flow_col)
    return [F.col(capture), f["src"], f["sport"].cast("string"), f["dst"], f["dport"].cast("string"),
            f["proto"].cast("string")]


def hash_prefix(rows: int, per_bucket: int = 10_000) -> Column:
    """A prefix of the hash key with about ``per_bucket`` rows per value."""
    digits = 1
    while rows > per_bucket * 16 ** digits and digits < 32:
        digits += 1
    return F.substring("_hk", 1, digits)


def balance_flows(flows: DataFrame, seed: int = 1, total_fragments: float = float("inf")) -> DataFrame:
    """Whole flows in hash order; a flow is taken while its class's
    accumulated fragments are below min(total/2, ddos, benign) (all flows of
    a class when the other class is empty)."""
    cls = F.when(F.col("label") > 0, F.lit(1)).otherwise(F.lit(0))
    d = flows_in_hash_order(flows, seed, flow_identity()).withColumn("_cls", cls)
    counts = flows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("label") > 0, F.col("fragments")).otherwise(0)).alias("dd"),
                       F.sum(F.when(F.col("label") > 0, 0).otherwise(F.col("fragments"))).alias("bb")).first()
    dd, bb = counts["dd"] or 0, counts["bb"] or 0
    limit = float(total_fragments) if dd == 0 or bb == 0 else min(float(total_fragments) / 2.0, dd, bb)
    d = prefix_sum(d, ["_cls"], ["_hk"], "fragments", "_cum", hash_prefix(counts["n"]))
    return d.where(F.col("_cum") < F.lit(float(limit))).drop("_cls", "_cum", "_hk")


def split_flows(flows: DataFrame, train_size: float = 0.9, seeds=(2, 3)) -> DataFrame:
    """T3 applied twice: test from all flows, then validation from the rest.

    Each stage pops flows in a fresh hash order while the popped fragments
    are below total - total*train_size; a flow never spans two sets.
    """
    d = flows.withColumn("split", F.lit("train"))
    for seed, name in zip(seeds, ("test", "val")):
        rest = d.where(F.col("split") == "train")
        done = d.where(F.col("split") != "train")
        state = rest.agg(F.sum("fragments").alias("s"), F.count(F.lit(1)).alias("n")).first()
        total = float(state["s"] or 0)
        need = total - total * train_size
        r = flows_in_hash_order(rest, seed, flow_identity()).withColumn("_one", F.lit(1))
        r = prefix_sum(r, ["_one"], ["_hk"], "fragments", "_cum", hash_prefix(state["n"]))
        r = r.withColumn("split", F.when(F.col("_cum") < F.lit(need), F.lit(name)).otherwise(F.lit("train")))
        d = done.unionByName(r.drop("_hk", "_one", "_cum"))
    return d


def all_same(df: DataFrame, col: str) -> bool:
    """R7 on a column: one job, one number back."""
    return df.agg(F.countDistinct(col).alias("n")).first()["n"] <= 1


def flatten_x(set_x: Column) -> Column:
    """N x F -> n*F."""
    return F.flatten(set_x)


def reshape(flat: Column, rows: int, cols: int) -> Column:
    """n*F -> rows x cols."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(flat, i * cols + 1, cols))


def count_packets_b(vectors: DataFrame) -> DataFrame:
    """A3: sum of the Packets column (index 20) per label."""
    return vectors.groupBy("label").agg(F.sum(F.col("v20").cast("int")).alias("packets"))
