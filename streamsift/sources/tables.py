"""Driver tables and the adapters that turn them into the packet domain.

There are no packet captures among the given tables, so the operators are
fed through two documented views: ``packets_from_events`` (one event = one
frame) and ``keyed_values_from_orders`` (out-of-order, repeated instants).
Each adapter has a DuckDB twin (``*_sql``) with the same arithmetic, used as
a CTE by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packet as P
from ..functions.numeric import epoch_micros

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Adapter parameters (fixed so the Spark view and the SQL twin agree).
HOSTS = 20
PORTS = 3
BASE_PORT = 1000
ATTACKERS = ["10.0.0.1", "10.0.0.2", "10.0.0.3"]
VICTIMS = ["10.0.0.4", "10.0.0.5", "10.0.0.6"]
US_PER_HOUR = 3.6e9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def packets_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of one capture, in the packet schema of FIXTURES.md.

    ``error`` events become rejected frames (ARP): they advance windows but
    carry no flow.  Text fields (flags as hex) are produced the way a
    dissector prints them so the parsing expressions are exercised.
    """
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    src_host = F.col("user_id") % HOSTS
    dst_host = k % HOSTS
    et = F.col("event_type")
    ip_proto = (F.when(et.isin("click", "view"), F.lit(6)).when(et == "signup", F.lit(17))
                .when(et == "purchase", F.lit(1)).cast("int"))
    ts_us = epoch_micros("ts")
    protocols = (F.when(et == "click", F.lit("eth:ethertype:ip:tcp"))
                 .when(et == "view", F.lit("eth:ethertype:ip:tcp:http"))
                 .when(et == "signup", F.lit("eth:ethertype:ip:udp:dns"))
                 .when(et == "purchase", F.lit("eth:ethertype:ip:icmp"))
                 .otherwise(F.lit("eth:ethertype:arp")))
    hexs = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    floor_v = F.floor(F.col("value")).cast("long")
    return ev.select(
        F.lit("events").alias("capture_id"),
        F.col("event_id").alias("seq"),
        ts_us.alias("ts_us"),
        (ts_us / F.lit(US_PER_HOUR)).alias("t"),
        ip_proto.isNotNull().alias("accepted"),
        F.concat(F.lit("02:00:00:00:00:"), F.lpad(src_host.cast("string"), 2, "0")).alias("eth_src"),
        F.concat(F.lit("02:00:00:00:00:"), F.lpad(dst_host.cast("string"), 2, "0")).alias("eth_dst"),
        F.when(ip_proto.isNotNull(), F.concat(F.lit("10.0.0."), src_host.cast("string"))).alias("src_ip"),
        F.when(ip_proto.isNotNull(), F.concat(F.lit("10.0.0."), dst_host.cast("string"))).alias("dst_ip"),
        ip_proto.alias("ip_proto"),
        (BASE_PORT + F.col("user_id") % PORTS).cast("int").alias("src_port"),
        (BASE_PORT + k % PORTS).cast("int").alias("dst_port"),
        F.col("value").cast("double").alias("frame_len"),
        (floor_v + 20).alias("ip_len"),
        F.upper(et).alias("highest_layer"),
        protocols.alias("frame_protocols"),
        hexs((k % 4) * 8192).alias("ip_flags"),
        floor_v.alias("tcp_len"),
        ((F.col("event_id") * 7919) % 4294967296).alias("tcp_ack"),
        hexs(F.when(k % 3 == 0, F.lit(24)).when(k % 3 == 1, F.lit(16)).otherwise(F.lit(2))).alias("tcp_flags"),
        (1024 + (k % 64) * 16).alias("tcp_window"),
        (floor_v + 8).alias("udp_len"),
        (k % 16).alias("icmp_type"),
    )


def packets_from_events_sql() -> str:
    """DuckDB twin of ``packets_from_events`` (numeric flags directly)."""
    return f"""
    SELECT 'events' AS capture_id, event_id AS seq, epoch_us(ts) AS ts_us,
           epoch_us(ts) / {US_PER_HOUR!r} AS t,
           (event_type <> 'error') AS accepted,
           '02:00:00:00:00:' || lpad(CAST(user_id % {HOSTS} AS VARCHAR), 2, '0') AS eth_src,
           '02:00:00:00:00:' || lpad(CAST(CAST(json_extract(props, '$.k') AS BIGINT) % {HOSTS} AS VARCHAR), 2, '0') AS eth_dst,
           CASE WHEN event_type <> 'error' THEN '10.0.0.' || CAST(user_id % {HOSTS} AS VARCHAR) END AS src_ip,
           CASE WHEN event_type <> 'error' THEN '10.0.0.' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) % {HOSTS} AS VARCHAR) END AS dst_ip,
           CASE WHEN event_type IN ('click', 'view') THEN 6 WHEN event_type = 'signup' THEN 17
                WHEN event_type = 'purchase' THEN 1 END AS ip_proto,
           CAST({BASE_PORT} + user_id % {PORTS} AS INTEGER) AS src_port,
           CAST({BASE_PORT} + CAST(json_extract(props, '$.k') AS BIGINT) % {PORTS} AS INTEGER) AS dst_port,
           CAST(value AS DOUBLE) AS frame_len,
           CAST(floor(value) AS BIGINT) + 20 AS ip_len,
           upper(event_type) AS highest_layer,
           CASE event_type WHEN 'click' THEN 'eth:ethertype:ip:tcp' WHEN 'view' THEN 'eth:ethertype:ip:tcp:http'
                WHEN 'signup' THEN 'eth:ethertype:ip:udp:dns' WHEN 'purchase' THEN 'eth:ethertype:ip:icmp'
                ELSE 'eth:ethertype:arp' END AS frame_protocols,
           (CAST(json_extract(props, '$.k') AS BIGINT) % 4) * 8192 AS ip_flags_n,
           CAST(floor(value) AS BIGINT) AS tcp_len,
           (event_id * 7919) % 4294967296 AS tcp_ack,
           CASE CAST(json_extract(props, '$.k') AS BIGINT) % 3 WHEN 0 THEN 24 WHEN 1 THEN 16 ELSE 2 END AS tcp_flags_n,
           1024 + (CAST(json_extract(props, '$.k') AS BIGINT) % 64) * 16 AS tcp_window,
           CAST(floor(value) AS BIGINT) + 8 AS udp_len,
           CAST(json_extract(props, '$.k') AS BIGINT) % 16 AS icmp_type
    FROM events"""


def label_pairs(spark: SparkSession, attackers=ATTACKERS, victims=VICTIMS, label: int = 1) -> DataFrame:
    """Attacker/victim pairs in both directions (J2 for explicit host lists).

    The lists are parameters (a handful of hosts), so the pair table is
    bounded by len(attackers)*len(victims)*2 rows.
    """
    rows = {}
    for a in attackers:
        for v in victims:
            rows.setdefault((a, v), label)
            rows.setdefault((v, a), label)
    return spark.createDataFrame([(s, d, int(lab)) for (s, d), lab in rows.items()],
                                 "src string, dst string, label int")


def label_pairs_sql(attackers=ATTACKERS, victims=VICTIMS, label: int = 1) -> str:
    vals = []
    seen = set()
    for a in attackers:
        for v in victims:
            for s, d in ((a, v), (v, a)):
                if (s, d) not in seen:
                    seen.add((s, d))
                    vals.append(f"('{s}', '{d}', {label})")
    return "SELECT * FROM (VALUES " + ", ".join(vals) + ") AS t(src, dst, label)"


def flow_features(packets: DataFrame) -> DataFrame:
    """Packet rows -> 5-tuple plus the 11 catalogue-A features (P1-P6), as
    expressions of the packet alone. The highest-layer hash and the protocol
    bitmask are kept as the text they come from (``hl``, ``fp``) until
    ``finish_features`` is applied, usually to the few packets per fragment
    that are stored."""
    tr = P.transport_columns(F.col("ip_proto"), F.col("src_port"), F.col("dst_port"), F.col("tcp_len"),
                             F.col("tcp_ack"), F.col("tcp_flags"), F.col("tcp_window"), F.col("udp_len"),
                             F.col("icmp_type"))
    return packets.select(
        "capture_id", "seq", "ts_us", "accepted",
        P.five_tuple(F.col("src_ip"), tr["sport"], F.col("dst_ip"), tr["dport"], tr["proto"]).alias("id_fwd"),
        F.col("ip_len").cast("double").alias("f1"),
        F.col("highest_layer").alias("hl"), F.col("frame_protocols").alias("fp"),
        P.hex_to_int(F.col("ip_flags")).cast("double").alias("f3"),
        tr["f_tcp_len"].cast("double").alias("f5"),
        tr["f_tcp_ack"].cast("double").alias("f6"),
        tr["f_tcp_flags"].cast("double").alias("f7"),
        tr["f_tcp_window"].cast("double").alias("f8"),
        tr["f_udp_len"].cast("double").alias("f9"),
        tr["f_icmp_type"].cast("double").alias("f10"),
    )


def flow_features_sql(src: str = "pk") -> str:
    """DuckDB twin of ``flow_features`` over the packet CTE ``src``."""
    return f"""
    SELECT capture_id, seq, ts_us, accepted,
           src_ip AS fsrc,
           CASE WHEN ip_proto IN (6, 17) THEN src_port ELSE 0 END AS fsport,
           dst_ip AS fdst,
           CASE WHEN ip_proto IN (6, 17) THEN dst_port ELSE 0 END AS fdport,
           CASE WHEN ip_proto IN (1, 6, 17) THEN ip_proto ELSE 0 END AS fproto,
           CAST(ip_len AS DOUBLE) AS f1,
           CAST({P.layer_hash_sql('highest_layer')} AS DOUBLE) AS f2,
           CAST(ip_flags_n AS DOUBLE) AS f3,
           CAST({P.protocol_mask_sql('frame_protocols')} AS DOUBLE) AS f4,
           CAST(CASE WHEN ip_proto = 6 THEN tcp_len ELSE 0 END AS DOUBLE) AS f5,
           CAST(CASE WHEN ip_proto = 6 THEN tcp_ack ELSE 0 END AS DOUBLE) AS f6,
           CAST(CASE WHEN ip_proto = 6 THEN tcp_flags_n ELSE 0 END AS DOUBLE) AS f7,
           CAST(CASE WHEN ip_proto = 6 THEN tcp_window ELSE 0 END AS DOUBLE) AS f8,
           CAST(CASE WHEN ip_proto = 17 THEN udp_len ELSE 0 END AS DOUBLE) AS f9,
           CAST(CASE WHEN ip_proto = 1 THEN icmp_type ELSE 0 END AS DOUBLE) AS f10
    FROM {src}"""


def keyed_values_from_orders(spark: SparkSession, sf_dir: str, keys: int = 50) -> DataFrame:
    """Orders as a keyed value stream with out-of-order and equal instants.

    seq = o_orderkey (unique), t = order date in days, key = customer % keys,
    v = total price.
    """
    o = table(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_custkey") % keys).alias("key"),
        F.col("o_orderkey").alias("seq"),
        (epoch_micros("o_orderdate") / F.lit(86400e6)).alias("t"),
        F.col("o_totalprice").cast("double").alias("v"),
    )


def keyed_values_from_orders_sql(keys: int = 50) -> str:
    return f"""SELECT o_custkey % {keys} AS key, o_orderkey AS seq,
                      epoch_us(o_orderdate) / 86400000000.0 AS t, CAST(o_totalprice AS DOUBLE) AS v
               FROM orders"""
