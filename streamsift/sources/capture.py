"""Capture sources.

* ``read_pcap``: classic pcap files -> packet rows.  ``binaryFile`` gives one
  row per file (path + bytes); ``mapInPandas`` decodes each file's records
  (Ethernet, ARP, IPv4, IPv6, TCP, UDP, ICMP headers only) into the packet
  schema with ``seq`` = record order.  One task per file like the reference
  (one worker per capture); after landing, all later operators are
  parallel inside a capture.  Split very large captures before landing.
* ``read_packet_tsv``: the 19-column tab-separated dissector output.
* ``merge_captures``: concatenation in capture-name order with a global
  sequence computed from per-capture counts (two-phase offsets).
"""

from __future__ import annotations

import os
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prefix import prefix_sum, int_div

PACKET_SCHEMA = T.StructType([
    T.StructField("capture_id", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("ts_us", T.LongType()), T.StructField("frame_len", T.DoubleType()),
    T.StructField("eth_src", T.StringType()), T.StructField("eth_dst", T.StringType()),
    T.StructField("ip_version", T.IntegerType()), T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()), T.StructField("ip_proto", T.IntegerType()),
    T.StructField("ip_len", T.LongType()), T.StructField("ip_flags", T.StringType()),
    T.StructField("src_port", T.IntegerType()), T.StructField("dst_port", T.IntegerType()),
    T.StructField("tcp_len", T.LongType()), T.StructField("tcp_ack", T.LongType()),
    T.StructField("tcp_flags", T.StringType()), T.StructField("tcp_window", T.LongType()),
    T.StructField("udp_len", T.LongType()), T.StructField("icmp_type", T.IntegerType()),
    T.StructField("arp_src_ip", T.StringType()), T.StructField("arp_dst_ip", T.StringType()),
    T.StructField("highest_layer", T.StringType()), T.StructField("frame_protocols", T.StringType()),
])

# The 19 dissector fields of the tab-separated packet format.
TSV_FIELDS = ["frame.time_epoch", "frame.len", "eth.src", "eth.dst", "ip.src", "ip.dst", "tcp.srcport",
              "tcp.dstport", "udp.srcport", "udp.dstport", "icmp.type", "icmp.code", "arp.opcode",
              "arp.src.hw_mac", "arp.src.proto_ipv4", "arp.dst.hw_mac", "arp.dst.proto_ipv4", "ipv6.src",
              "ipv6.dst"]


def _mac(b: bytes) -> str:
    return ":".join(f"{x:02x}" for x in b)


def _ip4(b: bytes) -> str:
    return ".".join(str(x) for x in b)


def _ip6(b: bytes) -> str:
    import ipaddress
    return str(ipaddress.IPv6Address(b))


def decode_frame(buf: bytes) -> dict:
    """Header fields of one Ethernet frame (missing -> None)."""
    r = dict.fromkeys(f.name for f in PACKET_SCHEMA.fields)
    if len(buf) < 14:
        return r
    r["eth_dst"], r["eth_src"] = _mac(buf[0:6]), _mac(buf[6:12])
    etype = struct.unpack("!H", buf[12:14])[0]
    off, layers = 14, ["eth", "ethertype"]
    if etype == 0x0806 and len(buf) >= off + 28:
        layers.append("arp")
        r["arp_src_ip"], r["arp_dst_ip"] = _ip4(buf[off + 14:off + 18]), _ip4(buf[off + 24:off + 28])
        r["highest_layer"] = "ARP"
        r["frame_protocols"] = ":".join(layers)
        return r
    proto = None
    if etype == 0x0800 and len(buf) >= off + 20:
        layers.append("ip")
        ihl = (buf[off] & 0x0F) * 4
        r["ip_version"] = 4
        r["ip_len"] = struct.unpack("!H", buf[off + 2:off + 4])[0]
        r["ip_flags"] = "0x%04x" % struct.unpack("!H", buf[off + 6:off + 8])[0]
        proto = buf[off + 9]
        r["src_ip"], r["dst_ip"] = _ip4(buf[off + 12:off + 16]), _ip4(buf[off + 16:off + 20])
        off += ihl
    elif etype == 0x86DD and len(buf) >= off + 40:
        layers.append("ipv6")
        r["ip_version"] = 6
        r["ip_len"] = struct.unpack("!H", buf[off + 4:off + 6])[0] + 40
        proto = buf[off + 6]
        r["src_ip"], r["dst_ip"] = _ip6(buf[off + 8:off + 24]), _ip6(buf[off + 24:off + 40])
        off += 40
    else:
        r["frame_protocols"] = ":".join(layers)
        return r
    r["ip_proto"] = proto
    top = "IP" if r["ip_version"] == 4 else "IPV6"
    if proto == 6 and len(buf) >= off + 20:
        layers.append("tcp")
        sp, dp, _, ack, offflags, win = struct.unpack("!HHIIHH", buf[off:off + 16])
        hdr = (offflags >> 12) * 4
        r.update(src_port=sp, dst_port=dp, tcp_ack=ack, tcp_flags="0x%03x" % (offflags & 0x1FF), tcp_window=win)
        r["tcp_len"] = max(0, (r["ip_len"] or 0) - (off - 14) - hdr) if r["ip_version"] == 4 else max(0, len(buf) - off - hdr)
        top = "TCP" if r["tcp_len"] == 0 else "DATA"
    elif proto == 17 and len(buf) >= off + 8:
        layers.append("udp")
        sp, dp, ln = struct.unpack("!HHH", buf[off:off + 6])
        r.update(src_port=sp, dst_port=dp, udp_len=ln)
        top = "UDP" if ln <= 8 else "DATA"
    elif proto == 1 and len(buf) >= off + 1:
        layers.append("icmp")
        r["icmp_type"] = buf[off]
        top = "ICMP"
    r["highest_layer"] = top
    r["frame_protocols"] = ":".join(layers)
    return r


def decode_pcap(data: bytes, capture_id: str) -> list[dict]:
    """Records of one classic pcap file (both byte orders, µs or ns)."""
    if len(data) < 24:
        return []
    magic = data[:4]
    order = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1),
             b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}.get(magic)
    if order is None:
        raise ValueError(f"{capture_id}: not a classic pcap file")
    end, div = order
    off, seq, rows = 24, 0, []
    while off + 16 <= len(data):
        sec, frac, incl, orig = struct.unpack(end + "IIII", data[off:off + 16])
        frame = data[off + 16:off + 16 + incl]
        off += 16 + incl
        r = decode_frame(frame)
        r["capture_id"], r["seq"] = capture_id, seq
        r["ts_us"] = sec * 1_000_000 + frac // div
        r["frame_len"] = float(orig)
        rows.append(r)
        seq += 1
    return rows


def read_pcap(spark: SparkSession, path: str, pattern: str = "*.pcap") -> DataFrame:
    """Every capture file of a folder -> packet rows (capture order = seq)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                rows = decode_pcap(bytes(content), os.path.basename(p))
                out = pd.DataFrame(rows, columns=[f.name for f in PACKET_SCHEMA.fields])
                for f in PACKET_SCHEMA.fields:
                    if isinstance(f.dataType, (T.IntegerType, T.LongType)):
                        out[f.name] = out[f.name].astype("Int64")
                yield out
    return files.select("path", "content").mapInPandas(run, PACKET_SCHEMA)


def read_packet_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated dissector rows (header skipped), all columns text."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in TSV_FIELDS])
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{f}`"), F.lit("")).alias(f.replace(".", "_")) for f in TSV_FIELDS])


#: Port columns of the packet format.
TSV_PORTS = [f for f in TSV_FIELDS if f.endswith("port")]


def split_packet_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(packet rows as ``read_packet_tsv`` gives them, rejects).

    A reject is (file, line, reason) with the whole line. The first reason that
    holds: ``columns`` (not 19), ``time`` (not a finite number), ``length`` (not
    a whole number of at least 0), ``port`` (given, but not 0 to 65535). Header
    lines, also in the middle of a file, and empty lines are neither. Both
    results come from one parse by built-in expressions; a repeated line is a
    row each time.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    lines = lines.where((F.col("line") != "") & (F.col("line") != "\t".join(TSV_FIELDS)))
    parts = lines.withColumn("part", F.split("line", "\t", -1))

    def column(name: str):
        return F.get("part", F.lit(TSV_FIELDS.index(name)))

    time = column("frame.time_epoch").try_cast("double")
    length = column("frame.len")
    whole = length.rlike("^[0-9]+$") & length.try_cast("long").isNotNull()
    port = F.lit(True)
    for name in TSV_PORTS:
        given = column(name)
        port = port & ((given == "") | (given.rlike("^[0-9]{1,5}$") & F.coalesce(given.try_cast("int") <= 65535, F.lit(False))))
    reason = (F.when(F.size("part") != len(TSV_FIELDS), "columns")
              .when(time.isNull() | F.isnan(time) | (F.abs(time) == float("inf")), "time")
              .when(~whole, "length").when(~port, "port"))
    judged = parts.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull()).select(*[column(f).alias(f.replace(".", "_")) for f in TSV_FIELDS])
    return good, judged.where(F.col("reason").isNotNull()).select("file", "line", "reason")


def load_packet_tsv(spark: SparkSession, path: str, rejects: str) -> DataFrame:
    """The good rows of ``path``; its rejects are added to the table ``rejects``."""
    good, bad = split_packet_tsv(spark, path)
    bad.write.mode("append").parquet(rejects)
    return good


def merge_captures(packets: DataFrame, capture: str = "capture_id", seq: str = "seq",
                   chunk_rows: int = 1 << 20, merged_id: str = "merged") -> DataFrame:
    """S3: one capture from many, ordered by (capture name, seq); the new
    sequence is a two-phase prefix count (no single-partition window)."""
    d = packets.withColumn("_one", F.lit(1)).withColumn("_g", F.lit(0))
    # (capture, seq chunk) keeps the order monotone across captures
    bucket = F.struct(F.col(capture).alias("c"), int_div(seq, chunk_rows).alias("k"))
    d = prefix_sum(d, ["_g"], [capture, seq], "_one", "_new", bucket)
    return (d.withColumn("source_capture", F.col(capture)).withColumn("source_seq", F.col(seq))
            .withColumn(capture, F.lit(merged_id)).withColumn(seq, F.col("_new").cast("long"))
            .drop("_one", "_g", "_new"))
