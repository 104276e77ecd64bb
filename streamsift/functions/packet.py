"""Per-packet column expressions (flow identity, hashed layers, bitmasks).

Everything here is a plain Catalyst expression, so it stays inside
whole-stage code generation next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference for identical features:
# protocol vocabulary (bit i = 2**i, in this order), IP protocol numbers,
# the modulus of the highest-layer hash and the nominal feature bounds.
PROTOCOL_VOCABULARY = ["arp", "data", "dns", "ftp", "http", "icmp", "ip", "ssdp", "ssl", "telnet", "tcp", "udp"]
IPPROTO_ICMP = 1
IPPROTO_TCP = 6
IPPROTO_UDP = 17
LAYER_HASH_MODULUS = 10 ** 8

# Catalogue A: packet features of a fragment row, with nominal [min, max];
# the timestamp maximum is replaced by the time window.
FEATURES_A = [
    ("timestamp", 0, 10),
    ("packet_length", 0, 1 << 16),
    ("highest_layer", 0, 1 << 32),
    ("IP_flags", 0, 1 << 16),
    ("protocols", 0, 1 << len(PROTOCOL_VOCABULARY)),
    ("TCP_length", 0, 1 << 16),
    ("TCP_ack", 0, 1 << 32),
    ("TCP_flags", 0, 1 << 16),
    ("TCP_window_size", 0, 1 << 16),
    ("UDP_length", 0, 1 << 16),
    ("ICMP_type", 0, 1 << 8),
]

# Catalogue B (21 flow-vector features); "n" marks a bound equal to the
# maximum flow length, "t" the time window.  Packets is fixed at [0, 10].
FEATURES_B = [
    ("timestamp", 0, "t"),
    ("packet_length", 0, 1 << 16),
    ("IP_flags_df", 0, "n"),
    ("IP_flags_mf", 0, "n"),
    ("IP_flags_rb", 0, "n"),
    ("IP_frag_off", 0, 1 << 13),
    ("protocols", 0, 1 << len(PROTOCOL_VOCABULARY)),
    ("TCP_length", 0, 1 << 16),
    ("TCP_flags_ack", 0, "n"),
    ("TCP_flags_cwr", 0, "n"),
    ("TCP_flags_ece", 0, "n"),
    ("TCP_flags_fin", 0, "n"),
    ("TCP_flags_push", 0, "n"),
    ("TCP_flags_res", 0, "n"),
    ("TCP_flags_reset", 0, "n"),
    ("TCP_flags_syn", 0, "n"),
    ("TCP_flags_urg", 0, "n"),
    ("TCP_window_size", 0, 1 << 16),
    ("UDP_length", 0, 1 << 16),
    ("ICMP_type", 0, 1 << 8),
    ("Packets", 0, 10),
]


def feature_bounds_a(time_window: float) -> tuple[list[float], list[float]]:
    mins = [float(lo) for _, lo, _ in FEATURES_A]
    maxs = [float(hi) for _, _, hi in FEATURES_A]
    maxs[0] = float(time_window)
    return mins, maxs


def feature_bounds_b(time_window: float, max_flow_len: int) -> tuple[list[float], list[float]]:
    mins, maxs = [], []
    for _, lo, hi in FEATURES_B:
        mins.append(float(lo))
        maxs.append(float(time_window if hi == "t" else max_flow_len if hi == "n" else hi))
    return mins, maxs


def layer_hash(name: Column) -> Column:
    """int(sha256(name), 16) mod 1e8, via a Horner fold over the eight 32-bit
    hex chunks of the digest (unrolled, so it stays in generated code)."""
    return layer_hash_from_digest(F.sha2(name.cast("string"), 256))


def layer_hash_from_digest(h: Column) -> Column:
    """The fold on a precomputed hex digest.  Give the digest its own column
    first when hashing many rows: Spark then keeps one digest per row
    instead of inlining it into all eight chunks."""
    mod = F.lit(LAYER_HASH_MODULUS).cast("long")
    acc = F.lit(0).cast("long")
    for i in range(8):
        chunk = F.conv(F.substring(h, i * 8 + 1, 8), 16, 10).cast("long")
        acc = F.pmod(acc * F.lit(4294967296).cast("long") + chunk, mod)
    return acc


def layer_hash_sql(expr: str) -> str:
    """DuckDB twin of ``layer_hash`` (same fold, exact integer arithmetic)."""
    h = f"sha256(CAST({expr} AS VARCHAR))"
    return ("list_reduce([0] || list_transform(range(8), lambda i: "
            f"CAST(('0x' || substr({h}, i * 8 + 1, 8)) AS BIGINT)), "
            "lambda acc, x: (acc * 4294967296 + x) % 100000000)")


def protocol_tokens(frame_protocols: Column) -> Column:
    """Lower-case word tokens of at least two characters."""
    return F.regexp_extract_all(F.lower(frame_protocols), F.lit(r"(?U)\b\w\w+\b"), 0)


def protocol_mask(frame_protocols: Column) -> Column:
    """Presence bitmask of the vocabulary words among the lower-cased tokens."""
    return protocol_mask_from_tokens(protocol_tokens(frame_protocols))


def protocol_mask_from_tokens(tokens: Column) -> Column:
    mask = F.lit(0).cast("long")
    for i, word in enumerate(PROTOCOL_VOCABULARY):
        mask = mask + F.when(F.array_contains(tokens, word), F.lit(1 << i)).otherwise(F.lit(0))
    return mask


def protocol_mask_sql(expr: str) -> str:
    toks = f"string_split_regex(lower({expr}), '[^a-z0-9_]+')"
    parts = [f"(CASE WHEN list_contains({toks}, '{w}') THEN {1 << i} ELSE 0 END)"
             for i, w in enumerate(PROTOCOL_VOCABULARY)]
    return "(" + " + ".join(parts) + ")"


def hex_to_int(text: Column) -> Column:
    """'0x4000' / '4000' -> 16384; empty or null -> 0."""
    digits = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "^0x", "")
    return F.when(digits == "", F.lit(0).cast("long")).otherwise(F.conv(digits, 16, 10).cast("long"))


def five_tuple(src: Column, sport: Column, dst: Column, dport: Column, proto: Column) -> Column:
    return F.struct(src.alias("src"), sport.alias("sport"), dst.alias("dst"),
                    dport.alias("dport"), proto.alias("proto"))


def canonical_tuple(t: Column) -> Column:
    """Direction-free flow key: the smaller (ip, port) endpoint first."""
    a = F.struct(t["src"].alias("ip"), t["sport"].alias("port"))
    b = F.struct(t["dst"].alias("ip"), t["dport"].alias("port"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.struct(lo["ip"].alias("src"), lo["port"].alias("sport"), hi["ip"].alias("dst"),
                    hi["port"].alias("dport"), t["proto"].alias("proto"))


def transport_columns(ip_proto: Column, src_port: Column, dst_port: Column, tcp_len: Column,
                      tcp_ack: Column, tcp_flags: Column, tcp_window: Column, udp_len: Column,
                      icmp_type: Column) -> dict[str, Column]:
    """Transport features and 5-tuple parts by IP protocol.

    TCP: len, ack, flags, window; UDP: length; ICMP: type with ports 0; any
    other protocol: zeros and proto 0.
    """
    is_tcp = ip_proto == IPPROTO_TCP
    is_udp = ip_proto == IPPROTO_UDP
    is_icmp = ip_proto == IPPROTO_ICMP
    zero = F.lit(0).cast("long")
    return {
        "sport": F.when(is_tcp | is_udp, src_port).otherwise(F.lit(0)).cast("int"),
        "dport": F.when(is_tcp | is_udp, dst_port).otherwise(F.lit(0)).cast("int"),
        "proto": F.when(is_tcp | is_udp | is_icmp, ip_proto).otherwise(F.lit(0)).cast("int"),
        "f_tcp_len": F.when(is_tcp, tcp_len.cast("long")).otherwise(zero),
        "f_tcp_ack": F.when(is_tcp, tcp_ack.cast("long")).otherwise(zero),
        "f_tcp_flags": F.when(is_tcp, hex_to_int(tcp_flags)).otherwise(zero),
        "f_tcp_window": F.when(is_tcp, tcp_window.cast("long")).otherwise(zero),
        "f_udp_len": F.when(is_udp, udp_len.cast("long")).otherwise(zero),
        "f_icmp_type": F.when(is_icmp, icmp_type.cast("long")).otherwise(zero),
    }


def subnet(ip_type: Column, ip: Column, mac: Column) -> Column:
    """Direction prefix (P8): IPv4 text before the last dot; IPv6 first half
    (banker's rounding of len/2); otherwise the MAC."""
    v4 = F.regexp_extract(ip, r"^(.*)\.", 1)
    half = F.bround(F.length(ip) / F.lit(2.0), 0).cast("int")
    v6 = F.left(ip, half)
    return F.when(ip_type == 0, v4).when(ip_type == 1, v6).otherwise(mac)


def stream_identity(ipv4_src: Column, ipv4_dst: Column, ipv6_src: Column, ipv6_dst: Column,
                    tcp_sport: Column, tcp_dport: Column, udp_sport: Column, udp_dport: Column,
                    eth_src: Column, eth_dst: Column, arp_opcode: Column, arp_src_ip: Column,
                    arp_dst_ip: Column, icmp_type: Column) -> dict[str, Column]:
    """Statistics-pipeline identity of a parsed packet row.

    All inputs are strings where '' means absent, as in the tab-separated
    dissector output.  Returns ip_type (0 v4, 1 v6, null none), src_ip,
    dst_ip, src_proto, dst_proto.
    """
    e = F.lit("")
    c = lambda x: F.coalesce(x, e)
    has4 = c(ipv4_src) != ""
    has6 = c(ipv6_src) != ""
    src_ip0 = F.when(has4, c(ipv4_src)).when(has6, c(ipv6_src)).otherwise(e)
    dst_ip0 = F.when(has4, c(ipv4_dst)).when(has6, c(ipv6_dst)).otherwise(e)
    ip_type0 = F.when(has4, F.lit(0)).when(has6, F.lit(1))
    sproto0 = F.concat(c(tcp_sport), c(udp_sport))
    dproto0 = F.concat(c(tcp_dport), c(udp_dport))
    no_port = sproto0 == ""
    is_arp = no_port & (c(arp_opcode) != "")
    is_icmp = no_port & ~is_arp & (c(icmp_type) != "")
    is_other = no_port & ~is_arp & ~is_icmp & (F.concat(src_ip0, sproto0, dst_ip0, dproto0) == "")
    return {
        "ip_type": F.when(is_arp | is_icmp, F.lit(0)).otherwise(ip_type0),
        "src_ip": F.when(is_arp, c(arp_src_ip)).when(is_other, c(eth_src)).otherwise(src_ip0),
        "dst_ip": F.when(is_arp, c(arp_dst_ip)).when(is_other, c(eth_dst)).otherwise(dst_ip0),
        "src_proto": F.when(is_arp, F.lit("arp")).when(is_icmp, F.lit("icmp")).otherwise(sproto0),
        "dst_proto": F.when(is_arp, F.lit("arp")).when(is_icmp, F.lit("icmp")).otherwise(dproto0),
    }


def ipv4_to_long(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return (parts[0].cast("long") * 16777216 + parts[1].cast("long") * 65536
            + parts[2].cast("long") * 256 + parts[3].cast("long"))


# TCP flag bits in catalogue-B order (ack, cwr, ece, fin, push, res, reset, syn, urg).
TCP_FLAG_BITS = [("ack", 4), ("cwr", 7), ("ece", 6), ("fin", 0), ("push", 3), ("res", 9),
                 ("reset", 2), ("syn", 1), ("urg", 5)]
