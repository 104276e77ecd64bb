import struct

from pyspark.sql import functions as F

from streamsift.sources.capture import decode_frame, load_packet_tsv, read_packet_tsv, read_pcap, split_packet_tsv, TSV_FIELDS


def _eth(src, dst, etype):
    return bytes.fromhex(dst.replace(":", "")) + bytes.fromhex(src.replace(":", "")) + struct.pack("!H", etype)


def _ipv4(src, dst, proto, payload_len, flags=0x4000):
    ip = lambda s: bytes(int(x) for x in s.split("."))
    return struct.pack("!BBHHHBBH", 0x45, 0, 20 + payload_len, 1, flags, 64, proto, 0) + ip(src) + ip(dst)


def _tcp(sp, dp, ack, flags, win, payload=b""):
    return struct.pack("!HHIIHHHH", sp, dp, 0, ack, (5 << 12) | flags, win, 0, 0) + payload


def _pcap(frames):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for ts_us, f in frames:
        out += struct.pack("<IIII", ts_us // 1_000_000, ts_us % 1_000_000, len(f), len(f)) + f
    return out


def test_decode_tcp_udp_arp():
    tcp = _eth("02:00:00:00:00:01", "02:00:00:00:00:02", 0x0800) + _ipv4("10.0.0.1", "10.0.0.2", 6, 25) + \
        _tcp(1234, 80, 7, 0x18, 512, b"hello")
    r = decode_frame(tcp)
    assert (r["src_ip"], r["dst_ip"], r["src_port"], r["dst_port"], r["ip_proto"]) == ("10.0.0.1", "10.0.0.2", 1234, 80, 6)
    assert r["tcp_len"] == 5 and r["tcp_flags"] == "0x018" and r["ip_flags"] == "0x4000"
    assert r["frame_protocols"] == "eth:ethertype:ip:tcp"
    udp = _eth("02:00:00:00:00:01", "02:00:00:00:00:02", 0x0800) + _ipv4("10.0.0.1", "10.0.0.3", 17, 12) + \
        struct.pack("!HHHH", 53, 5353, 12, 0) + b"abcd"
    r = decode_frame(udp)
    assert (r["udp_len"], r["src_port"], r["ip_proto"]) == (12, 53, 17)
    arp = _eth("02:00:00:00:00:01", "ff:ff:ff:ff:ff:ff", 0x0806) + bytes(14) + bytes([10, 0, 0, 1]) + bytes(6) + bytes([10, 0, 0, 9])
    r = decode_frame(arp)
    assert r["src_ip"] is None and r["arp_dst_ip"] == "10.0.0.9"


def test_read_pcap_folder(spark, tmp_path):
    f1 = _eth("02:00:00:00:00:01", "02:00:00:00:00:02", 0x0800) + _ipv4("10.0.0.1", "10.0.0.2", 6, 20) + _tcp(1, 2, 3, 2, 4)
    (tmp_path / "a.pcap").write_bytes(_pcap([(1_000_000, f1), (2_500_000, f1)]))
    (tmp_path / "b.pcap").write_bytes(_pcap([(3_000_000, f1)]))
    d = read_pcap(spark, str(tmp_path)).orderBy("capture_id", "seq").collect()
    assert [(r["capture_id"], r["seq"], r["ts_us"]) for r in d] == [("a.pcap", 0, 1_000_000), ("a.pcap", 1, 2_500_000),
                                                                   ("b.pcap", 0, 3_000_000)]


def test_read_tsv(spark, tmp_path):
    p = tmp_path / "x.tsv"
    row = ["1.5", "60", "aa", "bb", "10.0.0.1", "10.0.0.2", "80", "1234"] + [""] * 11
    p.write_text("\t".join(TSV_FIELDS) + "\n" + "\t".join(row) + "\n")
    r = read_packet_tsv(spark, str(p)).first()
    assert r["ip_src"] == "10.0.0.1" and r["udp_srcport"] == "" and r["frame_time_epoch"] == "1.5"


def test_tsv_rejects(spark, tmp_path):
    good = ["1.5", "60", "aa", "bb", "10.0.0.1", "10.0.0.2", "80", "65535"] + [""] * 11

    def line(**changes):
        return "\t".join(changes.get(f.replace(".", "_"), v) for f, v in zip(TSV_FIELDS, good))
    header = "\t".join(TSV_FIELDS)
    bad = {"columns": ["garbage", "\t".join(good[:18]), line() + "\t"], "time": [line(frame_time_epoch=v) for v in ("", "x", "NaN", "Infinity")],
           "length": [line(frame_len=v) for v in ("", "-1", "1.5", "9" * 30)], "port": [line(tcp_dstport="65536"), line(udp_srcport="-1"), line(tcp_srcport="7" * 40)]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("\n".join([header, line(), "", line(), header, line(eth_src="x" * 1_000_000)] + bad["columns"] + bad["time"]) + "\n")
    (tmp_path / "in" / "b.tsv").write_text("\n".join([header] + bad["length"] + bad["port"]))
    (tmp_path / "in" / "c.tsv").write_text("")
    out = str(tmp_path / "rejects")
    rows = load_packet_tsv(spark, str(tmp_path / "in"), out)
    assert rows.count() == 3 and rows.where("tcp_dstport = '65535' AND udp_srcport = ''").count() == 3
    assert rows.columns == read_packet_tsv(spark, str(tmp_path / "in" / "a.tsv")).columns
    got = sorted((r["reason"], r["line"], r["file"][-5:]) for r in spark.read.parquet(out).collect())
    assert got == sorted((k, v, "a.tsv" if k in ("columns", "time") else "b.tsv") for k, vs in bad.items() for v in vs)
    none, no_rejects = split_packet_tsv(spark, str(tmp_path / "in" / "c.tsv"))
    assert none.count() == 0 and no_rejects.count() == 0
