from pyspark.sql import functions as F

from streamsift.functions import packet as P


def test_fx_hash(spark):
    d = spark.createDataFrame([("TCP",), ("DNS",), ("HTTP",), ("DATA",)], "n string")
    got = [r[0] for r in d.select(P.layer_hash(F.col("n"))).collect()]
    assert got == [78354535, 63782488, 11875138, 49489976]


def test_fx_protocols(spark):
    d = spark.createDataFrame([("eth:ethertype:ip:tcp:ssl:ssl",), ("eth:ethertype:arp",), ("eth:ethertype:ip:tcp:tls",)],
                              "p string")
    got = [r[0] for r in d.select(P.protocol_mask(F.col("p"))).collect()]
    assert got == [64 + 256 + 1024, 1, 64 + 1024]


def test_hex_and_flags(spark):
    d = spark.createDataFrame([("0x4000",), ("0x0018",), ("",)], "h string")
    assert [r[0] for r in d.select(P.hex_to_int(F.col("h"))).collect()] == [16384, 24, 0]


def test_canonical_and_transport(spark):
    d = spark.createDataFrame([("10.0.0.2", 80, "10.0.0.1", 1234, 6), ("10.0.0.1", 1234, "10.0.0.2", 80, 6)],
                              "s string, sp int, d string, dp int, pr int")
    t = P.five_tuple(F.col("s"), F.col("sp"), F.col("d"), F.col("dp"), F.col("pr"))
    keys = [r[0] for r in d.select(P.canonical_tuple(t)).collect()]
    assert keys[0] == keys[1]
    tr = P.transport_columns(F.lit(2), F.lit(5), F.lit(6), F.lit(1), F.lit(1), F.lit("0x1"), F.lit(1), F.lit(1), F.lit(1))
    r = spark.range(1).select(tr["proto"], tr["sport"], tr["f_tcp_len"]).first()
    assert tuple(r) == (0, 0, 0)


def test_subnet(spark):
    d = spark.createDataFrame([(0, "192.168.1.7", "m"), (1, "fe80::1:2", "m"), (None, "", "aa:bb")],
                              "t int, ip string, mac string")
    got = [r[0] for r in d.select(P.subnet(F.col("t"), F.col("ip"), F.col("mac"))).collect()]
    assert got == ["192.168.1", "fe80", "aa:bb"]
