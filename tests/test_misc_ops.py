import numpy as np
import pytest
from pyspark.sql import functions as F

from streamsift.functions import packet as P
from streamsift.operators import decay as DC
from streamsift.operators import detector as DT
from streamsift.operators import metrics as MT
from streamsift.operators import prefix as PX


def test_minmax_normaliser_and_running(spark):
    rng = np.random.RandomState(5)
    x = rng.rand(40, 3)
    d = DT.with_rank(spark.createDataFrame([(i, x[i].tolist()) for i in range(40)], "seq long, x array<double>"),
                     chunk_rows=9)
    b = {r["j"]: (r["min"], r["max"]) for r in DT.minmax_fit(d, 10, 30).collect()}
    assert np.allclose([b[j][0] for j in range(3)], x[10:30].min(axis=0))
    t = {r["seq"]: r["x"] for r in DT.minmax_transform(d, DT.minmax_fit(d, 10, 30)).collect()}
    lo, hi = x[10:30].min(axis=0), x[10:30].max(axis=0)
    assert np.allclose(t[0], (x[0] - lo) / (hi - lo + 1e-16))
    run = {r["rank"]: r["x"] for r in DT.running_minmax_transform(d, chunk_rows=9).collect()}
    for i in (0, 5, 39):
        lo, hi = x[:i + 1].min(axis=0), x[:i + 1].max(axis=0)
        assert np.allclose(run[i], (x[i] - lo) / (hi - lo + 1e-16))


def test_rolling_mean_zero_start(spark):
    d = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([3, 6, 9, 12])], "k string, seq long, v double")
    got = [r["rollmean"] for r in DC.rolling_mean(d, 3, ["k"]).orderBy("seq").collect()]
    assert got == [1.0, 3.0, 6.0, 9.0]


def test_latest_state_eviction_and_nd(spark):
    rows = [("a", 0, 0.0, 1.0), ("a", 1, 1.0, 3.0), ("b", 2, 0.0, 5.0)]
    d = spark.createDataFrame(rows, "k string, seq long, t double, v double")
    st = DC.decayed_stats_1d(d, ["k"], lambdas=[1.0])
    last = DC.latest_state(st, ["k", "lam"])
    assert {r["k"]: r["seq"] for r in last.collect()} == {"a": 1, "b": 2}
    kept = DC.evict_old_streams(last, 0.5, now=1.5).collect()
    # b was last seen at t=0 with weight 1 -> 2^-1.5 < 0.5 at now=1.5; a keeps weight > 0.5
    assert [r["k"] for r in kept] == ["a"]
    nd = DC.nd_stats(last.withColumn("g", F.lit(1)), ["g"]).first()
    assert nd["radius"] >= 0 and nd["magnitude"] > 0


def test_rolling_mean_of_a_hot_stream(spark):
    """Half a million rows of one stream in chunks, with gaps in seq."""
    d = spark.range(500_000).select(F.lit("k").alias("k"), (F.col("id") * 3).alias("seq"), (F.col("id") % 101).cast("double").alias("v"))
    got = {r["seq"]: r["rollmean"] for r in DC.rolling_mean(d, 7, ["k"], chunk_rows=20_000).where("seq % 1497 = 0 or seq % 60000 < 30").collect()}
    v = np.arange(500_000) % 101
    cum = np.concatenate([[0], np.cumsum(v)])
    for s_, x in got.items():
        i = s_ // 3 + 1
        assert x == (cum[i] - cum[max(0, i - 7)]) / 7
    small = spark.createDataFrame([(k, i, float(i * i % 11)) for k in "ab" for i in range(40)], "k string, seq long, v double")
    a, b = ({(r["k"], r["seq"]): r["rollmean"] for r in DC.rolling_mean(small, 3, ["k"], chunk_rows=c).collect()} for c in (1, 1 << 15))
    assert a == b and len(a) == 80


def plain_histogram(rows, lo, hi, bins, lam, window=0):
    """Weights bin by bin; the tallest at the time of the row."""
    w, last, out, now = [0.0] * bins, [0.0] * bins, {}, -np.inf
    for seq, t, v in rows:
        now = max(now, t)
        k = int(np.floor((v - lo) / ((hi - lo) / bins)))
        if not 0 <= k < bins:
            out[seq] = np.inf
            continue
        if w[k] and t > last[k]:
            w[k] *= 2 ** (-lam * (t - last[k]))
        last[k] = max(t, last[k]) if w[k] else t
        w[k] += 1
        at = [x * 2 ** (-lam * (now - y)) if x else 0.0 for x, y in zip(w, last)]
        out[seq] = np.log(max(at) / np.mean(at[max(0, k - window):k + window + 1]))
    return out


@pytest.mark.parametrize("window", [0, 1])
def test_histogram_scores(spark, window):
    """Late rows, values on the bounds and outside, small chunks."""
    rng = np.random.default_rng(window)
    rows = [(i, float(i / 4 - (3 if i % 5 == 0 else 0)), float(v)) for i, v in enumerate(rng.normal(5, 3, 300))] + [(300, 80.0, 0.0), (301, 80.0, 10.0)]
    d = spark.createDataFrame([("s", *r) for r in rows], "k string, seq long, t double, v double")
    for lam in (0.01, 1.0):
        got = {r["seq"]: r["score"] for r in DC.histogram_score(d, ["k"], 5, 0.0, 10.0, window=window, lambdas=[lam]).collect()}
        want = plain_histogram(rows, 0.0, 10.0, 5, lam, window)
        assert got.keys() == want.keys() and got[301] == np.inf
        assert all(got[s] == want[s] or abs(got[s] - want[s]) < 1e-9 for s in want)
    learned = DC.histogram_score(d, ["k"], 5, grace=50, lambdas=[1.0]).orderBy("seq").collect()
    assert [r["score"] for r in learned[:50]] == [0.0] * 50 and learned[60]["score"] >= 0 and learned[60]["bin"] is not None
    flat = DC.histogram_score(d.withColumn("v", F.lit(1.0)), ["k"], 5, grace=50, lambdas=[1.0])
    assert flat.where("score != 0 or bin is not null").count() == 0


def test_last_known_in_small_chunks(spark):
    d = spark.createDataFrame([("a", i, i if i % 5 == 2 else None) for i in range(40)] + [("b", 3, 9)], "k string, seq long, v long")
    got = {(r["k"], r["seq"]): r["p"] for r in PX.last_known(d, ["k"], "seq", {"p": F.col("v")}, chunk_rows=3).collect()}
    assert all(got["a", i] == max([j for j in range(i) if j % 5 == 2], default=None) for i in range(40)) and got["b", 3] is None


def test_numbered_places(spark):
    d = spark.createDataFrame([("a" if i % 4 else "b", i * 7 % 1000) for i in range(1000)], "g string, x long").repartition(6)
    got = [(r["g"], r["x"], r["n"]) for r in PX.numbered(d, ["g"], ["x"], "n").collect()]
    for g in "ab":
        mine = sorted((x, n) for h, x, n in got if h == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1)) and len(mine) in (250, 750)


def test_extrapolated_cov_rules(spark):
    """0 without points, the only value, lines, parabolas, far rows and equal times."""
    pts = [(0, False, 0.0, 1.0), (1, True, 1.0, 5.0), (2, False, 2.0, 3.0), (3, True, 2.5, 6.0), (4, False, 3.0, 7.0), (5, True, 3.5, 4.0),
           (6, False, 3.0, 2.0), (7, True, 4.0, 4.5), (8, True, 200.0, 9.0)]
    d = spark.createDataFrame([("p", *r) for r in pts], "pair string, seq long, side boolean, t double, v double")
    x = {1: 1.0, 2: 5.0, 3: 3.5, 4: 5 + 2 / 1.5, 7: 2.0, 8: 2.0}
    x[5] = np.polyval(np.polyfit([0, 2, 3], [1, 3, 7], 2), 3.5)
    x[6] = np.polyval(np.polyfit([1, 2.5, 3.5], [5, 6, 4], 2), 3.0)
    own = {(r["side"], r["seq"]): r["mean"] for r in DC.decayed_stats_1d(d, ["pair", "side"], [0.5]).join(d.select("seq", "side"), ["seq", "side"]).collect()}
    cf, w, last, want = 0.0, 0.0, None, {}
    for seq, side, t, v in pts:
        f = 1.0 if last is None or t <= last else 2 ** (-0.5 * (t - last))
        last = t if last is None else max(t, last)
        other = max([s for s, o, *_ in pts if o != side and s < seq], default=None)
        r = 0.0 if other is None else (v - own[side, seq]) * (x[seq] - own[not side, other])
        cf, w = cf * f + r, w * f + 1
        want[seq] = cf / w
    got = {r["seq"]: r["cov"] for r in DC.extrapolated_cov(d, ["pair"], "side", [0.5]).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_stream_identity_rules(spark):
    cols = ["ip4s", "ip4d", "ip6s", "ip6d", "ts", "td", "us", "ud", "es", "ed", "arp", "aps", "apd", "icmp"]
    rows = [("1.1.1.1", "2.2.2.2", "", "", "80", "90", "", "", "m1", "m2", "", "", "", ""),
            ("", "", "fe80::1", "fe80::2", "", "", "53", "54", "m1", "m2", "", "", "", ""),
            ("", "", "", "", "", "", "", "", "m1", "m2", "1", "3.3.3.3", "4.4.4.4", ""),
            ("1.1.1.1", "2.2.2.2", "", "", "", "", "", "", "m1", "m2", "", "", "", "8"),
            ("", "", "", "", "", "", "", "", "m1", "m2", "", "", "", "")]
    d = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    ident = P.stream_identity(*[F.col(c) for c in cols])
    got = [tuple(r) for r in d.select(ident["ip_type"], ident["src_ip"], ident["dst_ip"], ident["src_proto"],
                                       ident["dst_proto"]).collect()]
    assert got == [(0, "1.1.1.1", "2.2.2.2", "80", "90"), (1, "fe80::1", "fe80::2", "53", "54"),
                   (0, "3.3.3.3", "4.4.4.4", "arp", "arp"), (0, "1.1.1.1", "2.2.2.2", "icmp", "icmp"),
                   (None, "m1", "m2", "", "")]


def test_distance_groups_grow_with_the_tasks_not_the_blocks():
    """Copies of a side are its rows times the other side's groups."""
    for n, m in ((108_000, 12_000), (648_000, 72_000), (12_000, 108_000)):
        nq, nr = MT._groups((n, 64), (m, 64), 100, 12)
        assert n * nr + m * nq < 4 * (n + m) + 48 * min(n, m) and -(-n // nq) * 64 <= 2 * MT.GROUP_VALUES and -(-m // nr) * 64 <= 2 * MT.GROUP_VALUES
    assert MT._groups((30, 64), (0, 1), 100, 12) == (1, 1) and MT._groups((0, 1), (30, 64), 100, 12) == (1, 1)


def test_distances_do_not_depend_on_the_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(90, 4)), rng.normal(size=(40, 4))
    q, r = (spark.createDataFrame([(i, [float(k) for k in v]) for i, v in enumerate(m)], "id long, v array<double>") for m in (x, y))
    d = np.sqrt(((x[:, None, :] - y[None]) ** 2).sum(axis=2))
    for values, block in ((1 << 22, 7), (64, 1000)):
        monkeypatch.setattr(MT, "GROUP_VALUES", values)
        got = {k["id"]: (k["min_dist"], k["max_dist"]) for k in MT.reference_distances(q, r, "id", "v", block_rows=block).collect()}
        assert len(got) == 90 and all(abs(got[i][0] - d[i].min()) < 1e-12 and abs(got[i][1] - d[i].max()) < 1e-12 for i in range(90))


def test_histogram_joins_no_row_by_its_stream_alone(spark, monkeypatch):
    """A join on the stream alone would put it into one task."""
    on, join = [], type(spark.range(1)).join
    monkeypatch.setattr(type(spark.range(1)), "join", lambda self, other, by=None, how="inner": on.append(by) or join(self, other, by, how))
    d = spark.createDataFrame([("s", i, i / 4, float(i % 10)) for i in range(40)], "k string, seq long, t double, v double")
    assert DC.histogram_score(d, ["k"], 5, 0.0, 10.0, window=1, lambdas=[1.0]).count() == 40
    assert on and ["k"] not in on
