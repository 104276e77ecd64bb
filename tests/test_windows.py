import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamsift.operators.windows import anchored_windows
from seq_oracles import anchored_starts


def _frames(spark, rows):
    return spark.createDataFrame(rows, "capture_id string, seq long, ts_us long")


def test_fx_windows(spark):
    # ts 0, 10, 10.000001, 21, 20.5 (late), 31.000001 with w = 10 s
    ts = [0, 10_000_000, 10_000_001, 21_000_000, 20_500_000, 31_000_001]
    d = _frames(spark, [("c", i, t) for i, t in enumerate(ts)])
    got = [r["window_start_us"] for r in anchored_windows(d, 10_000_000).orderBy("seq").collect()]
    assert got == [0, 0, 10_000_001, 21_000_000, 21_000_000, 31_000_001]


def test_rejected_frame_anchors(spark):
    # the first frame (rejected later) still anchors the window
    d = spark.createDataFrame([("c", 0, 0, False), ("c", 1, 5_000_000, True), ("c", 2, 11_000_000, True)],
                              "capture_id string, seq long, ts_us long, accepted boolean")
    got = [r["window_start_us"] for r in anchored_windows(d, 10_000_000).orderBy("seq").collect()]
    assert got == [0, 0, 11_000_000]


def test_random_against_loop(spark):
    rnd = random.Random(7)
    rows, exp = [], []
    for cap in ("a", "b"):
        t, ts = 0, []
        for i in range(400):
            t += rnd.choice([1, 2, 3, 50, 700, 2000]) * 1000
            jitter = -rnd.randint(0, 3000) * 1000 if rnd.random() < 0.1 else 0  # late frames
            ts.append(max(0, t + jitter))
        starts = anchored_starts(ts, 5_000_000)
        rows += [(cap, i, x) for i, x in enumerate(ts)]
        exp += [(cap, i, s) for i, s in enumerate(starts)]
    d = _frames(spark, rows)
    got = sorted((r["capture_id"], r["seq"], r["window_start_us"])
                 for r in anchored_windows(d, 5_000_000, segment_rows=20, chunk_rows=64).collect())
    assert got == sorted(exp)


def test_windows_partition_frames(spark):
    d = _frames(spark, [("c", i, i * 1_000_000) for i in range(100)])
    w = anchored_windows(d, 7_000_000)
    assert w.count() == 100
    assert w.where(F.col("window_start_us").isNull()).count() == 0


@pytest.mark.parametrize("width", [7, 60, 5000])
def test_no_group_holds_a_crowded_width(spark, monkeypatch, width):
    """Dense frames, in one burst or throughout: groups stay small and the windows are the same."""
    from streamsift.operators import windows as W
    rng = np.random.default_rng(width)
    ts = np.sort(np.concatenate([rng.integers(0, 4000, 900), rng.integers(1000, 2000, 900)]))
    d = spark.createDataFrame([("c", i, int(t)) for i, t in enumerate(ts)], "capture_id string, seq long, ts_us long")
    sizes = []
    grouped = type(d.groupBy("seq")).applyInPandas

    def spied(self, fn, schema):
        out = grouped(self, fn, schema)
        sizes.append(self._df.groupBy("capture_id", "seg").count().agg(F.max("count")).first()[0] or 0)
        return out
    monkeypatch.setattr(type(d.groupBy("seq")), "applyInPandas", spied)
    got = {r["seq"]: r["window_start_us"] for r in W.anchored_windows(d, width, segment_rows=50).collect()}
    start, want = None, {}
    for i, t in enumerate(ts):
        start = int(t) if start is None or t > start + width else start
        want[i] = start
    assert got == want and sizes and max(sizes) <= W.CROWDED * 50
