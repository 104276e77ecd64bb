import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from streamsift.operators import metrics as MT
from streamsift.operators import training as TR
from streamsift.sources import sinks as SK

NETS = [TR.DenseNet(6, (5, 3)), TR.ConvNet(6, 1, 3), TR.ConvNet(3, 2, 4, "same", 2)]


@pytest.mark.parametrize("net", NETS)
@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_gradients_match_differences(net, dropout):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(9, 6)), (rng.random(9) > 0.5) * 1.0
    flat = net.start(2) + 0.1 * rng.normal(size=net.size)
    mask = (TR.draw(np.arange(9), np.arange(net.cells), 1, 4) >= dropout) / (1 - dropout)
    got, _ = net.gradient(flat, x, y, mask)
    want = [(net.gradient(flat + e, x, y, mask)[1] - net.gradient(flat - e, x, y, mask)[1]) / 2e-6 for e in 1e-6 * np.eye(net.size)]
    assert np.allclose(got, want, atol=1e-6)
    assert net.penalised().size == net.start(1).size == net.size


def test_draws_are_even_and_free_of_rows_and_epochs():
    d = TR.draw(np.arange(-500, 4500), np.arange(20), 1, 1)
    assert d.min() >= 0 and d.max() < 1 and abs(d.mean() - 0.5) < 0.01
    assert abs((d < 0.2).mean(axis=0) - 0.2).max() < 0.03
    assert abs(np.corrcoef(d[:, 0], d[:, 1])[0, 1]) < 0.05
    assert abs(np.corrcoef(d[:, 0], TR.draw(np.arange(-500, 4500), np.arange(1), 1, 2)[:, 0])[0, 1]) < 0.05
    folds = TR.folds_of(np.arange(3000), 3, 1)
    assert sorted(set(folds)) == [0, 1, 2] and np.bincount(folds).min() > 900


def rows_of(spark, n=600, parts=3):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 6))
    y = (x[:, 0] * x[:, 1] > 0) * 1.0
    d = spark.createDataFrame([(i, r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y))], "key long, x array<double>, y double")
    return d.repartition(parts, "key"), x, y


def test_one_epoch_equals_replicas_by_hand(spark):
    """Every task is a replica; the result is the mean weighted by rows."""
    d, x, y = rows_of(spark)
    c = TR.Candidate(TR.DenseNet(6, (4,)), 0.02, "adam", 64, 0.2, 0.001, 0.002, seed=7)
    start = TR.State.fresh(c.net.start(7))
    (got, loss, n), = TR.averaged_epoch(d, [(c, start)], 3)
    tasks = d.select("key").withColumn("p", F.spark_partition_id()).toPandas()
    flats, weights, steps = [], [], []
    for _, keys in tasks.groupby("p")["key"]:
        keys = keys.to_numpy()
        s = start
        for at in range(0, len(keys), 64):
            k = keys[at:at + 64]
            k = k[np.argsort(TR.draw(k, np.array([-2]), 0, 3)[:, 0])]
            s, _ = TR.step(c, s, k, x[k], y[k], 3)
        flats.append(s.flat)
        weights.append(len(keys))
        steps.append(s.steps)
    assert n == 600 and np.allclose(got.flat, np.average(flats, axis=0, weights=weights), atol=1e-12)
    assert abs(got.steps - np.average(steps, weights=weights)) < 1e-9
    again = TR.averaged_epoch(d, [(c, start)], 3)[0][0]
    assert np.allclose(again.flat, got.flat, atol=1e-12)


def test_candidates_side_by_side_equal_alone(spark):
    d, _, _ = rows_of(spark)
    cs = [TR.Candidate(TR.DenseNet(6, (8,)), 0.01, batch=50), TR.Candidate(TR.DenseNet(6, (4, 4)), 0.05, "sgd", 25, fold=1, folds=3)]
    both = TR.fit(d, None, cs, epochs=3)
    alone = [TR.fit(d, None, [c], epochs=3)[0] for c in cs]
    for a, b in zip(both[:1], alone[:1]):
        assert np.allclose(a.state.flat, b.state.flat, atol=1e-9)
    assert both[1].history[0][1] == pytest.approx(alone[1].history[0][1], rel=0.1)


def test_search_learns_stops_and_stores(spark, tmp_path):
    d, _, _ = rows_of(spark, 1200)
    train, val = d.where("key % 4 > 0"), d.where("key % 4 = 0")
    settings = TR.grid(rate=[0.05, 0.0], units=[12])
    best, table = TR.search(train, val, lambda rate, units: TR.Candidate(TR.DenseNet(6, (units, units)), rate, batch=32), settings,
                            folds=2, epochs=25, patience=3)
    assert best.candidate.rate == 0.05 and table[0]["accuracy"] > 0.8 > table[1]["accuracy"]
    assert table[1]["epochs"] == 4                      # a rate of zero waits for its patience and leaves
    assert best.candidate.fold is None and TR.evaluate(val, [(best.candidate, best.state)])[0]["accuracy"] > 0.8
    assert best.best == min(h[2] for h in best.history)
    path = str(tmp_path / "net")
    for net in [best.candidate.net, TR.ConvNet(3, 2, 4, "same", 2)]:
        flat = net.start(1)
        TR.save_network(spark, net, flat, path)
        again, params = TR.load_network(spark, path)
        assert again == net and np.array_equal(params, flat)
    p = TR.predict(val, best.candidate.net, best.state.flat, ["key", "y"])
    r = MT.validation_report(p, "m", {"b": 1, "a": "x,y"}, "set", label="y")
    assert r.first()["samples"] == val.count() and r.first()["parameters"] == '{"a": "x,y", "b": 1}'
    out = str(tmp_path / "report")
    SK.write_validation_report(r, out)
    back = spark.read.option("header", True).option("escape", '"').csv(out).first().asDict()
    assert list(back) == MT.VALIDATION_HEADER and back["Hyper-parameters"] == '{"a": "x,y", "b": 1}'


def test_random_settings_are_distinct():
    every = TR.grid(a=[1, 2, 3], b=["u", "v"])
    got = TR.random_settings(4, 9, a=[1, 2, 3], b=["u", "v"])
    assert len(every) == 6 and len({tuple(g.items()) for g in got}) == 4 and all(g in every for g in got)
    assert TR.random_settings(4, 9, a=[1, 2, 3], b=["u", "v"]) == got and TR.random_settings(99, 9, a=[1]) == [{"a": 1}]


def test_empty_tables_null_keys_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "key long, x array<double>, y double")
    c = TR.Candidate(TR.DenseNet(2, (2,)))
    f, = TR.fit(empty, empty, [c], epochs=3)
    assert np.array_equal(f.state.flat, c.net.start(1)) and len(f.history) == 1
    assert TR.predict(empty, c.net, c.net.start(1), ["key"]).count() == 0
    d = spark.createDataFrame([(None, [1.0, 0.0], 1.0), (0, [1.0, 0.0], 1.0), (0, [1.0, 0.0], 1.0)], "key long, x array<double>, y double")
    f, = TR.fit(d, None, [TR.Candidate(TR.DenseNet(2, (2,)), dropout=0.5)], epochs=2)
    assert np.isfinite(f.state.flat).all() and TR.evaluate(d, [(c, f.state)])[0]["n"] == 3


def test_covariance_and_share(spark):
    from streamsift.operators import reduce as RD
    x = np.random.default_rng(3).normal(size=(200, 4)) * [5, 3, 1, 0.1] + 1000
    d = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    want = np.cov(x.T)
    assert np.allclose(RD.covariance(d), want, rtol=1e-9, atol=1e-9)
    shares = np.cumsum(np.sort(np.linalg.eigvalsh(want))[::-1]) / np.trace(want)
    for share in (0.5, 0.8, 0.9, 0.9999):
        assert RD.pca_to_share(d, share)[1] == int(np.searchsorted(shares, share)) + 1
    assert np.isnan(RD.covariance(d.limit(1))).all()


def test_candidates_share_their_draws(spark, monkeypatch):
    """Four candidates of one size draw a block's dropout once a block; states equal those trained alone."""
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0, float(i % 3)], float(i % 2)) for i in range(50)], "key long, x array<double>, y double").coalesce(1)
    many = [TR.Candidate(TR.DenseNet(4, (3,)), rate, "adam", 16, dropout) for rate in (0.1, 0.01) for dropout in (0.2, 0.4)]
    states = [TR.State.fresh(c.net.start(1)) for c in many]
    alone = [TR.averaged_epoch(rows, [w], 2)[0][0].flat for w in zip(many, states)]
    calls, draw = [], TR.draw
    monkeypatch.setattr(TR, "draw", lambda keys, cells, *a: calls.append(len(cells)) or draw(keys, cells, *a))

    class Rows:
        sparkSession = rows.sparkSession

        def mapInPandas(self, run, schema):
            got = pd.concat(run([rows.toPandas()]))
            return spark.createDataFrame(got, schema)
    together = [s.flat for s, _, _ in TR.averaged_epoch(Rows(), list(zip(many, states)), 2)]
    assert sum(n == 3 for n in calls) == 4   # one a block of 16 rows
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(alone, together))
