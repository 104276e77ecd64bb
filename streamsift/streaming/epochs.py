"""Stateful streaming jobs whose state is a table per micro-batch (ST1, ST2, W13).

A job is a step: (rows of the micro-batch, state tables of the epoch before)
-> (output tables, state tables). Steps are the batch operators with a carried
row per stream, so a hot stream is spread over tasks as in batch. ``Epochs``
keeps every table's versions in one folder per epoch; a step that is repeated
after a failure reads the same versions and replaces its own folders, so
outputs and states are exactly-once. Rows of a later micro-batch must come
later in ``seq`` order; inside a micro-batch any order will do.

* ``fragment_step``: anchored windows, flow orientation and first-n buffers
  that go on across micro-batches; a fragment is put out when its window is
  closed. A capture has one open window, whose fragments are the buffer.
* ``decay_step``: decayed statistics (1-D and jitter) of (key, seq, t, v) rows.
* ``pair_step``: sender/receiver statistics (2-D): the role streams, then the
  residual streams of the pairs, handed over inside the epoch as a table.
* ``expiry_step``: decayed statistics with late rows set aside and idle
  streams removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packet as P
from ..operators import decay as DC
from ..operators import flows as FL
from ..operators.prefix import DEFAULT_CHUNK_ROWS, int_div, prefix_sum, running_max
from ..operators.windows import anchored_windows
from ..session import cut_lineage

State = dict[str, DataFrame]
Step = Callable[[DataFrame, State], tuple[State, State]]


class Epochs:
    """Versions of a job's tables below one shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, kind: str, name: str, epoch: int) -> str:
        return f"{self.folder}/{kind}/{name}/epoch={int(epoch)}"

    def put(self, df: DataFrame, kind: str, name: str, epoch: int) -> DataFrame:
        at = self.path(kind, name, epoch)
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def state(self, names: list[str], epoch: int) -> State:
        """The state tables that the step of ``epoch`` starts from."""
        return {} if epoch <= 0 else {n: self.spark.read.parquet(self.path("state", n, epoch - 1)) for n in names}

    def next(self, name: str) -> int:
        """The epoch after the last one that left rows in a state table."""
        try:
            last = self.spark.read.parquet(f"{self.folder}/state/{name}").agg(F.max("epoch")).first()[0]
        except AnalysisException:
            return 0   # nothing was processed yet
        return 0 if last is None else int(last) + 1

    def output(self, name: str) -> DataFrame:
        """All epochs of an output table, with their number in ``epoch``."""
        return self.spark.read.parquet(f"{self.folder}/out/{name}")

    def run(self, step: Step, states: list[str]) -> Callable[[DataFrame, int], None]:
        """The function for ``foreachBatch``."""
        def batch(rows: DataFrame, epoch: int) -> None:
            out, state = step(rows, self.state(states, epoch))
            for name in states:
                self.put(state[name], "state", name, epoch)
            for name, df in out.items():
                self.put(df, "out", name, epoch)
        return batch


def run_epochs(stream: DataFrame, epochs: Epochs, step: Step, states: list[str]) -> None:
    """Process all that is available, then stop."""
    (stream.writeStream.foreachBatch(epochs.run(step, states)).option("checkpointLocation", f"{epochs.folder}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


# ------------------------------------------------------------------- fragments

FRAGMENT_STATES = ["anchors", "flows", "open"]
#: A place before the first frame of any capture.
BEFORE = -(1 << 62)


def fragment_step(width_us: int, max_flow_len: int, labels: DataFrame | None = None) -> Step:
    """Frames (``sources.tables.flow_features`` rows) -> closed fragments, as
    ``flows.build_fragments`` gives them. States: ``anchors`` (per capture the
    open window's start and the running maximum time), ``flows`` (the
    orientation of every flow seen in a capture) and ``open`` (at most
    ``max_flow_len`` packets of every fragment in the open windows). Frames
    without accepted packets still move windows on."""
    cap, key = "capture_id", ["capture_id", "flow_key", "window_start_us"]

    def step(frames: DataFrame, state: State) -> tuple[State, State]:
        rows = frames.withColumn("carried", F.lit(False))
        if state:
            # two frames stand for all earlier ones: the open window's first, and the latest
            blank = [F.lit(None).cast(kind).alias(c) for c, kind in frames.dtypes if c not in (cap, "seq", "ts_us", "accepted")]
            held = state["anchors"].select(cap, F.explode(F.array(F.struct(F.lit(BEFORE).alias("seq"), F.col("anchor_us").alias("ts_us")),
                                                                  F.struct(F.lit(BEFORE + 1).alias("seq"), F.col("max_us").alias("ts_us")))).alias("f"))
            rows = rows.unionByName(held.select(cap, "f.seq", "f.ts_us", F.lit(False).alias("accepted"), *blank, F.lit(True).alias("carried")))
        # the frames were written with their running maximum; meeting the few anchors again costs less than a second table
        d = anchored_windows(rows, width_us)
        anchors = d.groupBy(cap).agg(F.max("window_start_us").alias("anchor_us"), F.max("ts_us").alias("max_us"))
        anchors = cut_lineage(anchors)
        new = (d.where(F.col("accepted") & ~F.col("carried")).drop("carried").withColumn("flow_key", P.canonical_tuple(F.col("id_fwd"))))
        if state:
            new = new.unionByName(state["open"])
        first = cut_lineage(FL.first_packets(new, max_flow_len))
        # the stored packets hold the first one of every flow that began in this epoch
        flows = first.groupBy(cap, "flow_key").agg(F.min_by("id_fwd", "seq").alias("flow"), F.min("seq").alias("first_seq"))
        if state:
            flows = (flows.unionByName(state["flows"]).groupBy(cap, "flow_key")
                     .agg(F.min_by("flow", "first_seq").alias("flow"), F.min("first_seq").alias("first_seq")))
        flows = cut_lineage(flows)
        here = first.join(anchors.select(cap, "anchor_us"), cap)
        going = F.col("window_start_us") >= F.col("anchor_us")
        closed = finished(here.where(~going).drop("anchor_us"), flows, key, labels)
        return {"fragments": closed}, {"anchors": anchors, "flows": flows, "open": here.where(going).drop("anchor_us", "pos")}

    return step


def finished(first: DataFrame, flows: DataFrame, key: list[str], labels: DataFrame | None) -> DataFrame:
    """Stored first packets with orientation, relative time and label."""
    from pyspark.sql import Window
    d = first.join(flows.select("capture_id", "flow_key", "flow"), ["capture_id", "flow_key"])
    d = d.withColumn("f0", (F.col("ts_us") - F.min("ts_us").over(Window.partitionBy(*key))).cast("double") / F.lit(1e6))
    d = FL.finish_features(FL.apply_labels(d, labels))
    return d.select("capture_id", "flow", "window_start_us", "pos", "seq", *FL.FEATURE_COLS, "label")


def open_fragments(epochs: Epochs, max_flow_len: int, labels: DataFrame | None = None) -> DataFrame:
    """The fragments of the windows that are still open."""
    state = epochs.state(FRAGMENT_STATES, epochs.next("anchors"))
    key = ["capture_id", "flow_key", "window_start_us"]
    return finished(FL.first_packets(state["open"], max_flow_len), state["flows"], key, labels)


# ---------------------------------------------------------- decayed statistics

def _held(sums: DataFrame, keys: list[str], lambdas: list[float], seq: str = "seq", t: str = "t") -> DataFrame:
    """(keys, seq, t, v0, carried): where every stream stands after its rows."""
    rate = F.array_position(F.array(*[F.lit(float(x)) for x in lambdas]), F.col("lam"))
    last = (sums.groupBy(*keys, "lam").agg(F.max_by(F.struct("v0", *DC.SUMS), seq).alias("s"), F.max(seq).alias("seq"), F.max(t).alias("t"))
            .withColumn("rate", rate))
    per_rate = F.sort_array(F.collect_list(F.struct("rate", F.struct(*[F.col(f"s.{n}").alias(n) for n in DC.SUMS]).alias("sums"))))
    return (last.groupBy(*keys).agg(F.max("seq").alias("seq"), F.max("t").alias("t"), F.first("s.v0").alias("v0"), per_rate.alias("_r"))
            .select(*keys, "seq", "t", "v0", F.transform("_r", lambda x: x["sums"]).alias("carried")))


def _held_wide(sums: DataFrame, keys: list[str], seq: str = "seq", t: str = "t") -> DataFrame:
    """``_held`` for sums whose rates stand side by side."""
    carried = F.transform(F.arrays_zip("w", "d1", "d2"), lambda s: F.struct(*[s[n].alias(n) for n in DC.SUMS]))
    return (sums.groupBy(*keys).agg(F.max_by(F.struct("v0", *DC.SUMS), seq).alias("s"), F.max(seq).alias("seq"), F.max(t).alias("t"))
            .select(*keys, "seq", "t", "s.*").select(*keys, "seq", "t", "v0", carried.alias("carried")))


def _joined(rows: DataFrame, state: DataFrame | None, keys: list[str], lambdas: list[float]) -> DataFrame:
    """Rows (keys, seq, t, v) and one carried row per earlier stream."""
    kind = "array<struct<w:double,d1:double,d2:double>>"
    rows = rows.select(*keys, "seq", "t", F.col("v").cast("double").alias("v"), F.lit(None).cast(kind).alias("carried"))
    return rows if state is None else rows.unionByName(state.select(*keys, "seq", "t", F.col("v0").alias("v"), "carried"))


def decay_step(lambdas: list[float], key: str = "k", jitter: bool = False) -> Step:
    """(key, seq, t, v) -> per row and rate w, mean, var, as
    ``decay.decayed_stats_1d``. State ``streams``: one row per stream."""
    lambdas = [float(x) for x in lambdas]

    def step(rows: DataFrame, state: State) -> tuple[State, State]:
        d = _joined(rows, state.get("streams"), [key], lambdas)
        sums = cut_lineage(DC.decayed_sums(d, [key, "lam"], gap_value=F.lit(True) if jitter else None, lambdas=lambdas, carried="carried"))
        out = DC.moments(sums.where("carried is null")).select(key, "seq", "lam", "w", "mean", "var")
        return {"stats": out}, {"streams": _held(sums, [key], lambdas)}

    return step


PAIR_STATES = ["roles", "pairs"]


def pair_step(lambdas: list[float], src: str = "src", dst: str = "dst") -> Step:
    """(src, dst, seq, t, v) -> per row and rate radius, magnitude, cov, pcc, as
    ``decay.pair_stats_2d``. States: ``roles`` (a row per sender and receiver
    stream) and ``pairs`` (a row per pair and rate). The rates of the roles
    stay side by side, and only the products are multiplied by them."""
    lambdas = [float(x) for x in lambdas]
    kind = "struct<w:double,d1:double,d2:double>"

    def step(rows: DataFrame, state: State) -> tuple[State, State]:
        base = rows.select("seq", "t", F.col("v").cast("double").alias("v"), src, dst)
        d = _joined(DC.pair_roles(base, src, dst), state.get("roles"), ["dir", "k"], lambdas)
        sums = cut_lineage(DC.decayed_sums(d, ["dir", "k", "lam"], lambdas=lambdas, carried="carried", wide=True))
        sides = cut_lineage(DC.pair_sides(sums.where("carried is null"), lambdas, largest=True))
        per = F.explode(F.array(*[F.struct(F.lit(x).alias("lam"), F.col("r")[j].alias("r")) for j, x in enumerate(lambdas)])).alias("_p")
        pairs = (DC.pair_products(base, sides, src, dst, lambdas).select("seq", "t", "pk", per)
                 .select("seq", "t", "pk", "_p.lam", "_p.r", F.lit(None).cast(kind).alias("carried")))
        if state:
            pairs = pairs.unionByName(state["pairs"].withColumnRenamed("v0", "r"))
        cov = cut_lineage(DC.decayed_sums(pairs, ["pk", "lam"], v="r", carried="carried"))
        held = (cov.groupBy("pk", "lam").agg(F.max_by(F.struct("v0", *DC.SUMS), "seq").alias("s"), F.max("seq").alias("seq"), F.max("t").alias("t"))
                .select("pk", "lam", "seq", "t", "s.v0", F.struct(*[F.col(f"s.{n}").alias(n) for n in DC.SUMS]).alias("carried")))
        out = cov.where("carried is null").select("seq", "lam", (F.col("cf1") / F.col("w")).alias("c")).join(sides, "seq")
        return {"stats": DC.pair_values(out, lambdas)}, {"roles": _held_wide(sums, ["dir", "k"]), "pairs": held}

    return step


EXPIRY_STATES = ["streams", "clock"]


def expiry_step(lambdas: list[float], ttl: float, delay: float, key: str = "k", chunk_rows: int = DEFAULT_CHUNK_ROWS) -> Step:
    """Decayed statistics with event-time expiry.

    A row is late if its time is more than ``delay`` before the largest time of
    all earlier rows (of any stream); late rows go to the output ``late`` and
    change nothing. A stream whose next row comes more than ``ttl`` after its
    running maximum starts anew. So a stream that stands more than
    ``delay + ttl`` behind the clock can only start anew, and its state is
    removed. Neither rule depends on how rows fall into micro-batches.

    Outputs: ``stats`` (key, seq, lam, w, mean, var), ``late`` (key, seq, t,
    v). States: ``streams``, and ``clock`` (the largest time so far).
    """
    lambdas = [float(x) for x in lambdas]

    def step(rows: DataFrame, state: State) -> tuple[State, State]:
        seen = state["clock"].first()["clock"] if state else None   # one number
        seen = float("-inf") if seen is None else float(seen)
        timed = cut_lineage(running_max(rows.select(key, "seq", "t", F.col("v").cast("double").alias("v"), F.lit(0).alias("all")),
                                        ["all"], "seq", "t", "now", prev_out="before", chunk_rows=chunk_rows))
        late = F.col("t") < F.greatest(F.coalesce("before", F.lit(seen)), F.lit(seen)) - F.lit(float(delay))
        clock = timed.agg(F.greatest(F.max("t"), F.lit(seen)).alias("clock"))
        d = _joined(timed.where(~late), state.get("streams"), [key], lambdas)
        d = running_max(d, [key], "seq", "t", "upto", prev_out="prior", chunk_rows=chunk_rows)
        d = d.withColumn("anew", F.coalesce((F.col("t") > F.col("prior") + F.lit(float(ttl))).cast("int"), F.lit(0))).drop("upto", "prior")
        d = prefix_sum(d, [key], ["seq"], "anew", "life", int_div("seq", chunk_rows), exclusive=False).drop("anew")
        sums = cut_lineage(DC.decayed_sums(d, [key, "life", "lam"], lambdas=lambdas, carried="carried"))
        lives = _held(sums, [key, "life"], lambdas)
        latest = lives.groupBy(key).agg(F.max_by(F.struct("seq", "t", "v0", "carried"), "life").alias("s")).select(key, "s.*")
        now = clock.first()["clock"]
        alive = latest.where(F.col("t") >= F.lit(float("-inf") if now is None else float(now)) - F.lit(float(delay) + float(ttl)))
        out = DC.moments(sums.where("carried is null")).select(key, "seq", "lam", "w", "mean", "var")
        return {"stats": out, "late": timed.where(late).select(key, "seq", "t", "v")}, {"streams": alive, "clock": clock}

    return step


# ---------------------------------------------------------------- classification

def classify_step(width_us: int, max_flow_len: int, mins: list[float], maxs: list[float], params: dict,
                  labels: DataFrame | None = None) -> Step:
    """ST1: closed fragments are scaled, padded, classified with a trained CNN
    and reported: outputs ``fragments``, ``predictions`` and ``reports`` (one
    report row per epoch that closed a fragment)."""
    inner = fragment_step(width_us, max_flow_len, labels)

    def step(frames: DataFrame, state: State) -> tuple[State, State]:
        out, new = inner(frames, state)
        closed = cut_lineage(out["fragments"])
        predictions = cut_lineage(classified(closed, max_flow_len, mins, maxs, params))
        return {"fragments": closed, "predictions": predictions, "reports": reported(predictions)}, new

    return step


def classified(fragments: DataFrame, max_flow_len: int, mins: list[float], maxs: list[float], params: dict) -> DataFrame:
    from ..operators import cnn as CN
    from ..operators import dataset as DS
    samples = DS.to_samples(DS.pad_long(DS.normalize(fragments, mins, maxs), max_flow_len), max_flow_len)
    keyed = samples.withColumn("sample_id", F.concat_ws("|", "capture_id", *[F.col(f"flow.{c}").cast("string") for c in ("src", "sport", "dst", "dport", "proto")],
                                                        F.col("window_start_us").cast("string")))
    return CN.predict_cnn(keyed, params, ["sample_id", "set_y"]).withColumnRenamed("set_y", "label")


def reported(predictions: DataFrame, model: str = "cnn", source: str = "stream") -> DataFrame:
    from ..operators import metrics as MT
    return MT.confusion_report(predictions.withColumn("model", F.lit(model)).withColumn("source", F.lit(source)), ["model", "source"])
