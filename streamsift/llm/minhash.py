"""Near-duplicate detection with DartMinHash.

A text is a weighted set of five-word shingles. Darts are thrown, by hashing,
at the unit cells of the plane (element, weight position, rank); a dart counts
for a text if its position is below the element's weight there. Every dart
carries one of k coordinates, and the signature keeps, per coordinate, the
dart of the smallest rank. Only cells up to rank t / (total weight) are
thrown, about t = k ln k + 2k darts for a text of any length. Two signatures agree
in a coordinate with the probability of the texts' weighted Jaccard
similarity. Bands of coordinates form buckets, and texts that share one are
verified by their exact similarity.

From buckets to classes, without listing the pairs of a bucket:

1. texts with the same shingle set are one representative;
2. in every bucket each member is compared with the bucket's smallest member
   (its hub) only, and classes are formed from the verified links;
3. buckets that still hold several classes are compared in blocks: members are
   dealt into blocks of bounded rows and bytes, every pair of blocks is one
   group of rows in a task, and the group returns a spanning forest of its
   links. Members whose distance to the hub rules out a link to any member of
   another class (triangle inequality of the Jaccard distance) are left out.

Classes are the connected components over all verified links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamsift.llm.common import (attach_groups, binary_array, blocks, buffers, distinct_counts, durable, fill, mix,
                                   pick, shingles, sliced, table, weighted_jaccard)

BANDS = 30
ROWS = 5
COORDS = BANDS * ROWS
#: The smallest threshold: 30 bands of 5 miss a pair of similarity 0.8 with
#: probability 7e-6, but one of 0.6 already with 0.09.
THRESHOLD = 0.8
#: Expected darts per text before empty coordinates are looked at.
DARTS = math.ceil(COORDS * math.log(COORDS) + 2 * COORDS)
#: Members and bytes of one block of a bucket.
BLOCK_MEMBERS = 2048
BLOCK_SIZE = 8 << 20
#: Signature agreement under which a pair in a block is not verified: at
#: similarity 0.8 it lies over five standard deviations off (2e-8 of pairs).
AGREE = 0.62
#: Poisson(1) distribution function: darts per unit cell.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def unit(h: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) from the upper 53 bits."""
    return (h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def throw(elem: np.ndarray, weight: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, best: np.ndarray) -> None:
    """Throw the darts of all cells with rank in [low, high) of each text and
    keep the earliest per coordinate in ``best`` (texts x COORDS; rank in the
    upper bits, the dart's name in the lower 16)."""
    cells = np.ceil(weight).astype(np.int64)
    src = np.repeat(np.arange(len(elem)), cells)
    level = np.arange(len(src)) - np.repeat(np.cumsum(cells) - cells, cells)
    ranks = (high - low)[owner[src]]
    pick_ = np.repeat(np.arange(len(src)), ranks)
    rank = np.arange(len(pick_)) - np.repeat(np.cumsum(ranks) - ranks, ranks) + low[owner[src[pick_]]]
    src, level = src[pick_], level[pick_]
    seed = mix(elem[src] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rank.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), 9)
    count = np.searchsorted(POISSON, unit(seed))
    flat = best.reshape(-1)
    d = 0
    while True:
        use = np.flatnonzero(count > d)
        if not len(use):
            return
        h = mix(seed[use], 100 + 2 * d)
        g = mix(h, 101)
        s = src[use]
        ok = level[use] + unit(h) < weight[s]
        r = rank[use] + unit(g)
        name = mix(g, 3)
        value = ((r.view(np.uint64) >> np.uint64(16)) << np.uint64(16)) | (name & np.uint64(0xFFFF))
        coord = ((name >> np.uint64(32)) * np.uint64(COORDS)) >> np.uint64(32)
        np.minimum.at(flat, (owner[s] * COORDS + coord.astype(np.int64))[ok], value[ok])
        d += 1


EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


#: Darts that are in memory at once, and bytes of text that are signed together.
DART_BATCH = 1 << 18
SIGN_BYTES = 512 << 10
#: Rows of sets are taken from a batch in slices of about this many bytes.
SET_BYTES = 2 << 20


def signatures(elem: np.ndarray, weight: np.ndarray, per: np.ndarray) -> np.ndarray:
    """(texts, COORDS) of 16-bit dart names. Texts without elements keep the
    empty mark in all coordinates."""
    ends = np.cumsum(per)
    total = np.concatenate([[0.0], np.cumsum(weight)])
    total = total[ends] - total[ends - per]
    cost = np.concatenate([[0.0], np.cumsum(np.maximum(DARTS, total))])
    out, i = np.zeros((len(per), COORDS), np.uint16), 0
    while i < len(per):
        j = max(i + 1, int(np.searchsorted(cost, cost[i] + DART_BATCH, side="right")) - 1)
        a, b = ends[i] - per[i], ends[j - 1]
        out[i:j] = _signatures(elem[a:b], weight[a:b], per[i:j], total[i:j])
        i = j
    return out


def _signatures(elem: np.ndarray, weight: np.ndarray, per: np.ndarray, total: np.ndarray) -> np.ndarray:
    best = np.full((len(per), COORDS), EMPTY, np.uint64)
    owner = np.repeat(np.arange(len(per)), per)
    low = np.zeros(len(per), np.int64)
    high = np.where(per > 0, np.ceil(DARTS / np.maximum(total, 1e-9)).astype(np.int64), 0)
    while (high > low).any():
        mine = (high > low)[owner]
        throw(elem[mine], weight[mine], owner[mine], low, high, best)
        lacking = (high > low) & (best == EMPTY).any(axis=1)
        low, high = high, np.where(lacking, high * 2, high)
    return (best & np.uint64(0xFFFF)).astype(np.uint16)


def weights_of(counts: np.ndarray, weighting: str) -> np.ndarray:
    if weighting == "binary":
        return np.ones(len(counts))
    if weighting == "count":
        return counts.astype(np.float64)
    raise ValueError(weighting)


def set_names(elem: np.ndarray, w: np.ndarray, per: np.ndarray, low: pa.Array) -> list[bytes]:
    """A name per weighted shingle set (two 64-bit sums and the size); a text
    without words is named by its bytes."""
    named = elem + mix((w * 1024).astype(np.uint64), 21)
    ends = np.cumsum(per)
    cum = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(named, k))]) for k in (31, 32)]
    name = np.stack([c[ends] - c[ends - per] for c in cum] + [per.astype(np.uint64)], 1)
    return [x.tobytes() if n else b"t" + low[k].as_py().encode() for k, (x, n) in enumerate(zip(name, per))]


def named(df: DataFrame) -> DataFrame:
    """Set names as 16-byte digests."""
    return df.withColumn("skey", F.unhex(F.substring(F.sha2("skey", 256), 1, 32)))


def sign_texts(docs: DataFrame, weighting: str) -> DataFrame:
    """(id, skey, bytes, sig) per row: set name, size of the set, signature
    (empty sets have 0 bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            low = pc.utf8_lower(fill(batch.column(1)))
            buf, off = buffers(low)
            for i, j in blocks(off, SIGN_BYTES):
                h, owner = shingles(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                elem, count, per = distinct_counts(h, owner, j - i)
                w = weights_of(count, weighting)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(set_names(elem, w, per, low[i:j]), pa.binary()), pa.array(per * 12, pa.int64()),
                     binary_array(signatures(elem, w, per).view(np.uint8).ravel(), np.full(j - i, COORDS * 2))], ["id", "skey", "bytes", "sig"])

    return named(docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, skey binary, bytes long, sig binary"))


def shingle_sets(docs: DataFrame, weighting: str) -> DataFrame:
    """(rep, skey, elems, ws) per row (rep, text): sorted shingle hashes and
    weights as bytes; weights that are all 1 are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            low = pc.utf8_lower(fill(batch.column(1)))
            buf, off = buffers(low)
            for i, j in blocks(off, SIGN_BYTES):
                h, owner = shingles(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                elem, count, per = distinct_counts(h, owner, j - i)
                w = weights_of(count, weighting)
                names = pa.array(set_names(elem, w, per, low[i:j]), pa.binary())
                ws = binary_array(w.astype(np.float32).view(np.uint8), per * 4) if weighting != "binary" else pa.array([b""] * (j - i), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], names, binary_array(elem.view(np.uint8), per * 8), ws], ["rep", "skey", "elems", "ws"])

    return named(docs.mapInArrow(run, "rep long, skey binary, elems binary, ws binary"))


def unpack(elems: bytes, ws: bytes) -> tuple[np.ndarray, np.ndarray]:
    sh = np.frombuffer(elems, np.uint64)
    return sh, np.frombuffer(ws, np.float32).astype(np.float64) if ws else np.ones(len(sh))


def in_slices(batches: Iterator[pa.RecordBatch], col: int) -> Iterator[pa.RecordBatch]:
    """Batches cut by the bytes of a binary column."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
        for i, j in blocks(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), SET_BYTES):
            yield batch.slice(i, j - i)


#: Pairs of one hub that one task verifies together.
HUB_PAIRS = 20_000


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact similarity of (rep, hub) pairs: (rep, hub, sim).

    A hub's set goes once to each of its shares of pairs, ahead of them; a hub
    of many pairs has several shares, dealt by rep.
    """
    shares = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("shares"))
    cols = ["hub", "share", "side", "rep", "elems", "ws"]
    one = (pairs.join(sets, "rep").join(shares.where("shares > 1"), "hub", "left")
           .withColumn("share", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("shares")), F.lit(0)).cast("int"))
           .withColumn("side", F.lit(1)).select(*cols))
    two = (sets.withColumnRenamed("rep", "hub").join(shares, "hub").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
           .withColumn("side", F.lit(0)).withColumn("rep", F.col("hub")).select(*cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, None
        for batch in in_slices(batches, 4):
            reps, hubs, sims = [], [], []
            for h, side, rep, e, w in zip(*[batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5)]):
                if side == 0:
                    hub, held = h, unpack(e, w)
                elif h == hub:
                    reps.append(rep)
                    hubs.append(h)
                    sims.append(weighted_jaccard(*unpack(e, w), *held))
            yield pa.RecordBatch.from_arrays([pa.array(reps, batch.schema.field(3).type), pa.array(hubs, batch.schema.field(0).type), pa.array(sims, pa.float64())], ["rep", "hub", "sim"])

    kind = dict(sets.dtypes)["rep"]
    return (one.unionByName(two).repartition("hub", "share").sortWithinPartitions("hub", "share", "side")
            .mapInArrow(run, f"rep {kind}, hub {kind}, sim double"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(rep, comp): the smallest node of each connected component, for nodes
    with an edge (a, b). Alternating star contraction: every node hands its
    smallest neighbour to its larger ones, then to all smaller ones; the
    number of rounds follows the logarithm of the longest path."""
    now = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    for _ in range(rounds):
        # large star: links of larger neighbours move to the smallest neighbour (or the node itself)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: smaller neighbours and the node move to the smallest neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("x"), F.col("m"))
                 .unionByName(least.select(F.col("a").alias("x"), "m")).where("x != m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
        new = durable(small)
        # done when every node has one link and no smaller end has a link of its own
        state = new.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        again = state.where("n > 1").limit(1).count() or new.join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        now = new
        if not again:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("rep"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("rep"), F.col("b").alias("comp")).distinct())


def forest(left: list[tuple], right: list[tuple], threshold: float) -> Iterator[tuple]:
    """Spanning forest of the links between two blocks of a bucket (or within
    one): members are (rep, comp, sig, elems, ws). Pairs of one class, or
    joined before, are not compared; the signatures decide which of the others
    are verified."""
    same = left is right
    sig = np.stack([np.frombuffer(m[2], np.uint16) for m in right])
    names = {c: k for k, c in enumerate(dict.fromkeys([m[1] for m in left] + [m[1] for m in right]))}
    label_l = np.array([names[m[1]] for m in left])     # class of each member, as joined so far
    label_r = label_l if same else np.array([names[m[1]] for m in right])
    sets: dict = {}

    def get(m):
        if m[0] not in sets:
            sets[m[0]] = unpack(m[3], m[4])
        return sets[m[0]]

    for i, m in enumerate(left):
        near = (sig == np.frombuffer(m[2], np.uint16)).mean(axis=1) >= AGREE
        if same:
            near[:i + 1] = False
        todo = np.flatnonzero(near & (label_r != label_l[i]))
        while len(todo):
            k, todo = todo[0], todo[1:]
            if weighted_jaccard(*get(m), *get(right[k])) >= threshold:
                yield m[0], right[k][0]
                old, new = label_r[k], label_l[i]
                label_l[label_l == old] = new
                label_r[label_r == old] = new
                todo = todo[label_r[todo] != new]


def compare_blocks(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different classes inside open buckets.

    ``members``: (bkey, rep, comp, bytes, sig). The blocks of a bucket follow
    from its rows and bytes; every pair of blocks is one group of rows.
    """
    size = durable(members.groupBy("bkey").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum("bytes") / BLOCK_SIZE)).cast("int").alias("nb"),
                                               F.count(F.lit(1)).alias("n")))
    dealt = (attach_groups(members, size, "bkey", "n", members.count()).withColumn("mine", F.pmod(F.xxhash64("rep", "bkey"), F.col("nb")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .select("bkey", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "rep", "comp", "sig"))
    full = dealt.join(sets.select("rep", "elems", "ws"), "rep")
    kind = dict(sets.dtypes)["rep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(group):
            (_, x, y), rows = group
            left = [r[1:] for r in rows if r[0] == x]
            right = left if x == y else [r[1:] for r in rows if r[0] == y]
            out = list(forest(left, right, threshold)) if left and right else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], kind_arrow) for k in (0, 1)], ["a", "b"])

        group, kind_arrow = None, None
        for batch in in_slices(batches, 7):
            kind_arrow = batch.schema.field(4).type
            for bkey, x, y, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if group is None or group[0] != (bkey, x, y):
                    if group is not None:
                        yield finish(group)
                    group = ((bkey, x, y), [])
                group[1].append(tuple(row))
        if group is not None:
            yield finish(group)

    return (full.repartition("bkey", "x", "y").sortWithinPartitions("bkey", "x", "y")
            .select("bkey", "x", "y", "mine", "rep", "comp", "sig", "elems", "ws").mapInArrow(run, f"a {kind}, b {kind}"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, weighting: str = "binary") -> DataFrame:
    """(key, class_id, class_size, kept): one row per row of ``docs``.

    A class is a connected component of links with similarity of at least
    ``threshold``; ``class_id`` is its smallest key and that row is kept (of
    rows that repeat the key, all are; null keys only if the class has no
    other). Null text counts as empty. Texts without words (empty ones too)
    are duplicates only of the same lower-cased text. Texts with fewer than
    five words have one shingle of all their words. ``weighting``: "binary"
    gives each distinct shingle the weight 1 (plain Jaccard), "count" its
    number of occurrences. Extra columns are ignored; an empty table gives no
    rows. A threshold below 0.8 is an error: the bands are made for 0.8 and
    above.
    """
    if threshold < THRESHOLD:
        raise ValueError("the bands find pairs of similarity 0.8 and above")
    rows = pick(docs, id=key, text=text)
    signed = durable(sign_texts(rows, weighting))
    # one node per shingle set; the written table fixes the node numbers
    groups = durable(signed.groupBy("skey").agg(F.min("id").alias("rid"), F.first("bytes").alias("bytes"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n"))
                     .withColumn("rep", F.monotonically_increasing_id()))
    nodes = groups.where("bytes > 0")
    bands = durable(nodes.select("rep", F.explode(F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * ROWS * 2 + 1, ROWS * 2)) for b in range(BANDS)])).alias("bkey")))
    hubs = bands.groupBy("bkey").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub != top").select("bkey", "hub")
    members = durable(bands.join(hubs, "bkey"))   # one row a bucket on the right; Spark splits hot buckets of the left
    involved = members.select("rep").distinct().join(nodes.select("rep", "skey", "rid"), "rep")
    sets = durable(sets_of(rows, involved, weighting))
    seen = durable(verify(members.where("rep != hub").select("rep", "hub").distinct(), sets))
    first = durable(components(seen.where(F.col("sim") >= threshold).select(F.col("rep").alias("a"), F.col("hub").alias("b"))))
    more = durable(compare_blocks(open_members(members, seen, first, nodes, threshold), sets, threshold))
    final = components(first.select(F.col("rep").alias("a"), F.col("comp").alias("b")).unionByName(compressed(more, first))) if more.limit(1).count() else first
    classes = groups.select("skey", "rep", "rid", "n").join(final, "rep", "left").select("skey", F.coalesce("comp", "rep").alias("comp"), "rid", "n")
    sizes = classes.groupBy("comp").agg(F.sum("n").alias("class_size"), F.min("rid").alias("class_id"))
    total = signed.count()
    classes = durable(attach_groups(classes.select("skey", "comp", "n"), sizes, "comp", "class_size", total))
    out = attach_groups(signed.select("id", "skey"), classes, "skey", "n", total)
    return out.select(F.col("id").alias(key), "class_id", F.col("class_size").cast("long").alias("class_size"), F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def compressed(links: DataFrame, comps: DataFrame) -> DataFrame:
    """Links between classes, given links between their members."""
    def lift(df, c):
        return (df.join(comps.select(F.col("rep").alias(c), F.col("comp").alias(f"{c}_comp")), c, "left")
                .withColumn(c, F.coalesce(f"{c}_comp", c)).drop(f"{c}_comp"))
    return lift(lift(links, "a"), "b").where("a != b").distinct()


def sets_of(rows: DataFrame, involved: DataFrame, weighting: str) -> DataFrame:
    """(rep, elems, ws) of involved nodes, from a text with the node's row key.
    Where that key has other texts too, the set's name picks the right one."""
    wanted = involved.select("rep", F.col("rid"), F.col("skey").alias("want"))
    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("rid"))).select("rep", "text")
    made = shingle_sets(texts, weighting).join(wanted.select("rep", "want"), "rep").where(F.col("skey") == F.col("want"))
    return made.groupBy("rep").agg(F.first("elems").alias("elems"), F.first("ws").alias("ws"))


def open_members(members: DataFrame, seen: DataFrame, comps: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Members of buckets that may still hide a link between two classes.

    A bucket is open if it holds a member of another class than its hub's.
    Beside those members stay only members of the hub's class that are at
    least (their smallest distance - (1 - threshold)) away from the hub.
    """
    known = (members.join(seen, ["rep", "hub"], "left").withColumn("far", 1 - F.coalesce("sim", F.lit(1.0)))
             .join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
             .join(comps.select(F.col("rep").alias("hub"), F.col("comp").alias("hcomp")), "hub", "left").withColumn("hcomp", F.coalesce("hcomp", "hub"))
             .select("bkey", "rep", "comp", "hcomp", "far"))
    known = durable(known)
    edge = known.where("comp != hcomp").groupBy("bkey").agg(F.min("far").alias("near"))
    kept = (known.join(edge, "bkey").where((F.col("comp") != F.col("hcomp")) | (F.col("far") >= F.col("near") - (1 - threshold) - 1e-9))
            .select("bkey", "rep", "comp"))
    # the hub itself was compared with all; a bucket left with one class is closed
    kept = durable(kept)
    alive = (kept.groupBy("bkey").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"), F.count(F.lit(1)).alias("m"))
             .where("lo != hi").groupBy("who", "m").agg(F.min("bkey").alias("bkey")).select("bkey"))  # buckets with the same members are one
    return durable(kept.join(alive, "bkey").join(nodes.select("rep", "bytes", "sig"), "rep"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: five words, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"))
