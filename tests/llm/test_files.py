"""Exact dedup, sharding, WARC and token files against plain Python."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from streamsift.llm import exact_dedup, sharding, token_files, warc
from llm_rows import LONG, ROWS

SMALL = "/root/testdata/sf0.001"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_binary_fuse_filter():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 500, 30_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        f = exact_dedup.BinaryFuse8.build(keys)
        assert f.contains(keys).all()
        if n >= 500:
            other = rng.integers(2**63, 2**64 - 1, 50_000, dtype=np.uint64)
            assert f.contains(other).mean() < 0.01
            assert len(f.slots) < 2.2 * n


def test_dedup_edge_cases(edge, empty):
    rows = [(r[0], r[1]) for r in ROWS]
    for batches in ([edge], exact_dedup.split_in_two(edge), [edge.where("doc_id < 3"), edge.where("doc_id between 3 and 8"), edge.where("doc_id > 8 or doc_id is null")]):
        got = sorted([tuple(r) for r in exact_dedup.dedup(batches).collect()], key=str)
        assert got == brute_dedup(rows)
    assert exact_dedup.dedup(exact_dedup.split_in_two(empty)).count() == 0


def test_dedup_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted([tuple(r) for r in exact_dedup.op2_exact_dedup(spark, SMALL).collect()], key=str)
    assert got == brute_dedup(rows)


def test_shards(spark, edge, empty):
    got = sharding.assign_shards(edge).collect()
    assert len(got) == len(ROWS)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.shard)
    assert all(len(v) == 1 for v in by_id.values())
    assert sharding.assign_shards(empty).count() == 0


def test_shards_weights_and_growth(spark):
    df = spark.range(40_000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'x' text")
    got = sharding.assign_shards(df, weights=(1, 2, 1), next_weight=4).collect()
    n = Counter(r.shard for r in got)
    assert abs(n[1] / 40_000 - 0.5) < 0.02 and abs(n[0] / 40_000 - 0.25) < 0.02
    moved = [r for r in got if r.grown_shard != r.shard]
    assert all(r.grown_shard == 3 for r in moved) and abs(len(moved) / 40_000 - 0.5) < 0.02
    again = {r.doc_id: r.shard for r in sharding.assign_shards(df, weights=(1, 2, 1, 4)).collect()}
    assert all(again[r.doc_id] == r.grown_shard for r in got)
    with pytest.raises(ValueError):
        sharding.assign_shards(df, weights=(1, 0))


def test_shards_hot_key(spark, monkeypatch):
    """A key with a third of all rows, and a row repeated often: slots stay
    whole, and the key's rows are dealt over many buckets of their shard."""
    monkeypatch.setattr(sharding, "SLOT_ROWS", 100)
    rows = [(7, f"text {i}") for i in range(3000)] + [(i + 100, "x") for i in range(5000)] + [(None, "again")] * 1050
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign_shards(df).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len(t) + 8, zlib.crc32(t.encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, r.doc_id))
    assert all([x for x, _ in sorted(v, key=lambda a: a[0])] == list(range(len(v))) for v in slots.values())
    hot = next(r.shard for r in got if r.doc_id == 7)
    keys = [d for _, d in sorted(slots[hot], key=lambda a: a[0])]
    assert sum(a == 7 and b != 7 for a, b in zip(keys, keys[1:])) >= 10


def test_shards_query(spark):
    got = sharding.op6_sharding(spark, SMALL).collect()
    n = Counter(r.shard for r in got)
    assert set(n) <= set(range(24)) and sum(n.values()) == 200
    assert max(r.slot for r in got) == max(n.values()) - 1


def brute_warc(rows):
    first = {}
    for i, h in rows:
        h = h or ""
        if i is not None:
            first[h] = min(first.get(h, math.inf), i)
    out = Counter()
    for i, h in rows:
        raw = (h or "").encode()
        keep = first.get(h or "")
        revisit = keep is not None and i != keep
        out[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", keep if revisit else None)] += 1
    return out


def test_warc_edge_cases(spark, edge, empty, tmp_path):
    pages = edge.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("lang", "url").withColumnRenamed("n", "payload")
    folder = f"file://{tmp_path}/w"
    got = warc.read_warc(spark, warc.write_warc(pages, folder), folder).drop("url").collect()
    assert Counter(tuple(r) for r in got) == brute_warc([(r[0], r[1]) for r in ROWS])
    none = empty.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("lang", "url")
    assert warc.read_warc(spark, warc.write_warc(none, folder), folder).count() == 0


def test_warc_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html").collect()]
    assert Counter(tuple(r) for r in warc.op7_warc(spark, SMALL).collect()) == brute_warc(rows)


def test_warc_file_format(tmp_path):
    """Frames stand alone behind the dictionary frame."""
    recs = [warc.make_record(i, "http://a/b c\r\nX: y", "D", 5, b"<a>%d</a>" % i, None, "2020-01-01T00:00:00Z") for i in range(300)]
    w = warc.Writer(str(tmp_path), warc.train(recs))
    for r in recs:
        w.write(r)
    name, n, size = w.close()
    fs, base = warc.file_system(str(tmp_path))
    assert n == 300 and size == (tmp_path / name).stat().st_size and size < sum(map(len, recs)) / 2
    assert list(warc.read_archive(fs, f"{base}/{name}")) == recs
    head, block = warc.parse_record(recs[7])
    assert head["WARC-Target-URI"] == "http://a/b c%0D%0AX: y" and block.endswith(b"<a>7</a>")


def brute_tokens(rows, path, end):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    ids = [np.array(e.ids + [end], "<u4") for e in tok.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    return [(i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, ids)]


def test_token_files(spark, edge, empty, tmp_path):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = f"file://{tmp_path}/t"
    rows = [(r[0], r[1]) for r in ROWS]
    got = sorted(token_files.read_tokens(token_files.write_tokens(edge, folder, path, 1, partitions=5), folder).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(brute_tokens(rows, path, 1))
    at, last = 0, -1
    for r in got:
        assert r.start == at and (r.doc_id is None or r.doc_id >= last)
        at, last = at + r.n_tokens, last if r.doc_id is None else r.doc_id
    assert token_files.read_tokens(token_files.write_tokens(empty, folder, path, 1), folder).count() == 0


def test_repeated_ids_over_files(spark, tmp_path):
    """One id in all files: two runs, dealt otherwise, give the same places."""
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(7 if k % 3 else None, f"text {k % 90} " + "word " * (k % 11)) for k in range(600)]
    got = []
    for k, parts in enumerate((4, 9)):
        folder = f"file://{tmp_path}/r{k}"
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3 + k)
        made = token_files.write_tokens(df, folder, path, 1, partitions=parts)
        assert made.count() > 2
        got.append(sorted((tuple(r) for r in token_files.read_tokens(made, folder).collect()), key=lambda r: r[1]))
    assert got[0] == got[1]
    assert [r[0] for r in got[0]] == [None] * 200 + [7] * 400
    with pytest.raises(Exception, match="70000 does not fit"):
        token_files.write_tokens(df, f"file://{tmp_path}/wide", path, 70_000)
    wide = token_files.write_tokens(df, f"file://{tmp_path}/wide4", path, 70_000, dtype="<u4")
    assert token_files.read_tokens(wide, f"file://{tmp_path}/wide4", dtype="<u4").count() == 600


def test_token_query(spark):
    import public_tokenizers
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = token_files.op9_token_files(spark, SMALL).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(brute_tokens(rows, public_tokenizers.path("word_bpe_49k.json"), 1))
    at = 0
    for r in sorted(got):
        assert r.start == at
        at += r.n_tokens


def test_word_encoder_equals_whole_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["don't 'S we'LL 've", "á ̈x é f　g h", "x\x1cy \x85z", LONG[:5000], "<|endoftext|> <|startoftext|>", "İstanbul ΣΑΣ ſ", "12 345", "a" * 300, "nul\x00inside \x00 \x00\x00 x"]
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    want = [e.ids + [1] for e in tok.encode_batch(texts, add_special_tokens=False)]
    enc = token_files.WordEncoder(path)
    got = []
    for _, _, flat, n in token_files.encode_texts(enc, pa.array(texts), 1):
        got += [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
    assert got == want


def test_added_tokens_as_the_library_encodes_them(spark, tmp_path):
    """Literal added tokens, alone, inside words, beside the mark and in other cases."""
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["say <|endoftext|> x<|endoftext|>y", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext |>", "nul\x00<|endoftext|>\x00 x", "a<|endoftext|>\u3000b\n<|startoftext|>'s",
             "\x1c<|endoftext|>\x85", "e\u0301<|endoftext|>\u0301", "plain words", "", None, "<|endoftext|> " * 3000]
    tok = Tokenizer.from_file(path)
    want, at = [], 0
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert want[0][2] == 6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = f"file://{tmp_path}/t"
    got = token_files.read_tokens(token_files.write_tokens(df, folder, path, 1, partitions=3), folder).collect()
    assert sorted(tuple(r) for r in got) == want


def test_ids_of_odd_texts():
    """Capitals before combining marks, added tokens and contractions in any
    mixture give the library's ids of the whole text."""
    import random
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, enc = Tokenizer.from_file(path), token_files.WordEncoder(path, special_as_text=False)
    texts = ["J̌ ǰ H̱, T̈.", "<|ENDOFTEXT|> <|endoftext|>. a<|endoftext|>b! x|Y A|B", "don't.stop 'S WORD's. a.'s O'Re Ends' can't!", "",
             "Éa.̸ ≮ B≮", "Hello,World...(ok)?12a3.b", "a", ".b", "Z", "É.É Ñ,n  x　Y.", "\x00a.\x00 B", "I'LL 'll'd x''s", "end|", "|>Q"]
    rng = random.Random(3)
    parts = ["a", "B", "J", ".", ",", "'", "'s", "S", "|", "<|", "|>", "<|endoftext|>", "ENDOFTEXT", "̌", "́", "é", "É", "7", " ", "\n", "-", "re", "LL", "ß", "İ", "Σ", "無"]
    texts += ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(4000)]
    got = []
    for _, _, flat, n in token_files.encode_texts(enc, pa.array(texts), 1):
        got += [x.tolist()[:-1] for x in np.split(flat, np.cumsum(n)[:-1])]
    bad = [t for t, ids in zip(texts, got) if ids != lib.encode(t, add_special_tokens=False).ids]
    assert not bad, bad[:5]


def test_warc_dictionary_covers_the_table(spark):
    """The sample is spread over all rows, is bounded, and follows no order of
    files; an empty table has none."""
    from pyspark.sql import functions as F
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"),
                                     F.when(F.col("id") < 200, F.lit("first " * 2000)).otherwise(F.concat(F.lit("later half of the table "), F.sha2(F.col("id").cast("string"), 256))).alias("html"))
    raw = warc.build_dictionary(pages)
    assert len(raw) <= warc.DICT_BYTES
    late = pages.where("page_id = 3999").first()
    record = warc.make_record(late.page_id, late.url, "D", len(late.html), late.html.encode(), None, "1970-01-01T00:00:00Z")
    early = warc.build_dictionary(pages.where("page_id < 200"))
    with_all, with_early = (len(warc.zstandard.ZstdCompressor(dict_data=warc.as_dictionary(d)).compress(record)) for d in (raw, early))
    assert with_all < with_early < len(record)
    assert raw == warc.build_dictionary(pages.orderBy(F.desc("page_id")))
    assert warc.build_dictionary(pages.limit(0)) is None
