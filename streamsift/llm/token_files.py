"""Token ids as flat binary files with document offsets.

Documents are range-partitioned by id; each task encodes its texts and writes

* ``<name>.bin``: the ids of its documents one after another, little-endian
  unsigned 16- or 32-bit integers;
* ``<name>.idx``: per document its id and its token offset inside the file,
  as little-endian 64-bit integers, closed by the file's token count.

A manifest row per file (first id, file name, documents, tokens) is committed
by Spark for successful tasks only. The base of a file is the prefix sum of
the tokens of the files before it, so that files need no common numbering
while they are written. Reading memory-maps both files.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from streamsift.llm.common import (TOKEN_BYTES, SpanCache, SpanHash, blocks, buffers, durable, file_system, fill,
                                   pick, ragged, sliced, spans, table)
from streamsift.session import checkpoint_dir

#: Words whose ids a worker remembers at most.
CACHE_WORDS = 1_000_000
#: A character that is a word and a token of its own, put between words.
MARK = "\x00"
LINE_WORDS = 1000
BLOCK = 4 << 20


class WordEncoder:
    """Batched encoding with a tokenizer whose pre-tokenizer drops white space
    and never joins across it: each white-space-delimited word is encoded once
    and the ids of a text are the concatenation of its words' ids. The ids of
    a word are remembered by a 64-bit hash of its bytes together with its
    length. Added tokens hold no white space; their literal text gives their
    id, as in the library, unless ``special_as_text`` cuts it into pieces.
    """

    def __init__(self, path: str, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        mark = self.tok.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.cache = SpanCache(np.uint32, CACHE_WORDS)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and ids per word. Words without the mark are encoded many
        at a time, with the mark as a word between them."""
        if self.mark is None or any(MARK in w for w in words):
            got = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(g) for g in got], np.int64)
        lines = [f" {MARK} ".join([*words[k:k + LINE_WORDS], ""]) for k in range(0, len(words), LINE_WORDS)]
        ids = np.concatenate([np.zeros(0, np.uint32), *[np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(lines, add_special_tokens=False)]])
        at = np.flatnonzero(ids == self.mark)
        return np.delete(ids, at), np.diff(at, prepend=-1) - 1

    def block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and ids per text."""
        s, e, doc = spans(buf, off, TOKEN_BYTES)
        texts = len(off) - 1
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(texts, np.int64)
        key = SpanHash(buf)(s, e) ^ (e - s).astype(np.uint64)
        raw, cache = buf.tobytes(), self.cache
        uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(cache) + len(uniq) > cache.limit:
            cache.clear()
        at, n, held = cache.find(uniq)
        new = np.flatnonzero(~held)
        if len(new):
            marked = np.array([], np.int64)
            if 0 in buf:                      # words that hold the mark itself go one by one
                zero = np.concatenate([[0], np.cumsum(buf == 0)])
                marked = new[zero[e[first[new]]] > zero[s[first[new]]]]
            for some in (np.setdiff1d(new, marked), marked):
                if len(some):
                    ids, m = self.encode_words([raw[a:b].decode() for a, b in zip(s[first[some]].tolist(), e[first[some]].tolist())])
                    cache.add(uniq[some], ids, m)
            at, n, _ = cache.find(uniq)
        return ragged(cache.values, at[back], n[back]), np.bincount(doc, weights=n[back], minlength=texts).astype(np.int64)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and tokenizer, with the library's
    handling of added tokens."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path, special_as_text=False)
    return _ENCODERS[path]


def encode_texts(enc: WordEncoder, arr: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text, flat ids with the end ids, ids per text)."""
    buf, off = buffers(arr)
    for i, j in blocks(off, BLOCK):
        ids, n = enc.block(buf[off[i]:off[j]], off[i:j + 1] - off[i])
        out = np.full(len(ids) + (j - i), end_id, np.uint32)
        ends = np.cumsum(n + 1) - 1
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = ids
        yield i, j, out, n + 1


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
                 dtype: str = "<u2", partitions: int | None = None) -> DataFrame:
    """Encode all texts into files below ``folder``; returns the manifest.

    Files follow each other in ascending id order; rows that repeat an id are
    split over tasks by a hash of their text and follow in a fixed order; a
    null id sorts first and is stored as the smallest 64-bit integer. Null and empty texts hold the end id alone. The
    literal text of an added token (``<|endoftext|>``) gives its one id, as the library's encode does. Extra columns
    are ignored; an empty table gives no file.
    """
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    low = np.iinfo(np.int64).min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        local, base = file_system(folder)
        name = uuid.uuid4().hex
        first, docs_n, tokens = None, 0, 0
        with local.open_output_stream(f"{base}/{name}.bin") as out, local.open_output_stream(f"{base}/{name}.idx") as idx:
            for batch in sliced(batches, 1):
                if not len(batch):
                    continue
                ids = batch.column(0).fill_null(low).to_numpy(zero_copy_only=False).astype("<i8")
                for i, j, flat, n in encode_texts(enc, fill(batch.column(1)), end_id):
                    if first is None:
                        first = (batch.column(0)[i].is_valid, int(ids[i]), batch.column(2)[i].as_py())
                    if len(flat) and int(flat.max()) > np.iinfo(dtype).max:
                        raise ValueError(f"id {int(flat.max())} does not fit {dtype}")
                    out.write(flat.astype(dtype).tobytes())
                    idx.write(np.stack([ids[i:j], tokens + np.cumsum(n) - n], axis=1).astype("<i8").tobytes())
                    docs_n += j - i
                    tokens += int(n.sum())
            idx.write(np.array([low, tokens], "<i8").tobytes())
        if docs_n:
            yield pa.RecordBatch.from_pydict({"has_id": [first[0]], "first_id": pa.array([first[1]], pa.int64()), "first_hash": pa.array([first[2]], pa.int64()), "file": [name], "docs": pa.array([docs_n], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    rows = pick(docs, id=key, text=text).withColumn("hash", F.xxhash64("text"))
    by = ["id", "hash"]   # the session's shuffle partitions, unless given; equal rows share a file
    rows = (rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)).sortWithinPartitions(*by)
    made = durable(rows.mapInArrow(run, "has_id boolean, first_id long, first_hash long, file string, docs long, tokens long"))
    before = W.orderBy("has_id", "first_id", "first_hash").rowsBetween(W.unboundedPreceding, -1)
    return durable(made.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))))


def read_tokens(manifest: DataFrame, folder: str, dtype: str = "<u2") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document from the files."""
    low = np.iinfo(np.int64).min

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local, base = file_system(folder)
        for pdf in batches:
            for name, start, docs_n in zip(pdf["file"], pdf["base"], pdf["docs"]):
                ids, idx = mapped(local, f"{base}/{name}.bin", dtype), mapped(local, f"{base}/{name}.idx", "<i8").reshape(-1, 2)
                if len(idx) != docs_n + 1 or idx[-1, 1] != len(ids):
                    raise ValueError(f"{name} is damaged")
                for a in range(0, docs_n, 20_000):
                    b = min(a + 20_000, docs_n)
                    off = idx[a:b + 1, 1]
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
                    key = pd.array(idx[a:b, 0], dtype="Int64")
                    key[idx[a:b, 0] == low] = pd.NA
                    yield pd.DataFrame({"doc_id": key, "start": start + off[:-1], "n_tokens": np.diff(off), "ids_crc32": np.array(crc, np.int64)})

    files = manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4), "file")
    return files.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def mapped(fs, path: str, dtype: str) -> np.ndarray:
    """A memory map of a file (a remote store gives its bytes instead)."""
    import pyarrow.fs as pafs
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the 49k word BPE, end id 1."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex[:12]}"
    manifest = write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"), 1)
    return read_tokens(manifest, folder)
