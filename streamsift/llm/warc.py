"""WARC archives compressed with a Zstandard dictionary.

File layout (``.warc.zst``): a skippable frame that holds the dictionary, then
one Zstandard frame per record, compressed with that dictionary. Any record
can be read from its offset with nothing but the leading frame.

Each task writes its rows into files of bounded size under a fresh name and
returns one manifest row per finished file. Spark commits the manifest only
for tasks that succeed, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamsift.llm.common import attach_groups, durable, file_system, pick, table
from streamsift.session import checkpoint_dir

# Fixed values of the formats.
DICT_MAGIC = 0x184D2A5D
WARC_VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: A file is closed once it has this many compressed bytes.
FILE_BYTES = 256 << 20
#: Records that the dictionary is built from, the bytes of payload taken of
#: each, and the dictionary's size.
SAMPLE_RECORDS = 1024
SAMPLE_SLICE = 4 << 10
DICT_BYTES = 64 << 10
LEVEL = 3


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value) -> str:
    """A header value on one line."""
    return quote("" if value is None else str(value), safe=";/?:@&=+$,-_.!~*'()#[]% ") or "urn:empty"


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(rid: str) -> int | None:
    digits = rid[len("<urn:page:"):-1]
    return int(digits) if digits else None


def http_head(n: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n


def make_record(page_id, url, digest: str, n: int, payload: bytes | None, refers_to, date: str) -> bytes:
    """One WARC record. ``payload`` None makes a revisit: its block keeps the
    HTTP head (with the payload's length) and refers to the response."""
    block = http_head(n) + (payload or b"")
    kind = "revisit" if payload is None else "response"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {_header(url)}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if payload is None:
        head[1:1] = [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return WARC_VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[:int(fields["Content-Length"])]


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records; where they are too few or too alike to train
    on, their first bytes serve as a raw dictionary."""
    total = sum(map(len, samples))
    size = max(1024, min(DICT_BYTES, total // 10))
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def as_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_AUTO if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(raw, dict_type=kind)


def build_dictionary(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                     date: str = "1970-01-01T00:00:00Z", records: int = SAMPLE_RECORDS) -> bytes | None:
    """A dictionary from a bounded sample over the whole table: the
    ``records`` rows of smallest hash, and of a long payload a slice of
    SAMPLE_SLICE bytes at a place that the hash chooses. The row count gives a
    hash cut under which about four times as many rows lie; equal rows count
    once. So one task gets some 16 MB for any table, and the driver the
    dictionary (64 KB). Only compression depends on it. None for an empty
    table, or where by chance no row lies below the cut."""
    total = pages.count()
    if not total:
        return None
    rows = (pick(pages, id=key, url=url, html=html)
            .select("id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
            .withColumn("h", F.xxhash64("id", "url", "payload")))
    place = F.pmod(F.col("h"), F.greatest(F.length("payload") - SAMPLE_SLICE, F.lit(0)) + 1).cast("int") + 1
    cut = min(1 << 40, (1 << 40) * 4 * records // total + 1)
    some = (rows.where(F.pmod("h", F.lit(1 << 40)) < cut)
            .groupBy("h").agg(F.min(F.struct(F.col("id").cast("string").alias("id"), "url", F.substring("payload", place, F.lit(SAMPLE_SLICE)).alias("payload"))).alias("one"))
            .orderBy("h").limit(records).select("h", "one.*"))   # bounded by ``records``

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [make_record(i, u, base32_sha1(p or b""), len(p or b""), p or b"", None, date)
               for pdf in batches for i, u, p in zip(pdf["id"], pdf["url"], pdf["payload"])]
        if got:
            yield pd.DataFrame({"raw": [train(got).as_bytes()]})

    found = some.mapInPandas(run, "raw binary").collect()
    return bytes(found[0].raw) if found else None


class Writer:
    """One open archive file."""

    def __init__(self, folder: str, dictionary: zstandard.ZstdCompressionDict):
        self.fs, path = file_system(folder)
        self.path = f"{path}/{uuid.uuid4().hex}.warc.zst"
        self.out = self.fs.open_output_stream(self.path, compression=None)
        raw = dictionary.as_bytes()
        self.out.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
        self.size, self.records = len(raw) + 8, 0

    def write(self, record: bytes) -> None:
        frame = self.zip.compress(record)
        self.out.write(frame)
        self.size += len(frame)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path.rpartition("/")[2], self.records, self.size


def read_archive(fs, path: str) -> Iterator[bytes]:
    """All records of a file, one decompressed frame at a time."""
    with fs.open_input_stream(path, compression=None) as src:
        magic, n = struct.unpack("<II", src.read(8))
        if magic != DICT_MAGIC:
            raise ValueError("no dictionary frame")
        raw = src.read(n)
        unzip = zstandard.ZstdDecompressor(dict_data=as_dictionary(raw))
        left, one, parts = b"", unzip.decompressobj(), []
        while True:
            chunk = left or src.read(1 << 20)
            left = b""
            if not chunk:
                break
            parts.append(one.decompress(chunk))
            if one.eof:
                yield b"".join(parts)
                left, one, parts = one.unused_data, unzip.decompressobj(), []
        if any(parts):
            raise ValueError("the archive ends inside a record")


def classify(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, n, sha, refers): refers is the smallest id with an
    equal payload, for rows that are revisits, else null."""
    rows = (pick(pages, id=key, url=url, html=html)
            .select("id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
            .withColumn("n", F.length("payload").cast("long")).withColumn("sha", F.sha2("payload", 256)))
    # only groups that hold two ids or more have revisits
    groups = durable(rows.where(F.col("n") >= min_bytes).groupBy("sha")
                     .agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("copies"),
                          F.max(F.col("id").isNull()).alias("unnamed"))
                     .where((F.col("first") != F.col("last")) | (F.col("unnamed") & F.col("first").isNotNull())))
    total = groups.agg(F.sum("copies")).first()[0] or 0
    copies = attach_groups(rows.select("id", "sha").distinct(), groups.select("sha", "first", "copies"), "sha", "copies", max(total, 1))
    revisits = (copies.where(~F.col("id").eqNullSafe(F.col("first")))
                .select(F.col("id").alias("rid"), F.col("sha").alias("rsha"), F.col("first").alias("refers")))
    return rows.join(revisits, F.col("id").eqNullSafe(F.col("rid")) & (F.col("sha") == F.col("rsha")), "left").drop("rid", "rsha")


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
               min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row below ``folder``; returns the manifest
    (file, records, bytes).

    Of rows with equal payloads of at least ``min_bytes`` bytes the smallest
    key becomes the response and the others revisit it. A row that repeats
    the responding key is a response too. A null key never responds for
    others unless its whole group is null. Null html is an empty payload; url
    may be null. Extra columns are ignored; an empty table gives no file.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records():
            for pdf in batches:
                for i, u, p, n, r, v in zip(pdf["id"], pdf["url"], pdf["payload"], pdf["n"], pdf["refers"], pdf["revisit"]):
                    p = p or b""
                    yield make_record(i, u, base32_sha1(p), n, None if v else p, r, date)
        dictionary, done, out = None, [], None
        for rec in records():
            dictionary = dictionary or as_dictionary(raw or b"WARC/1.1\r\n")
            out = out or Writer(folder, dictionary)
            out.write(rec)
            if out.size >= FILE_BYTES:
                done.append(out.close())
                out = None
        if out:
            done.append(out.close())
        yield pd.DataFrame(done, columns=["file", "records", "bytes"])

    file_system_ready(folder)
    raw = build_dictionary(pages, key, url, html, date)
    rows = classify(pages, key, url, html, min_bytes).withColumn("revisit", F.col("refers").isNotNull())
    as_text = [F.col(c).cast("string").alias(c) for c in ("id", "refers")]  # pandas would turn ids next to nulls into doubles
    return durable(rows.select(*as_text, "url", "payload", "n", "revisit").mapInPandas(run, "file string, records long, bytes long"))


def file_system_ready(folder: str) -> None:
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)


def read_warc(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Read the files of a manifest back: one row per record with (page_id,
    url, payload_bytes, payload_digest, record_type, refers_to). The digest of
    a response is taken anew from its payload and must equal its header."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = file_system(folder)
        cols = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for pdf in batches:
            for name, expected in zip(pdf["file"], pdf["records"]):
                rows, seen = [], 0
                for data in read_archive(fs, f"{base}/{name}"):
                    head, block = parse_record(data)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(http.rpartition(b"Content-Length: ")[2])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and (len(payload) != n or base32_sha1(payload) != digest):
                        raise ValueError(f"damaged record in {name}")
                    ref = head.get("WARC-Refers-To")
                    rows.append((page_of(head["WARC-Record-ID"]), head["WARC-Target-URI"], n, digest, head["WARC-Type"], page_of(ref) if ref else None))
                    seen += 1
                    if len(rows) == 20_000:
                        yield frame(rows, cols)
                        rows = []
                if seen != expected:
                    raise ValueError(f"{name} holds {seen} records, not {expected}")
                yield frame(rows, cols)

    def frame(rows, cols):
        out = pd.DataFrame(rows, columns=cols)
        return out.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    files = manifest.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "file")
    return files.mapInPandas(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page below the shared checkpoint folder and read it back."""
    pages = table(spark, sf_dir, "pages")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex[:12]}"
    manifest = write_warc(pages, folder)
    return read_warc(spark, manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
