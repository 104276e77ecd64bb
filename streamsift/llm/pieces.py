"""SentencePiece encoding and decoding by batched Viterbi in numpy.

The model file gives the pieces. A text becomes ``▁`` + text with spaces as
``▁``; it falls into chunks that start at a ``▁``, and no piece crosses into
the next chunk. Each distinct chunk of a block is segmented once:

* the hashes of all substrings of up to the longest piece's characters probe
  the sorted hashes of the pieces;
* character boundaries that no matching piece covers split chunks further, so
  that long chunks without spaces become short segments;
* segments of equal length advance together: one numpy maximum per end
  position over the lengths of the last piece, which stores backpointers;
* a segment longer than a window is cut into windows of equal length, which
  advance together too (``Model._windows``), so that neither memory nor steps
  follow the length of a text without spaces.

Characters without a piece fall back to byte pieces. Decoding concatenates
piece bytes; every encoding is decoded and compared with its text, and a text
that does not come back (two chunks with one 64-bit hash) is encoded anew
without sharing.

Scores: a unigram model's own log probabilities. A BPE model has only merge
ranks; a piece then scores ``-ln(rank + 2)``, the log probability of its rank
under Zipf's law. The best-scoring segmentation is defined by the scores and
can differ from greedy merging; the ids are ids of the given model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from streamsift.llm.common import (SpanCache, SpanHash, blocks, buffers, fill, list_array, pick, ragged, sliced,
                                   table)

SPACE = "▁"
BLOCK = 4 << 20
#: Chunks whose segmentation a worker remembers.
CACHE_CHUNKS = 1_000_000
#: Bytes (or characters of a long chunk) whose substrings are held at once.
STRETCH = 1 << 18
#: Characters of a window of a long segment, and windows that advance together.
WINDOW, GROUP = 1024, 64
#: A character without a piece scores this much below the worst piece.
UNKNOWN = 10.0


class Model:
    """Pieces of a SentencePiece model as arrays."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        texts = [sp.id_to_piece(i) for i in normal]
        if any(SPACE in t.lstrip(SPACE) for t in texts):
            raise ValueError("a piece holds a space behind other characters")
        raw = [t.encode() for t in texts]
        given = np.array([sp.get_score(i) for i in normal])
        ranked = bool((np.mod(given, 1) == 0).all())    # merge ranks, not log probabilities
        score = -np.log(np.arange(len(normal)) + 2.0) if ranked else given
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        key = SpanHash(np.frombuffer(b"".join(raw), np.uint8))(off[:-1], off[1:])
        order = np.argsort(key)
        self.keys, self.ids, self.scores = key[order], np.array(normal, np.int32)[order], score[order]
        if len(np.unique(key)) < len(key):
            raise ValueError("two pieces share a hash")
        self.longest = max(len(t) for t in texts)
        self.unknown_score = float(score.min()) - UNKNOWN
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[key & np.uint64((1 << 22) - 1)] = True
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("byte fallback is needed")
        out = [b""] * n
        for i, r in zip(normal, raw):
            out[i] = r.replace(SPACE.encode(), b" ")
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        self.piece_len = np.array([len(x) for x in out], np.int32)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(out), np.uint8)

    def match(self, key: np.ndarray) -> np.ndarray:
        """Row of the sorted piece table for every hash, or -1."""
        out = np.full(len(key), -1, np.int32)
        maybe = np.flatnonzero(self.sieve[key & np.uint64((1 << 22) - 1)])
        at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == key[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def segment(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentation of byte spans: (flat ids, ids per span). Spans are
        taken a stretch at a time; a span longer than a stretch goes alone."""
        off = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=off[1:])
        parts, per = [np.zeros(0, np.int32)], []
        for i, j in blocks(off, STRETCH):
            if off[j] - off[i] <= STRETCH:
                ids, n = self._short(buf, start[i:j], end[i:j])
            else:
                ids = self._long(buf[start[i]:end[i]])
                n = np.array([len(ids)])
            parts.append(ids)
            per.append(n)
        return np.concatenate(parts), np.concatenate([np.zeros(0, np.int64), *per])

    def _rows(self, own: np.ndarray, head: np.ndarray, tail: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """Per piece length, the row of the piece that starts at every
        character, or -1. ``last``: one past the last character it may reach."""
        hashes, rows, chars = SpanHash(own), [], len(head)
        for n in range(1, self.longest + 1):
            at = np.arange(chars)
            at = at[at + n <= last]
            row = np.full(chars, -1, np.int32)
            if len(at):
                row[at] = self.match(hashes(head[at], tail[at + n - 1]))
            rows.append(row)
        return rows

    @staticmethod
    def _first(rows: list[np.ndarray]) -> np.ndarray:
        """Characters that no piece joins to the one before."""
        chars = len(rows[0])
        cover = np.zeros(chars + 1, np.int64)
        for n, row in enumerate(rows[1:], 2):
            hit = np.flatnonzero(row >= 0)
            np.add.at(cover, hit + 1, 1)
            np.add.at(cover, hit + n, -1)
        first = np.ones(chars, bool)
        first[1:] = np.cumsum(cover)[1:chars] == 0
        return first

    def _ids(self, own: np.ndarray, begin: np.ndarray, stop: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces at byte spans, and their number per span: a span
        without a row falls back to its bytes."""
        count = np.where(row >= 0, 1, stop - begin)
        out = np.repeat(np.where(row >= 0, self.ids[row], -1), count)
        lost = np.flatnonzero(row < 0)
        if len(lost):
            out[out < 0] = self.byte_ids[ragged(own, begin[lost], count[lost])]
        return out.astype(np.int32), count

    def _short(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans of one stretch together: (flat ids, ids per span)."""
        size = end - start
        own = ragged(buf, start, size)                       # the chunks' bytes, one after another
        head = np.flatnonzero((own & 0xC0) != 0x80)          # first byte of every character
        chars = len(head)
        tail = np.append(head[1:], len(own))
        chunk = np.searchsorted(np.cumsum(size), head, side="right")
        last = np.searchsorted(chunk, np.arange(len(start)), side="right")  # one past a chunk's last character
        rows = self._rows(own, head, tail, last[chunk])
        seg = np.flatnonzero(self._first(rows))              # characters that start a segment
        length = np.diff(np.append(seg, chars))
        piece = np.full(chars, -2, np.int64)                  # row of the piece that starts here; -1 unknown, -2 none
        for n in np.unique(length):
            self._advance(seg[length == n], int(n), rows, piece)
        begins = np.flatnonzero(piece > -2)
        ids, count = self._ids(own, head[begins], tail[begins], piece[begins])
        return ids, np.bincount(chunk[begins], weights=count, minlength=len(start)).astype(np.int64)

    @staticmethod
    def _edges(own: np.ndarray) -> np.ndarray:
        """First byte of every character, and the end."""
        at = [a + np.flatnonzero((own[a:a + STRETCH] & 0xC0) != 0x80).astype(np.int32) for a in range(0, len(own), STRETCH)]
        return np.concatenate([*at, np.array([len(own)], np.int32)])

    def _long(self, own: np.ndarray) -> np.ndarray:
        """One long span: cut where no piece joins two characters, found a
        stretch at a time with the longest piece around it; what has no such
        cut over a whole window goes through ``_windows``."""
        edge = self._edges(own)
        chars = len(edge) - 1
        first = np.ones(chars, bool)
        for a in range(0, chars, STRETCH):
            lo, b = max(0, a - self.longest), min(a + STRETCH, chars)
            hi = min(b + self.longest, chars)
            rows = self._rows(own[edge[lo]:edge[hi]], edge[lo:hi] - edge[lo], edge[lo + 1:hi + 1] - edge[lo], np.int64(hi - lo))
            first[a:b] = self._first(rows)[a - lo:b - lo]
        seg = np.flatnonzero(first).astype(np.int32)
        stop = np.append(seg[1:], np.int32(chars))
        big = stop - seg > WINDOW
        parts, at = [np.zeros(0, np.int32)], 0
        for k in [*np.flatnonzero(big).tolist(), len(seg)]:
            if at < k:
                for i in range(at, k, STRETCH):
                    j = min(i + STRETCH, k)
                    parts.append(self.segment(own, edge[seg[i:j]], edge[stop[i:j]])[0])
            if k < len(seg):
                parts.append(self._windows(own[edge[seg[k]]:edge[stop[k]]]))
            at = k + 1
        return np.concatenate(parts)

    def _windows(self, own: np.ndarray) -> np.ndarray:
        """Viterbi over one long segment, whose windows of equal length advance
        together. What precedes a window matters only through the best scores
        at its last ``longest`` positions: a first pass gives, for each of them
        alone, the scores behind the window; these chain from window to window
        and give every window its true start for the second pass, which stores
        one byte of backpointer a character."""
        edge, most = self._edges(own), self.longest
        chars = len(edge) - 1
        k = np.arange(most, 0, -1)                            # last piece's characters; of equal scores the longest wins
        starts = np.arange(0, chars, WINDOW)
        groups = [(g, n) for x in range(0, chars // WINDOW, GROUP) for g, n in [(starts[x:min(x + GROUP, chars // WINDOW)], WINDOW)]]
        if chars % WINDOW:
            groups.append((starts[-1:], chars % WINDOW))

        def walk(group, n, past):
            """Scores at every position of a group's windows. ``past``: scores
            at the ``longest`` positions before, the farthest first."""
            lo, hi = max(0, group[0] - most), group[-1] + n
            rows = self._rows(own[edge[lo]:edge[hi]], edge[lo:hi] - edge[lo], edge[lo + 1:hi + 1] - edge[lo], np.int64(hi - lo))
            value = np.full((most, most + hi - lo), -np.inf)   # most columns in front: no piece starts before the text
            for m, row in zip(k.tolist(), rows[::-1]):
                value[most - m, most:] = np.where(row >= 0, self.scores[row], self.unknown_score if m == 1 else -np.inf)
            for end in range(1, n + 1):
                gain = value[most - k[:, None], group[None] - lo + most + end - k[:, None]]
                every = past + gain.reshape(gain.shape + (1,) * (past.ndim - 2))
                yield every
                past = np.concatenate([past[1:], every.max(axis=0)[None]])
            yield past

        moves = []
        for group, n in groups:
            past = np.full((most, len(group), most), -np.inf)
            past[np.arange(most), :, np.arange(most)] = 0
            for past in walk(group, n, past):
                pass
            moves.extend(past.transpose(1, 0, 2))              # window: score behind it x position before it
        start = np.full((len(starts) + 1, most), -np.inf)
        start[0, -1] = 0
        for w, move in enumerate(moves):
            start[w + 1] = (move + start[w]).max(axis=1)
            start[w + 1] -= start[w + 1].max()                 # only differences matter
        back, done = np.zeros(chars + 1, np.uint8), 0
        for group, n in groups:
            for end, every in enumerate(walk(group, n, start[done:done + len(group)].T), 1):
                if end <= n:
                    back[group + end] = most - every.argmax(axis=0)
            done += len(group)
        step, cut, at = back.tobytes(), bytearray(chars + 1), chars
        while at:
            cut[at] = 1
            at -= step[at]
        ends = np.flatnonzero(np.frombuffer(cut, np.uint8))
        begin, stop = edge[np.append(0, ends[:-1])], edge[ends]
        return self._ids(own, begin, stop, self.match(SpanHash(own)(begin, stop)))[0]

    def _advance(self, seg: np.ndarray, n: int, rows: list[np.ndarray], piece: np.ndarray) -> None:
        """Viterbi over segments of ``n`` characters, all at once. Of equal
        scores the longest last piece wins."""
        best = np.full((n + 1, len(seg)), -np.inf)
        best[0] = 0
        back = np.zeros((n + 1, len(seg)), np.int16)
        for end in range(1, n + 1):
            for k in range(min(self.longest, end), 0, -1):
                row = rows[k - 1][seg + end - k]
                score = np.where(row >= 0, self.scores[row], self.unknown_score if k == 1 else -np.inf) + best[end - k]
                better = score > best[end]
                best[end][better] = score[better]
                back[end][better] = k
        at = np.full(len(seg), n)
        live = np.arange(len(seg))
        while len(live):
            k = back[at[live], live].astype(np.int64)
            begin = at[live] - k
            place = seg[live] + begin
            found = np.empty(len(live), np.int64)
            for j in np.unique(k):
                use = k == j
                found[use] = rows[j - 1][place[use]]
            piece[place] = found
            at[live] = begin
            live = live[begin > 0]

    def decode(self, ids: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of id sequences without the leading space: (flat, lengths)."""
        n = self.piece_len[ids]
        flat = np.concatenate([self.piece_bytes[:0], *[ragged(self.piece_bytes, self.piece_at[ids[a:a + STRETCH]], n[a:a + STRETCH])
                                                       for a in range(0, len(ids), STRETCH)]])
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        ends = np.cumsum(per)
        size = total[ends] - total[ends - per]
        keep = np.ones(len(flat), bool)
        lead = (np.cumsum(size) - size)[size > 0]
        keep[lead[flat[lead] == 0x20]] = False
        gone = np.zeros(len(per), np.int64)
        gone[np.flatnonzero(size > 0)[flat[lead] == 0x20]] = 1
        return flat[keep], size - gone


class Encoder:
    """Encodes blocks of texts and remembers the segmentation of chunks."""

    def __init__(self, path: str):
        self.model = Model(path)
        self.cache = SpanCache(np.int32, CACHE_CHUNKS)

    def chunks(self, buf: np.ndarray, off: np.ndarray):
        """Spans and texts of the chunks: a run of spaces and what follows."""
        mark = np.zeros(len(buf) + 3, bool)
        mark[:len(buf)] = buf == 0xE2
        at = np.flatnonzero(mark[:len(buf)])
        at = at[at + 2 < len(buf)]
        at = at[(buf[at + 1] == 0x96) & (buf[at + 2] == 0x81)]
        begin = np.zeros(len(buf) + 3, bool)
        begin[at + 3] = True                                  # the byte behind a space mark
        text_start = np.zeros(len(buf) + 1, bool)
        text_start[off[:-1]] = True
        s = at[~begin[at] | text_start[at]]
        doc = np.searchsorted(off, s, side="right") - 1
        e = np.append(s[1:], len(buf))
        return s, np.minimum(e, off[doc + 1]), doc

    def block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and ids per (already marked) text."""
        texts = len(off) - 1
        s, e, doc = self.chunks(buf, off)
        if not len(s):
            return np.zeros(0, np.int32), np.zeros(texts, np.int64)
        long = e - s > STRETCH
        if long.any():          # too long to be remembered
            rest, n = np.flatnonzero(~long), np.zeros(len(s), np.int64)
            parts = [self.model.segment(buf, s[long], e[long])]
            n[long] = parts[0][1]
            if len(rest):
                parts.append(self._held(buf, s[rest], e[rest]))
                n[rest] = parts[1][1]
            start = np.empty(len(s), np.int64)
            for spans, (ids, per), base in zip((long, rest), parts, (0, len(parts[0][0]))):
                start[spans] = base + np.cumsum(per) - per
            flat = ragged(np.concatenate([ids for ids, _ in parts]), start, n) if len(rest) else parts[0][0]
        else:
            flat, n = self._held(buf, s, e)
        return flat, np.bincount(doc, weights=n, minlength=texts).astype(np.int64)

    def _held(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and ids per chunk, from the remembered segmentations."""
        key, cache = SpanHash(buf)(s, e), self.cache
        uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(cache) + len(uniq) > cache.limit:
            cache.clear()
        at, n, held = cache.find(uniq)
        if not held.all():
            w = first[~held]
            cache.add(uniq[~held], *self.model.segment(buf, s[w], e[w]))
            at, n, _ = cache.find(uniq)
        return ragged(cache.values, at[back], n[back]), n[back]

    def alone(self, raw: np.ndarray) -> np.ndarray:
        """One text, every chunk segmented by itself."""
        s, e, _ = self.chunks(raw, np.array([0, len(raw)]))
        return self.model.segment(raw, s, e)[0] if len(s) else np.zeros(0, np.int32)

    def encode(self, arr: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first, last, flat ids, ids per text, decodes to the text)."""
        space = pc.replace_substring(arr, SPACE, " ")
        marked = pc.replace_substring(pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(space), 0), "", " "), space, ""), " ", SPACE)
        buf, off = buffers(marked)
        want, want_off = buffers(space)
        for i, j in blocks(off, BLOCK):
            b, o = buf[off[i]:off[j]], off[i:j + 1] - off[i]
            ids, per = self.block(b, o)
            same = self.check(ids, per, want, want_off[i:j + 1])
            for k in np.flatnonzero(~same):   # shared hashes: encode this text on its own
                parts = np.split(ids, np.cumsum(per)[:-1])
                parts[k] = self.alone(b[o[k]:o[k + 1]])
                ids, per[k] = np.concatenate(parts), len(parts[k])
            if not same.all():
                same = self.check(ids, per, want, want_off[i:j + 1])
            yield i, j, ids, per, same

    def check(self, ids, per, want, off) -> np.ndarray:
        """Which texts decode to their bytes."""
        flat, size = self.model.decode(ids, per)
        ok = size == np.diff(off)
        if ok.all() and len(flat) <= BLOCK:
            diff = np.concatenate([[0], np.cumsum(flat != want[off[0]:off[-1]])])
            at = off - off[0]
            return diff[at[1:]] == diff[at[:-1]]
        ends = np.cumsum(size)
        for k in np.flatnonzero(ok):
            ok[k] = np.array_equal(flat[ends[k] - size[k]:ends[k]], want[off[k]:off[k + 1]])
        return ok


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and model."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, n_tokens, round_trip) for every row and whole text.

    ``model`` is a path that all executors can read. Null and empty texts have
    no ids. A literal U+2581 counts as a space. Repeated rows are encoded
    alike; extra columns are ignored; an empty table gives no rows.
    """
    rows = pick(docs, id=key, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in sliced(batches, 1):
            for i, j, ids, per, same in enc.encode(fill(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], list_array(ids, per, pa.int32()), pa.array(per, pa.int64()), pa.array(same)], ["id", "ids", "n_tokens", "round_trip"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, ids array<int>, n_tokens long, round_trip boolean").withColumnRenamed("id", key)


def decode(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of id arrays; null and empty arrays give empty texts. Byte
    pieces that are not valid UTF-8 become U+FFFD."""
    rows = pick(encoded, id=key, ids=ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = encoder(model).model
        for batch in batches:
            col = pc.fill_null(batch.column(1), [])
            per = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, size = m.decode(col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), per)
            raw, ends = flat.tobytes(), np.cumsum(size).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends)], pa.string())], ["id", "text"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, text string").withColumnRenamed("id", key)


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the public 32k pieces, each checked by decoding."""
    return encode(table(spark, sf_dir, "documents"), model_path())
