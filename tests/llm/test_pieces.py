"""Viterbi encoding against a plain dynamic programme, the library's own
unigram lattice over the same pieces, and exact round trips."""

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import LONG, ROWS

from streamsift.llm import pieces

SMALL = "/root/testdata/sf0.001"
TEXTS = ["Hello  world", "   three spaces   ", "a", "", "tab\there\nline\r\n", "ñandú ÄÖÜß naïve", "😀😀 emoji 東京都 に住む", "x" * 400, "ab" * 900,
         "無空白の長い文章" * 60, "mixed123numbers 4567,89.0", "￿weird\x00null", " ", LONG[:3000], "don't stop-believing (ever)!", " nbsp　wide"]


@pytest.fixture(scope="module")
def enc():
    return pieces.Encoder(pieces.model_path())


def slow(model, text):
    """Segmentation of a marked text, character by character."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    order = np.argsort(model.ids)
    score = {sp.id_to_piece(int(model.ids[k])): (model.scores[k], int(model.ids[k])) for k in order}
    s = "▁" + text.replace(" ", "▁") if text else ""
    best, back = [0.0] + [-np.inf] * len(s), [None] * (len(s) + 1)
    for e in range(1, len(s) + 1):
        for n in range(min(model.longest, e), 0, -1):
            got = score.get(s[e - n:e])
            v = got[0] if got else (model.unknown_score if n == 1 else None)
            if v is not None and best[e - n] + v > best[e] + 1e-9:
                best[e], back[e] = best[e - n] + v, (n, got[1] if got else None)
    out, e = [], len(s)
    while e:
        n, i = back[e]
        out.append([i] if i is not None else [int(model.byte_ids[b]) for b in s[e - n:e].encode()])
        e -= n
    return [x for part in reversed(out) for x in part], best[-1]


def run(enc, texts):
    out = []
    for _, _, ids, per, same in enc.encode(pa.array(texts)):
        assert same.all()
        out += [x.tolist() for x in np.split(ids, np.cumsum(per)[:-1])]
    return out


def total(model, ids):
    score = dict(zip(model.ids.tolist(), model.scores.tolist()))
    return sum(score[i] for i in ids if i in score)


def test_equals_plain_viterbi(enc):
    for text, ids in zip(TEXTS, run(enc, TEXTS)):
        want, _ = slow(enc.model, text)
        assert len(ids) == len(want) and (ids == want or abs(total(enc.model, ids) - total(enc.model, want)) < 1e-6)


def test_decoding(enc):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for text, ids in zip(TEXTS, run(enc, TEXTS)):
        assert sp.decode(ids) == text
    assert run(enc, ["a▁b"]) == run(enc, ["a b"])


def test_equals_library_lattice(enc, spark, tmp_path):
    """The library's unigram segmentation with the same pieces and scores."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece
    m = pb.ModelProto()
    m.ParseFromString(open(pieces.model_path(), "rb").read())
    m.trainer_spec.model_type = 1
    for i, s in zip(enc.model.ids.tolist(), enc.model.scores.tolist()):
        m.pieces[i].score = s
    path = tmp_path / "unigram.model"
    path.write_bytes(m.SerializeToString())
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = run(enc, texts)
    same = [sp.encode(t) == ids for t, ids in zip(texts, got)]
    assert np.mean(same) > 0.97     # single-precision ties may fall the other way
    close = [abs(total(enc.model, sp.encode(t)) - total(enc.model, ids)) < 1e-3 * max(1, len(ids)) for t, ids in zip(texts, got)]
    assert all(close)


def test_shared_hash_is_noticed(enc):
    """A text whose chunk was given another chunk's ids is encoded anew."""
    other = pieces.Encoder(pieces.model_path())
    ids = other.block(*pieces.buffers(pa.array(["▁cat"])))[0]
    dog = pieces.SpanHash(np.frombuffer("▁dog".encode(), np.uint8))(np.array([0]), np.array([6]))
    other.cache.add(dog, ids, np.array([len(ids)]))
    assert run(other, ["dog"]) == run(enc, ["dog"])


def test_edge_cases(spark, edge, empty):
    coded = pieces.encode(edge, pieces.model_path()).cache()
    got = sorted(((r.doc_id, r.n_tokens, r.round_trip) for r in coded.collect()), key=str)
    assert len(got) == len(ROWS) and all(r[2] for r in got)
    assert sum(r[1] == 0 for r in got) == sum(not r[1] for r in ROWS)
    back = sorted(((r.doc_id, r.text) for r in pieces.decode(coded, pieces.model_path()).collect()), key=str)
    assert back == sorted(((r[0], r[1] or "") for r in ROWS), key=str)
    assert pieces.encode(empty, pieces.model_path()).count() == 0


def test_query(spark):
    got = pieces.op4_sentencepiece(spark, SMALL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id: r.text for r in pieces.decode(got, pieces.model_path()).collect()} == texts
    assert got.where("not round_trip or n_tokens != size(ids)").count() == 0


def test_long_chunks(enc, monkeypatch):
    """Stretches and windows change no score, wherever they cut."""
    rng = np.random.default_rng(5)
    texts = ["ab" * 300, "x" * 500, "無空白の長い文章" * 60, "".join(rng.choice(list("etaoinshr"), 1500)),
             "".join(rng.choice(list("aeñ無😀 ")) for _ in range(800)), "antidisestablishment" * 40, "😀" * 90, "=" * 333 + "the" * 200]
    whole = run(enc, texts)
    for stretch, window, group in ((64, 16, 3), (200, 37, 1), (50, 5, 4)):
        monkeypatch.setattr(pieces, "STRETCH", stretch)
        monkeypatch.setattr(pieces, "WINDOW", window)
        monkeypatch.setattr(pieces, "GROUP", group)
        for text, a, b in zip(texts, whole, run(pieces.Encoder(pieces.model_path()), texts)):
            assert a == b or abs(total(enc.model, a) - total(enc.model, b)) < 1e-6 * len(a), text[:20]


@pytest.mark.parametrize("piece", ["x", "無空白", "qz7"])
def test_eight_megabytes_without_spaces(piece):
    """Memory of a worker above its start stays below 400 MB."""
    import subprocess
    import sys
    code = f"""
import resource, pyarrow as pa
from streamsift.llm import pieces
enc = pieces.Encoder(pieces.model_path())
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
list(enc.encode(pa.array(["warm up"])))
before, text = peak(), {piece!r} * (8_000_000 // len({piece!r}.encode()))
(_, _, ids, per, same), = enc.encode(pa.array([text]))
assert same.all() and per.sum() == len(ids)
print(peak() - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 400, done.stdout
