"""The pipeline's decisions against brute force, stage by stage."""

import corpus_pipeline
from streamsift.llm.common import durable
from streamsift.llm import pieces, toxicity
from test_files import brute_dedup
from test_near import brute_classes, brute_leaks, grams, words

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark):
    from streamsift.llm.common import table
    docs = table(spark, SMALL, "documents")
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "minhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        before = rows(docs)
        out = durable(stage(spark, docs, SMALL))
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score_toxicity(spark, docs, SMALL).where("toxic").collect()}
            want = [r for r in before if r[0] not in bad]
        elif name == "exact_dedup":
            kept = {x[0] for x in brute_dedup(before) if x[3]}
            want = [r for r in before if r[0] in kept]
        elif name == "minhash_near_dedup":
            kept = {d for d, c, _ in brute_classes(before) if d == c}
            want = [r for r in before if r[0] in kept]
        elif name == "benchmark_decontamination":
            shared = set().union(*[set(grams(words(t))) for _, t in items])
            hold = [r for r in before if shared & set(grams(words(r[1])))]
            leaked = {x[0] for x in brute_leaks(hold, items)}
            want = [r for r in before if r[0] not in leaked]
        else:
            assert sorted((r.doc_id, r.text) for r in pieces.decode(out, pieces.model_path()).collect()) == before
            break
        assert rows(out) == want
        docs = out
    assert sorted(map(str, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(str, out.collect()))


def test_empty_and_edge_documents(spark, edge, empty):
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            if name != "sentencepiece":
                assert out.columns == docs.columns
                docs = out
        assert out.count() <= 17


def test_one_row_of_a_group_stays(spark):
    """Equal ids with other texts, and rows that are equal in all columns."""
    base = [f"w{i}" for i in range(120)]
    near = [" ".join(base[:k] + ["changed"] + base[k + 1:]) for k in (5, 50, 100)]
    other = " ".join(f"z{i}" for i in range(80))
    rows = [(0, near[0]), (1, other), (1, near[1]), (1, near[1]), (None, near[2]), (None, other), (2, other.upper()), (3, "a b c"), (3, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    once = durable(corpus_pipeline.exact_dedup(spark, docs, SMALL))
    assert rows_of(once) == sorted([(0, near[0]), (1, near[1]), (None, near[2]), (2, other.upper()), (3, "a b c")], key=str)
    assert rows_of(corpus_pipeline.minhash_near_dedup(spark, once, SMALL)) == sorted([(0, near[0]), (2, other.upper()), (3, "a b c")], key=str)
    twice = corpus_pipeline.minhash_near_dedup(spark, docs, SMALL)
    assert rows_of(twice) == sorted([(0, near[0]), (1, other), (3, "a b c")], key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
