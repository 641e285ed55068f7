import sys

sys.path.insert(0, "tests")

import pytest  # noqa: E402
from compare import DATA, assert_same  # noqa: E402

import corpus_pipeline  # noqa: E402
from pagewright.llm.registry import ORACLES, QUERIES  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, DATA), ORACLES[name])


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    assert set(out.doc_id) <= set(docs.doc_id) and out.doc_id.is_unique
    assert len(out) > 0.7 * len(docs)


def test_each_stage_returns_documents(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_docs, no_docs):
            out = stage(spark, docs, DATA)
            out.count()
            if name != "mixing":
                assert out.columns == COLUMNS
        clean = spark.createDataFrame([(1, "A clean text of some words that nothing else holds.", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
        assert stage(spark, clean, DATA).count() == 1


def test_what_each_stage_removes(spark):
    """Noise, shared lines, near copies and benchmark passages go, where they are due; clean documents stay as they are."""
    import random

    from samples import prose

    r = random.Random(3)
    noise = " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(3, 9))) for _ in range(60))
    rows = [(i, " ".join(prose(i, 60))) for i in range(40)]
    rows += [(100, noise), (101, "123 !!"), (102, None)]
    line = "this line is in several documents of the corpus"
    rows += [(110 + k, f"{line}\n" + " ".join(prose(f"line{k}", 60))) for k in range(3)]
    copy = prose("copy", 120)
    rows += [(120, " ".join(copy)), (121, " ".join([*copy[:-1], "changed"])), (122, " ".join(copy).upper())]
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").filter("length(text) > 100").first()["text"]
    rows += [(130, " ".join(prose("leak", 30)) + " " + item)]
    docs = spark.createDataFrame([(i, t, None if i == 100 else "en", f"s{i % 3}", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    had = {i for i, _ in rows}
    gone = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), name)
        now = {x["doc_id"]: x["text"] for x in docs.collect()}
        gone[name], had = had - set(now), set(now)
        if name == "line_dedup":
            assert [line in now[110 + k] for k in range(3)] == [False, False, True]
    assert gone == {"language_id": {100, 101, 102}, "line_dedup": set(), "near_dedup": {121, 122}, "decontamination": {130}}
    assert all(now[i] == t for i, t in rows[:40])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {x["doc_id"] for x in out} == had


def test_near_dedup_keeps_texts_that_share_an_id(spark, odd_docs):
    out = corpus_pipeline.near_dedup(spark, odd_docs, DATA).collect()
    had = {r["text"] for r in odd_docs.collect() if r["doc_id"] == 3}
    assert len(had) == 2 and had == {r["text"] for r in out if r["doc_id"] == 3}
    rows = [(None, f"text {k} without an id and with words of its own {k * k}") for k in range(5)] + [(7, "Text 2 without an id  and with words of its own 4"), (8, "one more"), (8, "one  more"), (9, "")]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    out = corpus_pipeline.near_dedup(spark, docs, DATA).collect()
    assert sorted((r["doc_id"] or 0, " ".join(r["text"].split())) for r in out) == sorted([(0, r[1]) for r in rows[:5]] + [(8, "one more"), (9, "")])
