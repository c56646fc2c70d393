"""The pipeline's stages, each against what its operator says of the stage's input."""

import random
from collections import Counter

import corpus_pipeline
from tabfeat.llm import decontaminate, mixing, near_dedup, quality_rules
from tabfeat.session import scratch_path

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, benchmark = docs.columns, spark.read.parquet(f"{SF}/benchmark.parquet")
    expected = [
        lambda d: [r.doc_id for r in quality_rules.judge(d).where("kept").collect()],
        lambda d: [r.doc_id for r in near_dedup.near_duplicates(d).where("kept").collect()],
        lambda d: [r.doc_id for r in decontaminate.contamination(d, benchmark).where("NOT contaminated").collect()],
        lambda d: [r.doc_id for r in mixing.mix(d).collect() for _ in range(r.repeats)],
    ]
    for (name, stage), want in zip(corpus_pipeline.STAGES, expected):
        path = scratch_path(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == columns and sorted(r.doc_id for r in after.collect()) == sorted(want(docs)), name
        docs = after
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(final) == docs.count() > 0
    assert sorted(map(tuple, final)) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_empty_documents(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_stages_judge_rows_without_or_with_shared_doc_ids(spark, monkeypatch):
    """A rejected row takes no other along, and the mix meets its targets, whatever the doc_ids."""
    rng = random.Random(11)
    prose = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 7))) for _ in range(rng.randrange(20, 60))) for _ in range(120)]
    rows = [(None if i % 3 else 7, text, "en", "ab"[i % 2], i) for i, text in enumerate(prose)] + [(None, "", "en", "a", -1), (7, None, "en", None, -2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    few = sorted(r.n_chars for r in quality_rules.keep_good(docs).collect())
    monkeypatch.setattr(quality_rules, "MOST_GROUPS", 1)
    joined = quality_rules.keep_good(docs)
    assert joined.columns == docs.columns and sorted(r.n_chars for r in joined.collect()) == few and len(few) > 100

    mixed, targets = mixing.repeated(docs, share=0.4), {r.source: r.target for r in mixing.mix(docs, share=0.4).collect()}
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += len((r.text or "").split())
    for source in "ab":
        assert abs(taken[source] - targets[source]) <= 30, source


def test_stages_give_clashing_columns_and_rows_of_one_id_back(spark):
    """Rows that share a doc_id are judged by their texts; columns with the operators' own names come back as they were."""
    from tabfeat.llm import mixing, near_dedup, quality_rules

    texts = ["alpha beta gamma delta epsilon zeta eta theta", "wholly other words stand in this second text here", None]
    rows = [(1, texts[0], 100, 200, 300, "l", "s"), (1, texts[1], 101, 201, 301, "l", "s"), (2, texts[0], 102, 202, 302, "l", "s"),
            (None, texts[1], 103, 203, 303, "l", "s"), (None, texts[2], 104, 204, 304, "l", "s"), (3, texts[2], 105, 205, 305, "l", "s")]
    docs = spark.createDataFrame([(d, t, "en", "a", *more) for d, t, *more in rows],
                                 "doc_id long, text string, lang string, source string, _row int, _copy int, _null int, _lang_of string, _source_of string")
    left = near_dedup.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((r["_row"], r["_copy"], r["_null"]) for r in left.collect()) == [(100, 200, 300), (101, 201, 301), (104, 204, 304), (105, 205, 305)]
    twice = mixing.repeated(docs, share=4.0, max_epochs=2.0)
    assert twice.columns == docs.columns and sorted(r["_row"] for r in twice.collect()) == sorted([100, 101, 102, 103, 104, 105] * 2)
    assert quality_rules.keep_good(docs).columns == docs.columns
