"""The pipeline's stages on rows of all kinds, each on its own input, and the whole run."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import decontam, linededup, neardup, store

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_do_not_crash(spark, tricky, no_documents, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, tricky, SF)
    assert got.columns == tricky.columns
    kept = got.select("doc_id", "word").collect()
    assert {r.word for r in kept} <= {r.word for r in tricky.collect()} and len({r.word for r in kept}) == len(kept)
    assert stage(spark, no_documents, SF).collect() == []


def test_near_dedup_keeps_one_document_of_each_group(spark, tricky):
    got = corpus_pipeline.near_dedup_stage(spark, tricky, SF)
    kept = {r.doc_id for r in neardup.near_duplicates(tricky).collect() if r.kept and r.doc_id is not None}
    assert {r.doc_id for r in got.collect() if r.doc_id is not None} == kept
    # repeated rows are one row, the first of them, and those without an id stay
    rows = [(r.doc_id, r.text) for r in got.collect()]
    assert sum(i is None for i, _ in rows) == tricky.filter("doc_id is null").count()
    named = [x for x in rows if x[0] is not None]
    assert len(named) == len(set(named)) == tricky.filter("doc_id is not null").select("doc_id", "text").distinct().filter(F.col("doc_id").isin(list(kept))).count()


def test_different_texts_of_one_doc_id_stay_together(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "another text of some words", "y"), (1, "a b c d e f", "w"), (2, "a b c d e f", "z")], "doc_id long, text string, lang string")
    assert sorted(map(tuple, corpus_pipeline.near_dedup_stage(spark, docs, SF).collect())) == [(1, "a b c d e f", "w"), (1, "another text of some words", "y")]


def test_line_dedup_and_decontamination_take_effect(spark, small):
    cut = {r.doc_id: r.n_removed for r in linededup.without_shared_lines(small).collect()}
    before = {r.doc_id: r.text for r in small.collect()}
    after = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, small, SF).collect()}
    for i, t in before.items():
        n = len(t.split("\n")) - cut[i]
        assert i not in after or len(after[i].split("\n")) == n
    leaks = {r.doc_id for r in decontam.leaks(small, spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")).collect()}
    left = {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, small, "/root/testdata/sf0.01").collect()}
    assert leaks and left == set(before) - leaks


def test_run_packs_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    want = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.packing_stage(spark, docs, SF).collect())
    got = corpus_pipeline.run(spark, SF).collect()
    ends = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == ends.get(r.doc_id, 0)
        ends[r.doc_id] = r.start + r.length
    assert all(ends[r.doc_id] == r.doc_tokens for r in got)
    assert {i for i, *_ in want} == set(ends) and sum(n for _, _, n, _ in want) == sum(r.length for r in got)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_folder(Session())
