import compare
import brute
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tidemark.llm import queries
from tidemark.session import work_dir

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumns({n: F.lit(n) for n in ("size", "class", "v0", "kept")})
    benchmark = [brute.shingles(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    folder, columns, seen = work_dir(spark, "stages"), docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES:
        before = docs
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen.append(docs.count())
        texts = {r.doc_id: r.text for r in before.collect()}
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "near_dedup":
            roots = brute.near_components(texts)
            assert left == {i for i in texts if roots[i] == i}
        if name == "decontamination":
            dirty = {i for i, t in texts.items() if any(len(b & brute.shingles(t)) >= 0.75 * len(b) for b in benchmark if b)}
            assert left == texts.keys() - dirty
        if name != "token_output":
            assert docs.columns == columns
        assert left <= texts.keys()
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert seen[-1] == seen[-2] and seen[1] < seen[0]


def test_run_gives_the_last_stage(spark):
    rows = pipeline.run(spark, FOLDER).orderBy("start").collect()
    assert rows and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_empty_documents(spark, nothing):
    docs = nothing
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def test_all_operators_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {name.split("_")[0] for name in queries.QUERIES}
    assert names.keys() >= {*queries.QUERIES, "pipeline"}
    assert set(queries.SQL) <= set(queries.QUERIES) and entry.oracle_sql().keys() >= set(queries.SQL)
    assert compare.TABLES
