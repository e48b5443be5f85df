import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality_rules as qr

FOLDER = "/root/testdata/sf0.001/documents.parquet"


def test_statistics_equal_brute_force(spark, awkward):
    for docs in (spark.read.parquet(FOLDER), awkward):
        got = docs.select("text", *[c.alias(n) for n, c in qr.text_statistics(F.col("text")).items()]).collect()
        for row in got:
            assert tuple(row)[1:] == brute.text_statistics(row.text)


def test_chi_square():
    assert qr.chi_square_quantile(0.975, 5) == pytest.approx(12.832502, abs=1e-5)
    assert qr.chi_square_below(2.0, 2) == pytest.approx(1 - np.exp(-1), abs=1e-12)


def test_verdicts_equal_plain_estimates(spark):
    """The same concentration steps in numpy, on the table."""
    docs = spark.read.parquet(FOLDER)
    verdicts = {r.doc_id: r for r in qr.quality_verdicts(spark, docs).collect()}
    rows = [r for r in docs.collect()]
    vectors, groups = {}, {}
    for r in rows:
        n, chars, symbols, dups, repeats = brute.text_statistics(r.text)
        failed = n < 50 or 100 * repeats > 50 * n
        assert verdicts[r.doc_id].base_failed == failed
        if not failed:
            v = [np.log1p(n), np.log(chars / n), symbols / n, np.log1p(dups), repeats / n]
            vectors[r.doc_id] = np.floor(np.array(v) * 1000 + 0.5) / 1000
            groups.setdefault((r.lang, r.source), []).append(r.doc_id)
    floors = np.diag(np.array(qr.FLOORS) ** 2)
    now = {}
    for g, ids in groups.items():
        x = np.floor(np.array([vectors[i] for i in ids]) * 100 + 0.5) / 100
        centre = np.median(x, axis=0)
        spread = np.median(np.floor(np.abs(x - centre) * 100 + 0.5) / 100, axis=0) * 1.4826
        now[g] = centre, np.diag(spread**2) + floors
    factor = qr.SUBSET / qr.chi_square_below(qr.chi_square_quantile(qr.SUBSET, 5), 7)

    def distance(x, g):
        y = x - now[g][0]
        return np.einsum("ij,jk,ik->i", y, np.linalg.inv(now[g][1]), y)

    for _ in range(qr.STEPS):
        close = {}
        for g, ids in groups.items():
            x = np.array([vectors[i] for i in ids])
            bins = np.floor(32 * np.log2(1 + distance(x, g)))
            last = np.sort(bins)[int(np.ceil(qr.SUBSET * len(ids))) - 1]
            close[g] = x[bins <= last]
        every = np.concatenate(list(close.values()))
        mean, covariance = every.mean(axis=0), np.cov(every.T, bias=True)
        for g, x in close.items():
            share = len(x) / (len(x) + qr.PRIOR)
            own = np.cov(x.T, bias=True) if len(x) > 1 else np.zeros((5, 5))
            now[g] = (share * x.mean(axis=0) + (1 - share) * mean, factor * (share * own + (1 - share) * covariance) + floors)
    cut = qr.chi_square_quantile(1 - qr.TAIL, 5)
    for g, ids in groups.items():
        for i, d in zip(ids, distance(np.array([vectors[i] for i in ids]), g), strict=True):
            assert verdicts[i].distance == pytest.approx(d, rel=1e-3, abs=1e-3)
            if abs(d - cut) > 0.1:
                assert verdicts[i].kept == (d <= cut)


def test_clean_documents_stay_and_junk_goes(spark):
    folder = "/root/testdata/sf0.01"
    verdicts = qr.quality_verdicts(spark, spark.read.parquet(f"{folder}/documents.parquet"))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    counts = {(r.quality, r.kept): r["count"] for r in verdicts.where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.005 * counts[1, True]
    assert counts.get((0, False), 0) > counts.get((0, True), 0)


def test_awkward_rows_columns_and_plan(spark, awkward, nothing):
    docs = awkward.withColumns({name: F.lit(1) for name in ("n_words", "doc", "kept", "v0", "m0", "bin", "e", "r")})
    verdicts = qr.quality_verdicts(spark, docs)
    plan = verdicts._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if x in plan]
    rows = verdicts.collect()
    assert len(rows) == docs.count()
    assert {r.doc_id for r in rows if not r.n_words} == {5, 6, 7}
    assert not any(r.kept for r in rows if r.n_words < 50)
    good = qr.keep_good(spark, docs)
    assert good.columns == docs.columns and good.count() == sum(r.kept for r in rows)
    assert qr.quality_verdicts(spark, nothing).count() == 0


def test_clean_labelled_documents_stay_and_symbol_junk_goes(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    verdicts = qr.quality_verdicts(spark, spark.read.parquet(f"{folder}/documents.parquet")).where("not base_failed")
    symbols = F.col("n_symbols") / F.col("n_words")
    cluster = F.when(symbols.between(0.2, 2), "junk").when(symbols < 0.05, "clean")
    rows = verdicts.join(labels, "doc_id", "left").groupBy(cluster.alias("cluster"), "quality", "kept").count().collect()
    kept = {(r.cluster, r.quality, r.kept): r["count"] for r in rows}
    assert kept.get(("clean", 1, False), 0) <= 0.005 * kept["clean", 1, True]
    assert not [k for k in kept if k[0] == "junk" and k[2]] and [k for k in kept if k[0] == "junk"]
