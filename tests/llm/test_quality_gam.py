import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import quality_gam as gam

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = gam.quality_scores(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), labels)
    rows = scores.join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.predicted for r in rows if r.quality == q] for q in (1, 0))
    assert len(rows) > 500 and sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.2
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 20)] + [(None, 1, 1), (3, None, 0), (1, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    docs = awkward.withColumns({n: F.lit(1) for n in ("features", "score", "quality", "predicted")})
    rows = gam.quality_scores(spark, docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= gam.THRESHOLD) for r in rows)
    again = gam.quality_scores(spark, docs.repartition(3), labels).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    none = labels.where("false")
    assert {r.score for r in gam.quality_scores(spark, awkward, none).collect()} == {0.5}
    assert gam.quality_scores(spark, nothing, labels).count() == 0


def test_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(gam, "fit", lambda values, labels: seen.append(len(labels)) or gam.Model(start=0.5))
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    gam.quality_scores(spark, docs, labels, most_rows=500)
    assert 400 < seen[0] <= 500


def test_tables_learn_single_numbers_and_pairs():
    draw = np.random.default_rng(0)
    x = draw.random((4000, len(gam.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.4)).astype(float)  # no single number tells anything
    model = gam.fit(x[:3000], y[:3000])
    assert (2, 5) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    y = (x[:, 7] > 0.3).astype(float)
    assert ((gam.fit(x[:3000], y[:3000]).score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97


def test_features_of_odd_texts():
    table = gam.features(pa.array([None, "", " \n ", "a", "A!\n\nA!", "#" * 100_000, "é " * 10]))
    assert np.isfinite(table).all() and not table[:3].any() and table[4, gam.FEATURES.index("repeat_line_share")] == 0.5
