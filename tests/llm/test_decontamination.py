import brute
import compare
from pyspark.sql import functions as F

from tidemark.llm import decontamination as dc
from tidemark.llm import queries

FOLDER = "/root/testdata/sf0.001"


def expected(docs, items, percent=75):
    out = []
    for d in docs.collect():
        own = brute.shingles(d.text)
        for i in set(items.collect()):
            wanted = brute.shingles(i.text)
            if wanted and 100 * len(own & wanted) >= percent * len(wanted):
                out.append((d.doc_id, i.item_id, len(wanted), len(own & wanted)))
    return sorted(out, key=str)


def result(spark, docs, items):
    return sorted(map(tuple, dc.contaminated(spark, docs, items).collect()), key=str)


def test_equals_sql(spark):
    ours = compare.spark_rows(queries.op1_decontamination(spark, FOLDER))
    assert ours == compare.sql_rows(compare.connect(FOLDER), queries.SQL["op1_decontamination"])


def test_awkward_rows_and_items_of_all_sizes(spark, awkward, monkeypatch):
    text = {r.doc_id: r.text for r in awkward.collect()}
    long = text[11].split()
    items = spark.createDataFrame([
        (1, " ".join(long[5000:5020])), (2, " ".join(long[100:400])), (3, " ".join([*long[900:950], *["new"] * 6])), (4, None),
        (5, ""), (6, "ONE two three"), (7, " ".join(long[10:60] + long[40000:40050])), (None, text[4]), (8, "never said by anyone at all"),
        (1, " ".join(long[5000:5020])), (9, " ".join([*long[2000:2010], *["new"] * 30])),
    ], "item_id long, text string")
    want = expected(awkward, items)
    assert {(r[0], r[1]) for r in want} >= {(11, 1), (12, 2), (11, 3), (8, 6), (11, 7), (4, None)}
    assert result(spark, awkward, items) == want
    monkeypatch.setattr(dc, "BLOCK_SHINGLES", 100)
    assert result(spark, awkward, items) == want


def test_stage_keeps_columns_and_clean_rows(spark, awkward):
    items = spark.createDataFrame([(1, "One two three"), (2, None)], "item_id long, text string")
    docs = awkward.withColumn("item_id", F.lit(3)).withColumn("shingles", F.lit("x"))
    clean = dc.without_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in clean.collect()) == sorted(
        (str(r.doc_id), str(r.text)) for r in docs.where("doc_id is null or doc_id not in (8, 9)").collect())


def test_empty_tables(spark, nothing, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(spark, awkward, none).count() == 0
    assert dc.without_contaminated(awkward, none).count() == awkward.count()
    some = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert dc.contaminated(spark, nothing, some).count() == 0


def test_hits_needed_keep_the_miss_rate():
    assert 1 <= dc.hits_needed(75) < 0.75 * dc.FUNCTIONS
