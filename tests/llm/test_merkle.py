import hashlib
import random
import string
import zlib

import compare
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, queries

FOLDER = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return h(enc(row.doc_id), enc(row.source), enc(row.lang), enc(row.n_chars), enc(text))


def climbed(digests):
    """All levels of a tree, and per leaf its path of (left, right) digests."""
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i:i + 8]) for i in range(0, len(below), 8)])
    paths = []
    for at in range(len(digests)):
        path = []
        for level in levels[:-1]:
            run = at // 8 * 8
            path.append((level[run:at], level[at + 1:run + 8]))
            at //= 8
        paths.append(path)
    return levels[-1][0], paths


def brute(rows):
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, subroots = {}, []
    for lang in langs:
        own = sorted((r for r in rows if r.lang == lang), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        subroot, paths = climbed([leaf(r, r.text) for r in own])
        trees[lang] = own, paths
        subroots.append(subroot)
    if not rows:
        return []
    root, tops = climbed(subroots)
    out = []
    for lang, subroot, top in zip(langs, subroots, tops):
        for row, path in zip(*trees[lang]):
            text = row.text
            if row.doc_id is not None and text is not None and zlib.crc32(str(row.doc_id).encode()) % 3 == 0:
                text = text.translate(LOWER)
            current = leaf(row, text)
            for left, right in path + top:
                current = h(*left, current, *right)
            proof = h(*[x for left, right in path + top for x in (*left, *right)])
            out.append((row.doc_id, leaf(row, row.text), subroot, root, proof, current, current == root))
    return out


def key(row):
    return tuple(str(x) for x in row)


def check(spark, docs, **options):
    got = merkle.manifest(spark, docs, **options).drop("tampered", "copied_nodes").collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(docs.collect()), key=key)


def test_equals_sql(spark):
    ours = compare.spark_rows(queries.op11_merkle_manifest(spark, FOLDER))
    assert ours == compare.sql_rows(compare.connect(FOLDER), queries.SQL["op11_merkle_manifest"])


def test_awkward_rows(spark, awkward):
    check(spark, awkward.withColumns({"tree": F.lit(1), "block": F.lit("x"), "digest": F.lit(None).cast("string")}))


def test_empty_table(spark, nothing):
    assert merkle.manifest(spark, nothing).collect() == []


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_blocks_and_tiers_do_not_change_the_tree(spark, levels):
    draw = random.Random(levels)
    rows = [(i, f"Text {draw.randint(0, 9)}", "en", "a", i) for i in range(700)]
    rows += [(5, "Text", f"l{i:02}", "b", None) for i in range(70)] + [(None, None, None, None, None)] * 9
    rows += [(77, "Equal rows", "hot", "c", 1)] * 300
    check(spark, spark.createDataFrame(rows, DOCUMENTS), levels=levels)


def test_more_than_a_block(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Word "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    check(spark, docs)


@pytest.mark.parametrize("size", [1, 2, 8, 9, 64, 65, 500])
def test_versions_share_what_they_did_not_touch(size):
    leaves = [h(str(i)) for i in range(size)]
    levels = merkle.levels_of(size, 9)
    tree = merkle.grown(leaves, levels)

    def nodes(node):
        return {id(node): node} | {k: v for child in node.children for k, v in nodes(child).items()}

    known, versions = nodes(tree), []
    for at in range(0, size, 7):
        version = merkle.with_leaf(tree, at, levels, h("new"))
        versions.append(version)
        assert version.digest == climbed([*leaves[:at], h("new"), *leaves[at + 1:]])[0]
        assert len(nodes(version).keys() - known.keys()) == levels + 1
    assert tree.digest == climbed(leaves)[0]


def test_a_change_of_ones_own(spark, near_family):
    got = merkle.manifest(spark, near_family, F.col("doc_id") == 3, F.lit("forged")).collect()
    assert [r.doc_id for r in got if not r.verified] == [3]
    assert {r.copied_nodes for r in got} == {0, 3}
