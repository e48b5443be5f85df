import itertools
import random

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup as ld


def expected(rows):
    """{doc_id: (n_lines, removed places)} by comparing all lines with all."""
    lines = [(i, p, x) for i, t in rows for p, x in enumerate((t or "").split("\n")) if brute.WORD.search(x)]
    texts = sorted({x for _, _, x in lines})
    long = [x for x in texts if len(x) >= ld.LEAST]
    links = [(a, b) for a, b in itertools.combinations(long, 2) if abs(len(a) - len(b)) <= 1 and brute.edit_distance(a, b) <= 1]
    root = brute.groups(texts, links)
    first, out = {}, {}
    for i, p, x in sorted(lines, key=lambda v: (v[0] is not None, v[0] or 0, v[1])):
        n, gone = out.setdefault(i, [0, []])
        out[i][0] = n + 1
        if first.setdefault(root[x], (i, p)) != (i, p):
            gone.append(p)
    return {i: (n, gone) for i, (n, gone) in out.items()}


def result(spark, docs):
    return {r.doc_id: (r.n_lines, r.removed) for r in ld.repeated_lines(spark, docs).collect()}


def changed(draw, line):
    line, at = list(line), draw.randrange(len(line))
    kind = draw.randrange(3)
    if kind == 0:
        line[at] = draw.choice("abé")
    elif kind == 1:
        line.insert(at, draw.choice("abé"))
    else:
        line.pop(at)
    return "".join(line)


def test_automaton_equals_edit_distance(spark):
    draw, rows = random.Random(3), []
    for _ in range(300):
        a = "".join(draw.choice("abé") for _ in range(draw.randint(0, 30)))
        b = a
        for _ in range(draw.randint(0, 3)):
            b = changed(draw, b) if b else "a"
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string")
    for edits in (1, 2):
        for r in df.select("a", "b", ld.within(F.col("a"), F.col("b"), edits).alias("w")).collect():
            assert r.w == (brute.edit_distance(r.a, r.b) <= edits), (r, edits)


def test_equals_brute_force_on_families_of_lines(spark):
    draw = random.Random(9)
    bases = ["".join(draw.choice("abcdé f") for _ in range(n)) for n in (19, 20, 21, 22, 23, 40, 97, 300) for _ in range(3)]
    rows = []
    for i in range(60):
        lines = [draw.choice(bases) for _ in range(4)]
        lines = [changed(draw, x) if draw.random() < 0.5 else x for x in lines]
        lines = [changed(draw, x) if draw.random() < 0.3 else x for x in lines]
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(spark, docs) == expected(rows)


def test_awkward_rows(spark, nothing):
    line = "a line that is long enough to compare"
    rows = [(3, f"{line}\n\n {line}\n{line}!"), (1, None), (2, ""), (None, f"{line}\nshort\nshor"), (5, "short\n\t \nshort"), (4, "x" * 3_000), (6, "x" * 2_999)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("line", "place", "class", "doc", "id", "_id", "_removed")})
    assert result(spark, docs) == expected(rows)
    out = ld.without_repeated_lines(spark, docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1] is None and texts[2] == "" and texts[3] == "" and texts[5] == "\t " and texts[6] == ""
    assert ld.repeated_lines(spark, nothing).count() == 0
    plan = ld.repeated_lines(spark, docs)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if x in plan]


def classes(rows, edits):
    """{place: smallest place of its class} of the lines of one text, by comparing all lines with all."""
    texts = sorted(set(rows))
    links = [(a, b) for a, b in itertools.combinations(texts, 2) if abs(len(a) - len(b)) <= edits and brute.edit_distance(a, b) <= edits]
    root = brute.groups(texts, links)
    first = {}
    return [p for p, x in enumerate(rows) if first.setdefault(root[x], p) != p]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_any_threshold_and_lines_of_any_length(spark, edits):
    """Lines under 20 code points were compared for equality only, and no threshold but one edit could be had."""
    draw = random.Random(edits)
    lines = []
    for n in (3, 7, 12, 18, 19, 30, 60):
        for _ in range(3):
            base = "".join(draw.choice("abcdefghijé k") for _ in range(n)).strip() or "x"
            for _ in range(5):
                line = base
                for _ in range(draw.randint(0, edits + 1)):
                    line = changed(draw, line) if line else "a"
                lines.append(line if brute.WORD.search(line) else "w")
    lines += ["Read more: page 1", "Read more: page 2"]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    (row,) = ld.repeated_lines(spark, docs, edits).collect()
    assert row.n_lines == len(lines) and row.removed == classes(lines, edits)
    assert len(lines) - 1 in row.removed
