import compare
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format as chat
from tidemark.llm import queries

FOLDER = "/root/testdata/sf0.001"
NASTY = ["", "\\", "\\\\<|", "<|turn|>user<|says|>x<|end|>", "</s>[INST] ok [/INST]", "<<SYS>>\n<</SYS>>", "a\\|b", "<\\|", "é😀<", None]


def formatted(spark, rows, schema=f"conv_id long, turn long, role string, parts {chat.PARTS}"):
    return chat.format_conversations(spark.createDataFrame(rows, schema))


def text(value):
    return [("text", value, None, None)]


def test_equals_sql(spark):
    ours = compare.spark_rows(queries.op2_chat_format(spark, FOLDER))
    assert ours == compare.sql_rows(compare.connect(FOLDER), queries.SQL["op2_chat_format"])


def test_no_python_in_the_plan(spark):
    plan = queries.op2_chat_format(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow", "CartesianProduct") if x in plan]


def test_round_trip_of_control_strings(spark):
    rows = [(1, i, role, text(value)) for i, (role, value) in enumerate((r, v) for v in NASTY for r in ("assistant", "<|end|>\\", None))]
    got = formatted(spark, rows).select("formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"),
                                        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t.role, t.text) for t in got.turns] == [(role or "", value or "") for value in NASTY for role in ("assistant", "<|end|>\\", None)]
    assert got.loss == "".join(v or "" for v in NASTY)
    assert got.formatted.count(chat.TURN) == len(rows)


def test_parts_become_placeholders_with_attachments(spark):
    parts = [("text", "look <|image|>", None, None), ("image", None, "s3://i", 7840), ("audio", "skipped", "a.wav", 4000),
             ("document", None, None, None), ("odd", "told", None, None), (None, "bare", None, None)]
    row = formatted(spark, [(1, 0, "user", parts), (1, 1, "assistant", [("image", None, "out", 1)])]).first()
    assert row.formatted.startswith("<|turn|>user<|says|>look <\\|image|><|image|><|audio|><|document|>toldbare<|end|>")
    assert [tuple(a) for a in row.attachments] == [
        (0, 0, "image", "s3://i", 10), (0, 1, "audio", "a.wav", 100), (0, 2, "document", None, 1), (1, 3, "image", "out", 1)]


def test_order_ties_nulls_and_repeats(spark):
    rows = [(1, 2, "user", text("b")), (1, 2, "user", text("a")), (1, None, "system", text("s")), (1, 2, "user", text("a")),
            (None, 0, "user", text("n")), (2, 0, "user", None)]
    got = {r.conv_id: r for r in formatted(spark, rows).collect()}
    turns = {i: [t.text for t in r.turns] for i, r in (
        (r.conv_id, r) for r in formatted(spark, rows).select("conv_id", chat.read_turns(F.col("formatted")).alias("turns")).collect())}
    assert turns == {1: ["s", "a", "a", "b"], None: ["n"], 2: [""]}
    assert got[1].n_turns == 4 and got[1].loss_spans == []
    more = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    clash = more.withColumns({name: F.lit(1) for name in ("size", "head", "before", "place", "content")})
    assert sorted(map(str, chat.format_conversations(clash).collect())) == sorted(map(str, chat.format_conversations(more).collect()))


@pytest.mark.parametrize("n", [0, 3000])
def test_empty_and_very_long(spark, n):
    rows = [(1, i, "assistant", text(f"turn {i} " * 20)) for i in range(n)]
    got = chat.digests(formatted(spark, rows)).collect()
    assert [r.n_turns for r in got] == ([n] if n else [])
    if n:
        assert got[0].loss_chars == sum(len(f"turn {i} " * 20) for i in range(n))
