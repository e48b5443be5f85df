import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair as cr
from tidemark.llm import queries

FOLDER = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
GOAL = re.compile(r"(s?(ua)+)?\Z")


def best(rows):
    """Cost, audit and repaired rows by a recursion over whole strings. rows: (role, text, fault)."""
    steps = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    @cache
    def go(i, state, inserted):
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                return 0, "", ()
        else:
            role, text, fault = rows[i]
            extra = 5 * (fault == "truncated")
            c, a, out = go(i + 1, state, 0)
            ways.append((c + 2, "D" + a, out))
            if fault not in ("blank", "duplicate"):
                if role[:1] in ("s", "u", "a") and (role[:1] == steps[state] or state == "" and role[:1] == "s"):
                    c, a, out = go(i + 1, role[:1], 0)
                    ways.append((c + extra, "K" + a, (f"{role}:{text}", *out)))
                c, a, out = go(i + 1, steps[state], 0)
                ways.append((c + extra + 1, "R" + a, (f"{full[steps[state]]}:{text}", *out)))
        if inserted < 3:
            c, a, out = go(i, steps[state], inserted + 1)
            ways.append((c + 5, "I" + a, (f"{full[steps[state]]}:", *out)))
        return min(ways, default=(10**9, "", ()))

    return go(0, "", 0)


def brute(rows):
    out = {}
    for conv in {r.conv_id for r in rows}:
        own = []
        for r in rows:
            if r.conv_id != conv:
                continue
            role, text = (" " if x is None else x for x in (r.role, r.text))
            lot = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
            if lot == 0:
                continue
            text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
            role = "user" if lot == 4 else role
            whole = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own += [(r.turn is not None, r.turn or 0, whole, role, text)] * (2 if lot == 3 else 1)
        own.sort()
        seen, marked, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, _, role, text in own:
            real = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not real else "duplicate" if (role, text) in seen else "truncated" if real[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
            if fault:
                count[fault] += 1
        turns = [x[1] for x in own if x[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, kept = best(tuple(marked))
        assert GOAL.match("".join(x[:1] for x in kept))
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def check(spark, df, **options):
    got = cr.repair_reports(spark, df, **options).collect()
    assert len(got) == len({r.conv_id for r in got})
    assert {r.conv_id: tuple(r)[1:] for r in got} == brute(df.collect())


def test_whole_table(spark):
    df = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, FOLDER).collect()}
    assert got == brute(df.collect())


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_random_conversations_in_blocks(spark, bits):
    draw = random.Random(bits)
    roles = ["user", "assistant", "system", "tool", "", None, "ufo"]
    texts = ["Fine.", "Cut", "", " \n", "Why?", None, "a. b ", "Fine.  \t"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(draw.choice([1, 2, 3, 5, 9, 40])):
            rows.append((conv, draw.choice([turn, turn, None, turn // 2]), draw.choice(roles[:3] if draw.random() < 0.7 else roles), draw.choice(texts) if draw.random() < 0.5 else f"Turn {turn}."))
    rows += rows[:10]
    check(spark, spark.createDataFrame(rows, TURNS).withColumns({"block": F.lit("x"), "seq": F.lit(1), "copies": F.lit(None).cast("int"), "conv": F.lit(2)}), bits=bits)


def test_empty_table_and_lost_conversations(spark):
    assert cr.repair_reports(spark, spark.createDataFrame([], TURNS)).collect() == []
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = cr.repair_reports(spark, spark.createDataFrame([(lost, 0, "user", "Hi.")], TURNS)).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_long_conversation(spark):
    draw = random.Random(3)
    rows = [(1, i, draw.choice(["user", "assistant"]), draw.choice(["Yes.", f"Number {i}.", "cut"])) for i in range(900)]
    check(spark, spark.createDataFrame(rows, TURNS).repartition(7), bits=5)


def test_ranks_order_audits():
    draw = random.Random(9)
    for _ in range(30):
        n = draw.randint(2, 60)
        label = np.array([draw.randint(1, 3) for _ in range(n)])
        to = np.array([draw.randint(i + 1, n - 1) if i + 1 < n else i for i in range(n)])
        label[-1] = 0

        def audit(v):
            return () if label[v] == 0 else (int(label[v]), *audit(to[v]))

        rank, _ = cr._doubled(label, to, n)
        known = sorted({audit(v) for v in range(n)})
        assert [known.index(audit(v)) for v in range(n)] == rank.tolist()


def test_costs_of_a_block_are_a_product():
    draw = random.Random(4)
    for n in (1, 2, 3, 7, 64, 101):
        codes = "".join(chr(ord("A") + draw.randrange(16)) for _ in range(n))
        ((cost, _, _),) = cr.solve([codes], [None])
        assert cost.tolist() == (cr.transfer(codes) + cr._AT_END).min(1).tolist()
