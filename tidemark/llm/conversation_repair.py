"""Repair of conversation structure by cheapest edits, the ASCII-least of equally cheap ones.

A repaired conversation is empty or reads ``(s?(ua)+)`` in role initials. A turn may be kept (0), get
another role (1) or be deleted (2, a must for blank and repeated ones); empty turns may be inserted (5);
a truncated turn that stays costs 5 more. An audit names the edits in order: K, R, D, I.

The nodes of the search are (turns read, state of the pattern). Costs run backwards over a block of turns.
The arcs that keep a node's cost optimal are then ranked by prefix doubling: a node's rank by its audit's
first letter, its first two, four, eight, from the ranks of itself and of the node as many letters on.
Every node takes the optimal arc with the least (letter, rank of its end), and the doubled pointers of
these arcs spell the path. Conversations are cut into blocks of at most 4,096 turns, so a very long one
is spread over tasks: blocks exchange a 4 x 4 matrix of costs and four end states, never their turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import work_dir

BLOCK_BITS = 12
SPACES = " \t\n\x0b\x0c\r"
TURNS = ("conv_id", "turn", "role", "text")

# States of the pattern: nothing yet, after system, after user, after assistant (the first and last may end).
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = np.array([USER, USER, ASSISTANT, USER])
_ENDS = np.array([True, False, False, True])
_FAR = np.int64(1) << 40
_DELETE, _INSERT, _REROLE, _TRUNCATED = 2, 5, 1, 5
FINE, BLANK, DUPLICATE, CUT = range(4)
# A turn as one letter: class of the role's initial (s, u, a, other) times four, plus its fault.
_FIRST = ord("A")
_END, _EXIT = 16, 17  # what stands after a block's turns: the end of the conversation, or the next block


def _keep_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By letter and state: cost of keeping a turn, the state after it, and the cost of a new role."""
    cost, to, rerole = np.full((18, 4), _FAR), np.zeros((18, 4), np.int64), np.full(18, _FAR)
    follows = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
    for kind in range(4):
        for fault, extra in ((FINE, 0), (CUT, _TRUNCATED)):
            rerole[4 * kind + fault] = _REROLE + extra
            for state in range(4):
                if (state, kind) in follows:
                    cost[4 * kind + fault, state], to[4 * kind + fault, state] = extra, follows[state, kind]
    return cost, to, rerole


_KEEP, _KEEP_TO, _REROLES = _keep_tables()


def _row_matrices() -> np.ndarray:
    """By letter the least cost from a state before a turn to a state after it, insertions before it included."""
    insert = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for state in range(4):
        insert[state, _NEXT[state]] = _INSERT
    insert = (insert[:, :, None] + insert[None]).min(1)
    out = np.full((16, 4, 4), _FAR)
    for letter in range(16):
        step = np.where(np.eye(4, dtype=bool), _DELETE, _FAR)
        for state in range(4):
            to = _KEEP_TO[letter, state]
            step[state, to] = min(step[state, to], _KEEP[letter, state])
            step[state, _NEXT[state]] = min(step[state, _NEXT[state]], _REROLES[letter])
        out[letter] = (insert[:, :, None] + step[None]).min(1)
    return np.minimum(out, _FAR)


_ROWS = _row_matrices()
_AT_END = np.array([0, 2 * _INSERT, _INSERT, 0])


def letters(codes: str) -> np.ndarray:
    return np.frombuffer(codes.encode(), np.uint8).astype(np.int64) - _FIRST


def transfer(codes: str) -> np.ndarray:
    """The cost matrix of a block: min-plus product of its turns' matrices, halved until one is left."""
    chain = _ROWS[letters(codes)]
    while len(chain) > 1:
        odd = chain[-1:] if len(chain) % 2 else chain[:0]
        pairs = chain[:len(chain) // 2 * 2]
        chain = np.concatenate([(pairs[0::2, :, :, None] + pairs[1::2, None]).min(2), odd])
    return np.minimum(chain[0], _FAR)


def _doubled(label: np.ndarray, to: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of the nodes by their audits, and the pointers 1, 2, 4, … letters on.

    An audit that has ended goes on with a letter below all others, so a prefix ranks first.
    """
    rank, pointers = label, [to]
    for _ in range(max(longest, 1).bit_length()):
        ahead = pointers[-1]
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[ahead], return_inverse=True)
        pointers.append(ahead[ahead])
    return rank, pointers


def solve(blocks: list[str], after: list[np.ndarray | None]) -> list[tuple[np.ndarray, list[str], list[int]]]:
    """For every block its least costs by entry state, its scripts by entry state and the states they end in.

    ``after`` holds the costs that the next block begins with, or None where the conversation ends. A
    script is an audit that names roles too: K and D; U and A for a new role user or assistant; u and a
    for an inserted turn.
    """
    lengths = np.array([len(codes) for codes in blocks], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    first, last = starts[:-1], starts[:-1] + lengths
    code = np.empty(starts[-1], np.int64)
    cost = np.full((starts[-1], 4), _FAR)
    for block, (codes, at, end, later) in enumerate(zip(blocks, first, last, after)):
        code[at:end] = letters(codes)
        code[end], cost[end] = (_END, _AT_END) if later is None else (_EXIT, later)
    for back in range(1, int(lengths.max()) + 1):
        at = last[lengths >= back] - back
        cost[at] = (_ROWS[code[at]] + cost[at + 1][:, None, :]).min(2)

    row, state = np.repeat(np.arange(len(code)), 4), np.tile(np.arange(4), len(code))
    kind, mine, inside = code[row], cost.ravel(), code[row] < _END
    onward = np.minimum(row + 1, len(code) - 1)
    ways = []  # in the order of their letters: D, I, K, R
    for price, to in (
        (np.where(inside, _DELETE, _FAR), 4 * onward + state),
        (np.where((kind != _EXIT) & ~((kind == _END) & _ENDS[state]), _INSERT, _FAR), 4 * row + _NEXT[state]),
        (np.where(inside, _KEEP[kind, state], _FAR), 4 * onward + _KEEP_TO[kind, state]),
        (np.where(inside, _REROLES[kind], _FAR), 4 * onward + _NEXT[state]),
    ):
        ways.append((price + mine[to] == mine, to))
    best = np.stack([way for way, _ in ways])
    targets = np.stack([to for _, to in ways])
    nodes = np.arange(4 * len(code))
    stops = ~best.any(0)
    label = np.where(stops, 0, best.argmax(0) + 1)
    to = np.where(stops, nodes, targets[best.argmax(0), nodes])
    rank, _ = _doubled(label, to, 3 * int(lengths.max()) + 3)
    order = np.where(best, (np.arange(4)[:, None] + 1) * (int(rank.max()) + 1) + rank[targets], np.iinfo(np.int64).max)
    pick = order.argmin(0)
    label, to = np.where(stops, 0, pick + 1), np.where(stops, nodes, targets[pick, nodes])
    _, pointers = _doubled(label, to, 3 * int(lengths.max()) + 3)

    path, step = np.arange(4 * len(blocks)), np.zeros(4 * len(blocks), np.int64)
    at = (4 * first[:, None] + np.arange(4)).ravel()
    ends = pointers[-1][at]
    for level in range(len(pointers) - 2, -1, -1):  # the nodes 2^level letters on, between those known
        halfway = pointers[level][at]
        path, step, at = np.tile(path, 2), np.concatenate([step, step + (1 << level)]), np.concatenate([at, halfway])
        on = label[at] > 0
        path, step, at = path[on], step[on], at[on]
    in_order = np.lexsort([step, path])
    path, at = path[in_order], at[in_order]
    assistant = (_NEXT[at % 4] == ASSISTANT).astype(np.int64)
    text = np.frombuffer(b"DDuaKKUA", np.uint8)[2 * (label[at] - 1) + assistant].tobytes().decode()
    bounds = np.searchsorted(path, np.arange(4 * len(blocks) + 1))
    scripts = [text[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return [(cost[at], scripts[4 * i:4 * i + 4], (ends[4 * i:4 * i + 4] % 4).tolist()) for i, at in enumerate(first)]


def damaged(turns: DataFrame) -> DataFrame:
    """The fixed damage, chosen by the CRC-32 of ``conv_id:turn``. Nulls in texts and roles become one space.

    ``copies`` is 2 where a row is repeated.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    lot = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    whole = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), lot.alias("lot"))
    return whole.where("lot <> 0").select(
        "conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("lot") == 3, 2).otherwise(1).alias("copies"),
    )


def _conv() -> Column:
    """A conversation's name, never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))


def _same(role: str = "role", text: str = "text") -> Column:
    """128 bits that tell role and text apart from any other pair."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


def _turn() -> Column:
    return F.coalesce(F.col("turn").cast("string"), F.lit("-"))


@dataclass(frozen=True)
class Repair:
    """``reports``: a row per conversation with rows: counts, cost and script pieces. ``turns``: what stands.

    ``turns`` has a row per surviving place: conv, conv_id, block, place, and ``parts`` (role, text) in order.
    """

    reports: DataFrame
    turns: DataFrame


def _marked(spark: SparkSession, turns: DataFrame, work: str, bits: int) -> DataFrame:
    """Blocks of turns in order: a letter per turn, and what finds its text again."""
    ending = F.rtrim(F.col("text"), F.lit(SPACES))
    copies = F.array_repeat(F.lit(0), F.col("copies") if "copies" in turns.columns else F.lit(1))
    turns.select(
        _conv().alias("conv"), "conv_id", "turn", _same().alias("same"), F.substring("role", 1, 1).alias("initial"),
        (ending == "").alias("blank"), (~F.substring(ending, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.explode(copies).alias("copy"),
    ).drop("copy").withColumn("salt", F.monotonically_increasing_id()).write.parquet(f"{work}/slots")
    keys = ["conv", "turn", "same", "salt"]
    in_order = spark.read.parquet(f"{work}/slots").repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    in_order.withColumn("seq", F.monotonically_increasing_id()).write.parquet(f"{work}/ordered")
    ordered = spark.read.parquet(f"{work}/ordered")
    firsts = ordered.where(~F.col("blank")).groupBy("conv", "same").agg(F.min("seq").alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("seq") > F.col("first"), DUPLICATE).when(F.col("cut"), CUT).otherwise(FINE)
    kind = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    marked = ordered.join(firsts, ["conv", "same"], "left").withColumn("code", F.char(_FIRST + 4 * kind + fault))
    slot = F.struct("seq", "code", _turn().alias("turn"), "same")
    blocks = marked.groupBy("conv", F.shiftright("seq", bits).alias("block")).agg(
        F.any_value("conv_id").alias("conv_id"), F.sort_array(F.collect_list(slot)).alias("slots"))
    codes = F.array_join(F.transform("slots", lambda s: s["code"]), "")
    blocks.withColumn("codes", codes).write.parquet(f"{work}/blocks")
    return spark.read.parquet(f"{work}/blocks")


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [transfer(codes).ravel().tolist() for codes in batch["codes"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"conv": batch["conv"], "block": batch["block"], "costs": pa.array(costs, pa.list_(pa.int64()))})


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs after every block but the last of a conversation, found from its end."""
    for batch in batches:
        for conv, chain in zip(batch["conv"].to_pylist(), batch["chain"].to_pylist()):
            later, blocks, costs = _AT_END, [], []
            for here, above in zip(chain[::-1], chain[-2::-1]):
                later = (np.array(here["costs"]).reshape(4, 4) + later).min(1)
                blocks.append(above["block"])
                costs.append(later.tolist())
            yield pa.RecordBatch.from_pydict({"conv": [conv] * len(blocks), "block": pa.array(blocks, pa.int64()),
                                              "later": pa.array(costs, pa.list_(pa.int64()))})


def _illegal(codes: np.ndarray) -> int:
    """Neighbours whose initials are not su, ua or au."""
    kinds = codes // 4
    pairs = 4 * kinds[:-1] + kinds[1:]
    return int(len(pairs) - np.isin(pairs, (4 * 0 + 1, 4 * 1 + 2, 4 * 2 + 1)).sum())


_SOLVED = "conv string, block long, codes string, costs array<long>, scripts array<string>, ends array<long>, illegal long"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for low in range(0, whole.num_rows, 1024):
            batch = whole.slice(low, 1024)
            codes = batch["codes"].to_pylist()
            later = [None if x is None else np.array(x, np.int64) for x in batch["later"].to_pylist()]
            found = solve(codes, later)
            longs, texts = pa.list_(pa.int64()), pa.list_(pa.string())
            yield pa.RecordBatch.from_pydict({
                "conv": batch["conv"], "block": batch["block"], "codes": batch["codes"],
                "costs": pa.array([x[0].tolist() for x in found], longs), "scripts": pa.array([x[1] for x in found], texts),
                "ends": pa.array([x[2] for x in found], longs), "illegal": pa.array([_illegal(letters(x)) for x in codes], pa.int64()),
            })


_PIECES = "conv string, cost long, illegal long, pieces array<struct<block: long, script: string>>"


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's script: each block begins in the state its predecessor ended in."""
    for batch in batches:
        rows = []
        for conv, chain in zip(batch["conv"].to_pylist(), batch["chain"].to_pylist()):
            state, pieces, illegal, before = START, [], 0, None
            for part in chain:
                pieces.append({"block": part["block"], "script": part["scripts"][state]})
                state = part["ends"][state]
                illegal += part["illegal"]
                if before is not None:
                    illegal += _illegal(letters(before + part["codes"][0]))
                before = part["codes"][-1]
            rows.append({"conv": conv, "cost": chain[0]["costs"][START], "illegal": illegal, "pieces": pieces})
        if rows:
            table = pa.Table.from_pylist(rows, pa.schema([
                ("conv", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()),
                ("pieces", pa.list_(pa.struct([("block", pa.int64()), ("script", pa.string())])))]))
            yield from table.to_batches()


def repair(spark: SparkSession, turns: DataFrame, bits: int = BLOCK_BITS) -> Repair:
    """Repair conversations given as rows (conv_id, turn, role, text, and optionally copies).

    Turns are taken by number, nulls first, and equal numbers by a digest of role and text, so a repeat
    stands next to its original. A null conversation id is a conversation of its own. Roles and texts
    must not be null. Other columns are ignored. A role is known by its first letter; any but s, u and a
    fits nowhere. An empty table gives empty tables.

    Rows of some 60 bytes go through the search; texts are read once more at the end, for the turns that
    stand. One conversation's blocks meet in one task as 4 x 4 matrices and as its script, never as text.
    """
    work = work_dir(spark, "repair")
    turns = turns.select(*TURNS, *[c for c in ("copies",) if c in turns.columns])
    blocks = _marked(spark, turns, work, bits)
    several = blocks.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chains = blocks.select("conv", "block", "codes").join(several, "conv", "left_semi")
    chains = chains.mapInArrow(_transfers, "conv string, block long, costs array<long>")
    chains = chains.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "costs"))).alias("chain"))
    later = chains.mapInArrow(_suffixes, "conv string, block long, later array<long>")
    found = blocks.select("conv", "block", "codes").join(later, ["conv", "block"], "left").mapInArrow(_solved, _SOLVED)
    count = {name: F.sum(F.length(F.regexp_replace("codes", f"[^{''.join(chr(_FIRST + 4 * k + fault) for k in range(4))}]", ""))).cast("long")
             for name, fault in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))}
    part = F.struct("block", "codes", "costs", "scripts", "ends", "illegal")
    found.write.parquet(f"{work}/solved")
    found = spark.read.parquet(f"{work}/solved")
    whole = found.groupBy("conv").agg(F.sort_array(F.collect_list(part)).alias("chain"))
    whole.mapInArrow(_composed, _PIECES).write.parquet(f"{work}/pieces")
    pieces = spark.read.parquet(f"{work}/pieces")
    counts = found.groupBy("conv").agg(*[value.alias(name) for name, value in count.items()])
    ordered = spark.read.parquet(f"{work}/ordered").groupBy("conv")
    missing = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = ordered.agg(F.any_value("conv_id").alias("conv_id"), F.coalesce(missing, F.lit(0)).cast("long").alias("gaps"))
    reports = gaps.join(counts, "conv").join(pieces, "conv")

    tokens = F.regexp_extract_all(F.col("piece.script"), F.lit("[ua]*[KDUA]|[ua]+$"), F.lit(0))
    placed = pieces.select("conv", F.explode("pieces").alias("piece")).select("conv", "piece.block", tokens.alias("tokens"))
    placed = placed.join(blocks.select("conv", "conv_id", "block", "slots"), ["conv", "block"])
    placed = placed.select("conv", "conv_id", "block", "slots", F.posexplode("tokens").alias("place", "token")).where("token <> 'D'")
    slot = F.get("slots", F.col("place"))
    kept = ~F.col("token").endswith("D") & slot.isNotNull()
    placed = placed.select("conv", "conv_id", "block", "place", "token", F.when(kept, slot["turn"]).alias("at"), F.when(kept, slot["same"]).alias("same"))
    texts = turns.select(_conv().alias("conv"), _turn().alias("at"), _same().alias("same"), "role", "text")
    both = placed.join(texts, ["conv", "at", "same"], "left")

    def part_of(letter: Column) -> Column:
        role = F.when(letter.isin("u", "U"), "user").when(letter.isin("a", "A"), "assistant").otherwise(F.col("role"))
        return F.struct(role.alias("role"), F.when(letter.isin("u", "a"), "").otherwise(F.col("text")).alias("text"))

    standing = F.filter(F.split("token", ""), lambda x: ~x.isin("D", ""))
    return Repair(reports, both.select("conv", "conv_id", "block", "place", F.transform(standing, part_of).alias("parts")))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines as its rows stream by in order; no conversation is held."""
    conv, place, state = None, None, None
    done: list[tuple[str, str]] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"conv": [x for x, _ in done], "repaired_sha256": [x for _, x in done]})
        done.clear()
        return out

    for batch in batches:
        for name, block, at, lines in zip(*[batch[c].to_pylist() for c in ("conv", "block", "place", "lines")]):
            if name != conv:
                if conv is not None:
                    done.append((conv, state.hexdigest()))
                conv, place, state = name, None, hashlib.sha256()
            if place == (block, at):  # the text of a turn that the table holds twice
                continue
            state.update((lines if place is None else "\n" + lines).encode())
            place = block, at
        if done:
            yield flush()
    if conv is not None:
        done.append((conv, state.hexdigest()))
        yield flush()


def repair_reports(spark: SparkSession, turns: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """One row per original conversation: faults, cost, audit and the digest of the repaired turns.

    SHA-256 runs through a conversation from its first byte to its last, so the digest of one
    conversation is made by one task, which holds one Arrow batch of its turns at a time.
    """
    fixed = repair(spark, damaged(turns), bits)
    lines = F.array_join(F.transform("parts", lambda p: F.concat(p["role"], F.lit(":"), p["text"])), "\n")
    rows = fixed.turns.select("conv", "block", "place", lines.alias("lines"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "block", "place")
    hashes = rows.mapInArrow(_hashes, "conv string, repaired_sha256 string")
    audit = F.translate(F.array_join(F.transform("pieces", lambda p: p["script"]), ""), "UAua", "RRII")
    reports = fixed.reports.drop("conv_id").withColumn("audit", audit).drop("pieces")
    every = turns.select(_conv().alias("conv"), "conv_id").groupBy("conv").agg(F.any_value("conv_id").alias("conv_id"))
    joined = every.join(reports, "conv", "left").join(hashes, "conv", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        "conv_id", *[F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name) for name in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
