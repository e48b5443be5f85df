"""A Merkle manifest of documents: one tree per language, one over the languages, a proof per document.

Nodes are lowercase hex SHA-256 digests. A tree is cut into aligned blocks of 8^4 nodes, and blocks of
blocks, so no task holds more than one block however large a language is. The trees of a block are
persistent: a changed leaf gives a new version that copies the leaf's ancestors and shares every other
node with the version before. What lies above a block reaches it as one short path, handed down from
tier to tier, along which each version goes on to its own root.
"""

from __future__ import annotations

import hashlib
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import work_dir

FAN = 8
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left: string, right: string>>"
_CONTEXT = f"tree string, block long, path {_PATH}, subroot string, root string"


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value; integers are decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(value) for value in values]), 256)


def tampered_text(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Whether the fixed experiment touches a document (its id's CRC-32 divides by three), and its text then."""
    touched = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return touched, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Node:
    """An immutable node; a leaf has no children."""

    __slots__ = ("digest", "children")

    def __init__(self, text: str, children: tuple[Node, ...] = ()):
        self.digest, self.children = text, children


def _joined(children: tuple[Node, ...]) -> Node:
    return Node(digest(*[child.digest for child in children]), children)


def grown(leaves: list[str], levels: int) -> Node:
    """The tree over the digests of one block; its last run of each level may be short."""
    nodes = [Node(leaf) for leaf in leaves]
    for _ in range(levels):
        nodes = [_joined(tuple(nodes[i:i + FAN])) for i in range(0, len(nodes), FAN)]
    (root,) = nodes
    return root


def with_leaf(node: Node, position: int, levels: int, leaf: str) -> Node:
    """A new version with one other leaf. ``levels`` nodes are copied, all others are shared."""
    if not levels:
        return Node(leaf)
    width = FAN ** (levels - 1)
    at = position // width
    changed = with_leaf(node.children[at], position % width, levels - 1, leaf)
    return _joined(node.children[:at] + (changed,) + node.children[at + 1:])


def siblings(node: Node, position: int, levels: int) -> list[tuple[str, str]]:
    """The digests left and right of a leaf's path, from the leaf up."""
    path = []
    for level in range(levels - 1, -1, -1):
        at = position // FAN**level % FAN
        sides = node.children[:at], node.children[at + 1:]
        path.append(tuple("".join(child.digest for child in side) for side in sides))
        node = node.children[at]
    return path[::-1]


def continued(current: str, path: list[tuple[str, str]]) -> str:
    """A version's root: its node carried up a path of unchanged siblings."""
    for left, right in path:
        current = digest(left, current, right)
    return current


def levels_of(size: int, most: int) -> int:
    """Levels a block takes part in: until one node of its tree is left, ``most`` at a time."""
    levels = 0
    while size > 1 and levels < most:
        size, levels = -(-size // FAN), levels + 1
    return levels


def _block(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _place(spark: SparkSession, rows: DataFrame, order: list[str], work: str, levels: int) -> DataFrame:
    """Rows with their position and the size of their tree, which no single task ever sees whole.

    Range partitions hold a tree in order; a row's position is the rows of the partitions before
    it and its place in its own. A salt parts rows that are equal in all of ``order``.
    """
    keys = ["tree", *order, "salt"]
    in_order = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    in_order.withColumn("seq", F.monotonically_increasing_id()).write.parquet(f"{work}/placed")
    placed = spark.read.parquet(f"{work}/placed").withColumn("part", F.shiftright("seq", 33))
    spans = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "tree", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("tree")).alias("size"),
    )
    pos = F.col("before") + F.col("seq") - F.col("first")
    found = placed.join(spans, ["tree", "part"]).withColumn("pos", pos).drop("part", "seq", "first", "before")
    return found.withColumn("block", F.floor(F.col("pos") / F.lit(FAN**levels)).cast("long"))


def _climb(spark: SparkSession, nodes: DataFrame, work: str, most: int) -> list[DataFrame]:
    """The tiers of all trees at once: nodes, their blocks, blocks of blocks, up to one node per tree."""

    def fold(table: pa.Table) -> pa.Table:
        table = _block(table)
        size = table["size"][0].as_py()
        root = grown(table["digest"].to_pylist(), levels_of(size, most))
        return pa.table({"tree": table["tree"][:1], "pos": table["block"][:1], "size": pa.array([-(-size // FAN**most)]),
                         "digest": pa.array([root.digest])})

    tiers = [nodes]
    while True:
        below = tiers[-1].select("tree", "block", "pos", "size", "digest")
        path = f"{work}/tier-{len(tiers)}"
        below.groupBy("tree", "block").applyInArrow(fold, "tree string, pos long, size long, digest string").write.parquet(path)
        tier = spark.read.parquet(path)
        tiers.append(tier.withColumn("block", F.floor(F.col("pos") / F.lit(FAN**most)).cast("long")))
        if (tier.agg(F.max("size")).first()[0] or 1) == 1:
            return tiers


def _handed_down(spark: SparkSession, tiers: list[DataFrame], contexts: DataFrame, work: str, most: int) -> DataFrame:
    """For every block of the lowest tier the path above it, handed down tier by tier."""

    def spread(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, (context,) = _block(nodes), above.to_pylist()
        levels = levels_of(nodes["size"][0].as_py(), most)
        tree = grown(nodes["digest"].to_pylist(), levels)
        rows = []
        for offset, pos in enumerate(nodes["pos"].to_pylist()):
            own = [{"left": left, "right": right} for left, right in siblings(tree, offset, levels)]
            rows.append({**context, "block": pos, "path": own + context["path"]})
        return pa.Table.from_pylist(rows, schema=above.schema)

    for at in range(len(tiers) - 2, 0, -1):
        both = tiers[at].select("tree", "block", "pos", "size", "digest").groupBy("tree", "block")
        path = f"{work}/paths-{at}"
        both.cogroup(contexts.groupBy("tree", "block")).applyInArrow(spread, _CONTEXT).write.parquet(path)
        contexts = spark.read.parquet(path)
    return contexts


def _language_contexts(spark: SparkSession, subroots: DataFrame, work: str, most: int) -> DataFrame:
    """The path from each language's subroot to the root of all."""
    names = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.lit(0).alias("salt"))
    tiers = _climb(spark, _place(spark, names, ["name"], work, most), work, most)
    empty = F.array().cast(_PATH)
    top = tiers[-1].select("tree", F.col("pos").alias("block"), empty.alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))

    def spread(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, (context,) = _block(nodes), above.to_pylist()
        levels = levels_of(nodes["size"][0].as_py(), most)
        tree = grown(nodes["digest"].to_pylist(), levels)
        rows = []
        for offset, (name, subroot) in enumerate(zip(nodes["name"].to_pylist(), nodes["digest"].to_pylist())):
            own = [{"left": left, "right": right} for left, right in siblings(tree, offset, levels)]
            rows.append({"tree": name, "block": 0, "path": own + context["path"], "subroot": subroot, "root": context["root"]})
        return pa.Table.from_pylist(rows, schema=above.schema)

    contexts = _handed_down(spark, tiers, top, work, most)
    lowest = tiers[0].groupBy("tree", "block").cogroup(contexts.groupBy("tree", "block"))
    lowest.applyInArrow(spread, _CONTEXT).write.parquet(f"{work}/languages")
    return spark.read.parquet(f"{work}/languages")


def manifest(spark: SparkSession, docs: DataFrame, changed: Column | None = None, new_text: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per document: its leaf, subroot and root, the digest of its proof, and its tampered version's root.

    ``changed`` marks the documents whose text becomes ``new_text`` in a version of their own; the
    default is the experiment of ``tampered_text``. ``copied_nodes`` counts the ancestors that the
    version copied within its block. ``verified`` tells whether the version's root is still the root.

    A null in any column is a value of its own, and null languages form the first tree. Rows of one
    language and id are ordered by their leaf; fully equal rows are leaves of their own. A null id
    comes first and is not tampered with. An empty table gives no rows. Further columns are ignored.

    Text is read once and never shuffled. Rows of about 150 bytes are shuffled three times: into
    order, into blocks, and into blocks again to meet their paths.
    """
    work = work_dir(spark, "merkle")
    touched, lowered = tampered_text(F.col("doc_id"), F.col("text"))
    touched = touched if changed is None else F.coalesce(changed, F.lit(False))
    columns = {name: F.col(name) for name in FIELDS}
    other = leaf_digest(*{**columns, "text": lowered if new_text is None else new_text}.values())
    docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree"), "doc_id",
        leaf_digest(*columns.values()).alias("digest"), F.when(touched, other).alias("other"), F.monotonically_increasing_id().alias("salt"),
    ).write.parquet(f"{work}/leaves")
    leaves = spark.read.parquet(f"{work}/leaves")
    nodes = _place(spark, leaves, ["doc_id", "digest"], work, levels)
    tiers = _climb(spark, nodes, work, levels)
    contexts = _language_contexts(spark, tiers[-1].select("tree", "digest"), f"{work}/languages-tree", levels)
    contexts = _handed_down(spark, tiers, contexts, work, levels)

    def prove(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, (context,) = _block(nodes), above.to_pylist()
        depth = levels_of(nodes["size"][0].as_py(), levels)
        tree = grown(nodes["digest"].to_pylist(), depth)
        upper = [(step["left"], step["right"]) for step in context["path"]]
        upper_text = "".join(left + right for left, right in upper)
        untouched = continued(tree.digest, upper)
        proofs, folded = [], []
        for offset, other in enumerate(nodes["other"].to_pylist()):
            own = "".join(left + right for left, right in siblings(tree, offset, depth))
            proofs.append(digest(own, upper_text))
            folded.append(untouched if other is None else continued(with_leaf(tree, offset, depth, other).digest, upper))
        rows, tampered = len(folded), nodes["other"].is_valid()
        return pa.table({
            "doc_id": nodes["doc_id"], "leaf": nodes["digest"], "subroot": pa.array([context["subroot"]] * rows),
            "root": pa.array([context["root"]] * rows), "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded),
            "verified": pa.array([value == context["root"] for value in folded]), "tampered": tampered,
            "copied_nodes": pa.array([depth if value else 0 for value in tampered.to_pylist()], pa.int32()),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    result = (f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              "verified boolean, tampered boolean, copied_nodes int")
    return nodes.groupBy("tree", "block").cogroup(contexts.groupBy("tree", "block")).applyInArrow(prove, result)
