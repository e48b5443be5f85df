"""Chat formatting: turns with typed content parts become one training text with a loss mask.

A turn's content is a list of typed parts. A visitor turns each part into text: a text part is escaped,
an image, audio or document part becomes its placeholder, in order, and is recorded as an attachment
with its reference, its place in the text and the number of tokens the placeholder expands to.

A turn is written as ``<|turn|>role<|says|>content<|end|>``. Texts and roles cannot forge marks: a
backslash is doubled, and one is put behind the first character of every control string (those of
this template and those of common others), which ``unescaped`` takes back exactly.

All of it is DataFrame operations. One shuffle by conversation serves the running offsets and the gathering
of turns; a conversation becomes one text, so it has to fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
# Openings of this template's marks and the control strings of common chat templates.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Placeholder of each kind of attachment, and the units of its size (pixels, milliseconds, pages) that one token stands for.
ATTACHMENTS = {"image": ("<|image|>", 784.0), "audio": ("<|audio|>", 40.0), "document": ("<|document|>", 1 / 512)}
LOSS_ROLE = "assistant"
PARTS = "array<struct<kind:string,text:string,ref:string,size:bigint>>"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _visited(part: Column) -> Column:
    """The text that one part becomes; a part of an unknown kind becomes its text."""
    shown = escaped(F.coalesce(part["text"], F.lit("")))
    for kind, (placeholder, _) in ATTACHMENTS.items():
        shown = F.when(part["kind"] == kind, F.lit(placeholder)).otherwise(shown)
    return shown


def _expanded_tokens(part: Column) -> Column:
    tokens = F.lit(None).cast("long")
    for kind, (_, unit) in ATTACHMENTS.items():
        tokens = F.when(part["kind"] == kind, F.greatest(F.lit(1), F.ceil(F.coalesce(part["size"], F.lit(0)) / unit))).otherwise(tokens)
    return tokens


def text_parts(text: Column) -> Column:
    """The content of a plain text turn."""
    part = F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"),
                    F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("size"))
    return F.array(part).cast(PARTS)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, n_turns, loss_spans, attachments), a row per conversation.

    ``turns`` has conv_id, turn, role and parts (see ``PARTS``). Turns are ordered by turn, null first,
    then by role and content, so repeated and tied rows have one order; each is kept. Null roles, parts
    and texts are empty. Rows without conv_id form one conversation. loss_spans holds start (from 0) and
    length, in code points of ``formatted``, of each assistant content. An attachment has its turn
    (from 0), its number in the conversation, kind, ref and tokens.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"),
                        F.coalesce(F.col("parts"), F.array().cast(PARTS)).alias("parts"))
    rows = rows.withColumn("content", F.array_join(F.transform("parts", _visited), ""))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS)))
    rows = rows.withColumn("size", F.char_length("head") + F.char_length("content") + len(END))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "content")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"place": F.row_number().over(order) - 1, "before": before})
    attached = F.transform(F.filter("parts", lambda p: p["kind"].isin(*ATTACHMENTS)), lambda p: F.struct(
        F.col("place").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), _expanded_tokens(p).alias("tokens")))
    span = F.when((F.col("role") == LOSS_ROLE) & (F.char_length("content") > 0), F.struct(
        (F.col("before") + F.char_length("head")).alias("start"), F.char_length("content").cast("long").alias("length")))
    piece = F.struct("place", F.concat("head", "content", F.lit(END)).alias("text"), span.alias("span"), attached.alias("attached"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    flat = F.flatten(F.col("pieces.attached"))
    numbered = F.transform(flat, lambda a, i: F.struct(
        a["turn"].alias("turn"), i.alias("number"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    return whole.select("conv_id", F.array_join("pieces.text", "").alias("formatted"), F.size("pieces").cast("long").alias("n_turns"),
                        F.filter("pieces.span", lambda s: s.isNotNull()).alias("loss_spans"), numbered.alias("attachments"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, unescaped."""
    parts = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)

    def turn(x: Column) -> Column:
        content = F.substring_index(x, SAYS, -1)
        content = F.substring(content, F.lit(1), F.char_length(content) - len(END))
        return F.struct(unescaped(F.substring_index(x, SAYS, 1)).alias("role"), unescaped(content).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, end to end."""
    return F.array_join(F.transform(spans, lambda s: unescaped(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(conversations: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them."""
    read = conversations.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                                loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))
