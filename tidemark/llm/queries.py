"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format
from tidemark.llm.conversation_repair import repair_reports
from tidemark.llm.decontamination import contaminated
from tidemark.llm.language_model import language_scores
from tidemark.llm.line_dedup import repeated_lines
from tidemark.llm.merkle import manifest
from tidemark.llm.merkle_sql import merkle_sql
from tidemark.llm.mixing import mixture
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.quality_gam import quality_scores
from tidemark.llm.quality_rules import quality_verdicts
from tidemark.llm.secret_scan import secrets
from tidemark.llm.token_output import stored_tokens
from tidemark.llm.warc import archived_pages


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark, folder):
    return contaminated(spark, _table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op2_chat_format(spark, folder):
    told = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    table = _table(spark, folder, "conversations")
    turns = table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in more.schema]).union(more)
    parts = chat_format.text_parts(F.col("text"))
    return chat_format.digests(chat_format.format_conversations(turns.select("conv_id", "turn", "role", parts.alias("parts"))))


def op3_warc(spark, folder):
    return archived_pages(spark, _table(spark, folder, "pages")).drop("url", "digests_match")


def op4_mixing(spark, folder):
    return mixture(spark, _table(spark, folder, "documents"))


def op5_near_dedup(spark, folder):
    return near_duplicates(spark, _table(spark, folder, "documents"))


def op6_line_dedup(spark, folder):
    return repeated_lines(spark, _table(spark, folder, "documents"))


def op7_token_output(spark, folder):
    return stored_tokens(spark, _table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_language_model(spark, folder):
    return language_scores(spark, _table(spark, folder, "documents"))


def op9_quality_rules(spark, folder):
    return quality_verdicts(spark, _table(spark, folder, "documents"))


def op10_quality_gam(spark, folder):
    return quality_scores(spark, _table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_merkle_manifest(spark, folder):
    return manifest(spark, _table(spark, folder, "documents")).drop("tampered", "copied_nodes")


def op12_conversation_repair(spark, folder):
    return repair_reports(spark, _table(spark, folder, "conversations"))


def op13_secret_scan(spark, folder):
    return secrets(spark, _table(spark, folder, "documents"))


QUERIES = {
    query.__name__: query
    for query in (op1_decontamination, op2_chat_format, op3_warc, op4_mixing, op5_near_dedup, op6_line_dedup, op7_token_output,
                  op8_language_model, op9_quality_rules, op10_quality_gam, op11_merkle_manifest, op12_conversation_repair, op13_secret_scan)
}

_ESCAPED = r"""replace(replace(replace(replace(replace(replace(replace(replace({0}, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'),
  '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>')"""

SQL: dict[str, str] = {
    "op11_merkle_manifest": merkle_sql(),
    "op1_decontamination": r"""
with texts as (
  select 'd' as kind, doc_id as id, text from documents
  union all select distinct 'b', item_id, text from benchmark
), words as (
  select kind, id, row_number() over () as n, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from texts
), sets as (
  select kind, id, n, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as s
  from words
), items as (select n, id, s, count(*) over (partition by n) as size from sets where kind = 'b'),
hits as (
  select d.id as doc_id, d.n as row_no, b.id as item_id, b.n as item_no, any_value(b.size) as item_shingles, count(*) as shared
  from sets d join items b on d.s = b.s where d.kind = 'd' group by all
)
select doc_id, item_id, item_shingles::bigint as item_shingles, shared::bigint as shared_shingles
from hits where 100 * shared >= 75 * item_shingles
""",
    "op2_chat_format": f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), told as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as told,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss,
    sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + length('<|turn|><|says|><|end|>')) as formatted_chars
  from turns group by conv_id
)
select conv_id, n_turns, sha256(told) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256,
  formatted_chars::bigint as formatted_chars
from told
""",
    "op3_warc": """
with rows as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages
), named as (
  select *, max(page_id) over (partition by hex, html) as keeper, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31), 1)), '') as digest
  from rows
)
select page_id, strlen(html)::bigint as payload_bytes, digest as payload_digest,
  case when keeper is not distinct from page_id or keeper is null then 'response' else 'revisit' end as record_type,
  case when keeper is distinct from page_id then keeper end as refers_to
from named
""",
}
