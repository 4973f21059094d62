"""Registered queries of the operators; each reads whole tables and returns its full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillcast.llm import ann, chat, decontam, langid, lmscore, merkle, neardup, packing, passages, phrases, repair, tokens, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), vocabulary(), limit=2048)


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scores(_table(spark, sf_dir, "documents"), vocabulary())


def text_model(spark: SparkSession, sf_dir: str) -> langid.TextModel:
    return langid.fit(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages; a document's source is its host, a page has an address and markup."""
    documents, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")
    host, domain, suffix = langid.host_of(F.col("url"))
    rows = documents.select(
        "doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("lang").alias("declared"),
        none.alias("marker"), F.col("source").alias("host"), none.alias("domain"), none.alias("suffix"),
    ).unionByName(pages.select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", langid.visible(F.col("html")).alias("text"),
        langid.declared_of(F.col("html")).alias("declared"), langid.marker_of(F.col("url")).alias("marker"),
        host.alias("host"), domain.alias("domain"), suffix.alias("suffix"),
    ))
    found = langid.identify(rows, text_model(spark, sf_dir), langid.Evidence("text", "declared", "marker", "host", "domain", "suffix"))
    return found.select("doc_id", "page_id", "language", "posterior", "accepted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_index(_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), vocabulary(), capacity=2048)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_windows(rows.unionByName(chat.control_conversation(rows))))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_and_repair(_table(spark, sf_dir, "conversations"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.neighbours(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_lm_scores": op2_lm_scores,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_chat": op7_chat,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_neighbours": op9_neighbours,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_manifest": op11_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_fingerprints": op13_fingerprints,
}

WARC_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
f as (select h, min(page_id) as first from p where strlen(h) >= 100 group by h)
select p.page_id, cast(strlen(p.h) as bigint) as payload_bytes, sha256(p.h) as payload_digest,
  case when p.page_id <> f.first then 'revisit' else 'response' end as record_type,
  case when p.page_id <> f.first then f.first end as refers_to
from p left join f on p.h = f.h"""


def _escaped(column: str) -> str:
    """Characters of a text with its backslashes and control strings escaped."""
    return (
        f"(length({column}) + length({column}) - length(replace({column}, '\\', ''))"
        f" + len(regexp_extract_all({column}, '<\\||</?s>|<</?SYS>>|\\[/?INST\\]')))"
    )


CHAT_SQL = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t as (select *, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^ \\t\\n\\rA-Za-z0-9]')) + 4 as tokens,
  row_number() over (partition by conv_id order by turn, role, text) - 1 as n,
  24 + {_escaped("role")} + length(role) - length(replace(role, chr(10), '')) + {_escaped("text")} as chars from c),
s as (select conv_id, tokens as head, chars from t where n = 0 and role = 'system'),
r as (select t.conv_id, t.tokens, t.chars, sum(t.tokens) over (partition by t.conv_id order by n) - t.tokens as before,
  greatest(floor((1024 - 256 - coalesce(head, 0)) / 2), 256) as stride
  from t left join s on t.conv_id = s.conv_id where not (n = 0 and role = 'system')),
w as (select *, floor(before / stride) as win from r),
b as (select conv_id, win, min(before) as start from w group by all),
f as (select conv_id, chars from w
  union all select w.conv_id, chars from w join b on w.conv_id = b.conv_id and b.win = w.win + 1
    where start - before <= least(256, stride)
  union all select conv_id, chars from s
  union all select s.conv_id, chars from s join b on s.conv_id = b.conv_id where win > 0),
g as (select conv_id, cast(sum(chars) as bigint) as formatted_chars from f group by conv_id),
d as (select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '') as learnt from t group by conv_id)
select conv_id, n_turns, turns_sha256, cast(length(learnt) as bigint) as loss_chars,
  sha256(learnt) as loss_sha256, formatted_chars from d join g using (conv_id)"""

def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, which DuckDB does not have: polynomial division bit by bit."""
    octet = "list_reduce(range(8), lambda x, i: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end), xor(c, b))"
    octets = f"list_transform(range(length({text})), lambda k: cast(ascii(substr({text}, k + 1, 1)) as bigint))"
    return f"xor(list_reduce({octets}, lambda c, b: {octet}, 4294967295::bigint), 4294967295)"


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::varchar) || ':' || {column}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([*(_field(c) for c in ("doc_id", "source", "lang", "n_chars")), _field(text)]) + ")"


MANIFEST_SQL = f"""
with recursive leaves as (select doc_id, dense_rank() over (order by source nulls first) - 1 as tree, {_leaf("text")} as leaf,
    case when {_crc32("cast(doc_id as varchar)")} % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")} end as told from documents),
l as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place from leaves),
t(tree, lvl, place, node) as (select tree, 0, place, leaf from l union all
  select tree, lvl + 1, place // 3, sha256(string_agg(node, '' order by place))
  from (select *, count(*) over (partition by tree) as n from t) where n > 1 group by tree, lvl, place // 3),
s as (select tree, max(lvl) as height, arg_max(node, lvl) as subroot from t group by tree),
u(lvl, place, node) as (select 0, tree, subroot from s union all
  select lvl + 1, place // 3, sha256(string_agg(node, '' order by place))
  from (select *, count(*) over () as n from u) where n > 1 group by lvl, place // 3),
top as (select max(lvl) as height, arg_max(node, lvl) as root from u),
runs as (select tree, lvl, place // 3 as run, array_agg(node order by place) as nodes from t group by all),
ups as (select lvl, place // 3 as run, array_agg(node order by place) as nodes from u group by all),
way(own, tree, lvl, place, up, node, proof) as (
  select place, tree, 0, place, false, told, '' from l union all
  select own, tree, case when at_top then 0 else lvl + 1 end, case when at_top then tree else place // 3 end, up or at_top,
    case when at_top then node else sha256(array_to_string(list_transform(nodes, lambda x, i: case when i - 1 = place % 3 then node else x end), '')) end,
    case when at_top then proof else proof || array_to_string(list_filter(nodes, lambda x, i: i - 1 <> place % 3), '') end
  from (select w.*, not w.up and w.lvl = s.height as at_top, coalesce(r.nodes, ups.nodes) as nodes
    from way w join s on w.tree = s.tree cross join top
    left join runs r on not w.up and r.tree = w.tree and r.lvl = w.lvl and r.run = w.place // 3
    left join ups on w.up and ups.lvl = w.lvl and ups.run = w.place // 3
    where not (w.up and w.lvl = top.height)))
select n.doc_id, n.leaf, s.subroot, top.root, sha256(w.proof) as proof_sha256, w.node as folded_root, w.node = top.root as verified
from way w join l n on n.tree = w.tree and n.place = w.own join s on s.tree = w.tree cross join top
where w.up and w.lvl = top.height"""

REPAIR_SQL = f"""
with recursive p as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
q as (select *, {_crc32("key")} % 20 as pick from p),
d as (select conv_id, turn, case when pick = 4 then 'user' else role end as role,
    case pick when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case pick when 0 then 0 when 3 then 2 else 1 end)) as copy from q),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as place, left(role, 1) as initial from d),
r as (select *, case when regexp_full_match(text, '[\\x20\\x09-\\x0D]*') then 'blank'
    when row_number() over (partition by conv_id, role, text order by place) > 1 then 'duplicate'
    when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 'truncated' else '' end as fault,
    lag(initial) over (partition by conv_id order by place) || initial as pair from o),
ins(st, letters, lines, cost, goes) as (values (0, '', '', 0, 0), (0, 'I', chr(10) || 'user:', 3, 2), (0, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 6, 3),
    (1, '', '', 0, 1), (1, 'I', chr(10) || 'user:', 3, 2), (1, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 6, 3),
    (2, '', '', 0, 2), (2, 'I', chr(10) || 'assistant:', 3, 3), (3, '', '', 0, 3), (3, 'I', chr(10) || 'user:', 3, 2)),
e(st, letter, initial, goes, cost) as (select st, 'D', cast(null as varchar), st, 4 from range(4) x(st) union all
  select st, letter, initial, goes, cost from (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) m(st, initial, goes),
    (values ('K', 0), ('R', 3)) l(letter, cost) where letter = 'K' or initial <> 's'),
b(conv_id, place, st, best) as (
  select distinct conv_id, cast(0 as bigint), 0, {{'cost': 0, 'audit': '', 'lines': ''}} from r union all
  select b.conv_id, any_value(r.place), e.goes, min({{
    'cost': b.best.cost + ins.cost + e.cost + case when e.letter <> 'D' and fault = 'truncated' then 3 else 0 end,
    'audit': b.best.audit || ins.letters || e.letter,
    'lines': b.best.lines || ins.lines || case e.letter when 'D' then '' when 'K' then chr(10) || role || ':' || text
      else chr(10) || case e.initial when 'u' then 'user' else 'assistant' end || ':' || text end}})
  from b join r on r.conv_id is not distinct from b.conv_id and r.place = b.place + 1 join ins on ins.st = b.st
    join e on e.st = ins.goes and (e.letter = 'D' or fault not in ('blank', 'duplicate') and (e.letter = 'R' or e.initial = r.initial))
  group by b.conv_id, e.goes),
n as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 'blank') as blank,
  count_if(fault = 'duplicate') as duplicate, count_if(fault = 'truncated') as truncated,
  count_if(pair is not null and pair not in ('su', 'ua', 'au')) as illegal from r group by conv_id),
f as (select b.conv_id, min({{'cost': b.best.cost + ins.cost, 'audit': b.best.audit || ins.letters, 'lines': b.best.lines || ins.lines}}) as best
  from b join n on n.conv_id is not distinct from b.conv_id and b.place = n.n join ins on ins.st = b.st and ins.goes in (0, 3) group by b.conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost,
  coalesce(best.audit, '') as audit, sha256(coalesce(substr(best.lines, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join n on n.conv_id is not distinct from c.conv_id
  left join f on f.conv_id is not distinct from c.conv_id"""

#: The others rest on a tokenizer, a fitted model, signatures or a search, which SQL does not have.
ORACLES = {"op5_warc": WARC_SQL, "op7_chat": CHAT_SQL, "op11_manifest": MANIFEST_SQL, "op12_conversation_repair": REPAIR_SQL}
