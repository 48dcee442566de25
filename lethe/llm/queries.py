"""The queries of the operators with production parameters over their whole tables, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.llm import bestfit, infill, lines, mixing, neardup, neighbors, packing, pii, quality, repair, sharding, tokenfile, toxicity
from lethe.llm.common import totals_before

#: Parameters: the vocabulary files in use.
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _span_list(spans: str, kind: Column | None = None) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"] if kind is None else kind, s["start"], s["end"])))


def op1_disclosing_terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = pii.sanitize(_table(spark, folder, "documents"))
    base, terms = _span_list("base"), _span_list("terms", F.lit("term"))
    return rows.select(
        "doc_id",
        *[F.size(F.array_compact(F.transform("base.kind", lambda x: F.when(x == F.lit(kind), x)))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(terms, F.lit(""))).alias("spans"),
    )


def op2_minhash_bayes(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"))


def op3_toxicity_noisy_or(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    rows = toxicity.score(documents, toxicity.train(documents, _table(spark, folder, "labels")))
    return rows.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        _span_list("offending", F.lit("sentence")).alias("sentences"),
    )


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.apply_rules(_table(spark, folder, "documents").select("doc_id", "text"))
    too_repeated = F.col("n_repeat_words") * 100 > F.col("n_words") * 50
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 50) | too_repeated).alias("base_failed"),
        "kept",
    )


def op5_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.shard(_table(spark, folder, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_pack_sum_of_squares(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(_table(spark, folder, "documents"), WORD_VOCABULARY)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_stable_projections(spark: SparkSession, folder: str) -> DataFrame:
    return neighbors.nearest(_table(spark, folder, "embeddings"))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = tokenfile.write_tokens(_table(spark, folder, "documents"), BYTE_VOCABULARY)
    read = tokenfile.read_tokens(files).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    rows = totals_before(read, ["doc_id", "n_tokens", "ids_crc32"], {"start": F.col("n_tokens")}, sums=files)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(mixing.mix(_table(spark, folder, "documents"), carry=False))


def op10_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines.drop_copied_lines(_table(spark, folder, "documents").select("doc_id", "text"))
    numbers = F.concat_ws(",", F.transform("deleted", lambda i: i.cast("string")))
    return rows.select("doc_id", "text", "n_lines", F.size("deleted").cast("long").alias("n_deleted"), numbers.alias("deleted"))


def op11_infill(spark: SparkSession, folder: str) -> DataFrame:
    rows = infill.restore(infill.transform(_table(spark, folder, "documents")))
    hashes = {f"{name}_sha256": F.sha2(F.col(name).cast("binary"), 256) for name in ("output", "restored")}
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[c.alias(n) for n, c in hashes.items()])


def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.summaries(repair.damaged(_table(spark, folder, "conversations")), copies="copies")


def op13_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    cut = bestfit.pieces(_table(spark, folder, "documents"), WORD_VOCABULARY)
    rows = bestfit.place(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return rows.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_disclosing_terms, op2_minhash_bayes, op3_toxicity_noisy_or, op4_quality_rules, op5_minimax_shards, op6_pack_sum_of_squares, op7_stable_projections, op8_token_files, op9_mix_sources, op10_line_runs, op11_infill, op12_repair, op13_best_fit)}
_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
_QUALITY_SQL = rf"""
with d as (
  select doc_id, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
windows as (
  select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as w
  from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d)),
twice as (select doc_id, i, count(*) over (partition by doc_id, w) as n from windows),
covered as (
  select doc_id, count(*) as n
  from (select distinct doc_id, i + k as place from (select doc_id, i, unnest([0, 1, 2]) as k from twice where n > 1))
  group by 1),
m as (
  select doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
         (length(text) - length(translate(text, '{quality.SYMBOLS}', '')))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, len(ls) as n_lines,
         len(list_filter(string_split(lower(translate(text, '.,;:!?"''()' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), repeat(' ', 15))), ' '),
                         lambda w: w in ({_STOP}))) as n_stop,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_capitals
  from d left join covered c using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       n_words >= 50 and word_chars * 100 between 200 * n_words and 1500 * n_words and n_symbols * 100 <= 10 * n_words
         and n_stop * 100 >= 2 * n_words and n_dup_lines * 100 <= 50 * n_lines and n_repeat_words * 100 <= 50 * n_words
         and n_capitals * 100 <= 50 * word_chars as kept
from m
"""
_NEAR_SQL = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws
  from documents),
s as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as x
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on r.b = l.a),
c as (select a as doc_id, min(b) as component_id from reach group by 1)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
from c left join n using (doc_id)
"""
_INFILL_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u
  from documents),
n as (
  select *, len(u)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
         ('0x' || h[25:32])::bigint as h4 from d),
cuts as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain'
              when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from n),
parts as (
  select doc_id, n, form, text, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m,
         array_to_string(u[b + 1:], '') as s from cuts)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars,
       case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
              else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(text) as restored_sha256
from parts
"""
_REPAIR_SQL = r"""
with recursive c as (select distinct conv_id, dense_rank() over (order by conv_id nulls first) as c from conversations),
k as (
  select c, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         -- CRC-32 of the name, bit by bit.
         xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(
             string_split(coalesce(v.conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
           lambda sum, byte: list_reduce(list_prepend(xor(sum, byte), [0, 0, 0, 0, 0, 0, 0, 0]),
                                         lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 20 as kind
  from conversations v join c on v.conv_id is not distinct from c.conv_id),
damaged as (
  select c, turn, case kind when 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy
  from k),
placed as (
  select *, md5(concat(length(role), ':', role, ':', text)) as mark,
         row_number() over (partition by c order by turn nulls first, md5(concat(length(role), ':', role, ':', text))) as i
  from damaged),
faulty as (
  select *, role[1] as ini,
         case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
              when row_number() over (partition by c, mark order by i) > 1 then 'duplicate'
              when regexp_replace(text, '[\x20\x09-\x0D]+$', '')[-1] not in ('.', '!', '?') then 'truncated' else '' end as fault
  from placed),
r as (
  select *, fault in ('blank', 'duplicate') as dead, case fault when 'truncated' then 5 else 0 end as extra,
         lag(ini) over (partition by c order by i) || ini as pair
  from faulty),
-- States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
ins(q, q1, more) as (values (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (1, 2, 'I'), (3, 2, 'I'), (2, 3, 'I'),
                            (0, 3, 'II'), (1, 3, 'II')),
keep(ini, q, q1) as (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
change(q, q1) as (values (0, 2), (1, 2), (3, 2), (2, 3)),
ops as (
  select c, i, d.q as q, d.q as q1, 2 as price, 'D' as op from r, (values (0), (1), (2), (3)) d(q)
  union all
  select c, i, x.q, x.q1, 1 + extra, 'R' from r, change x where not dead
  union all
  select c, i, x.q, x.q1, extra, 'K' from r join keep x using (ini) where not dead),
steps as (
  select c, i, ins.q, ops.q1, price + 5 * length(more) as price, more || op as op from ops join ins on ins.q1 = ops.q),
best as (
  select c, 0 as i, 0 as q, {'cost': 0, 'audit': ''} as b from c
  union all
  select c, i, q, min(b) from (
    select best.c as c, s.i as i, s.q1 as q, {'cost': best.b.cost + s.price, 'audit': best.b.audit || s.op} as b
    from best join steps s on s.c = best.c and s.i = best.i + 1 and s.q = best.q)
  group by c, i, q),
size as (select c, coalesce(max(i), 0) as n from c left join r using (c) group by 1),
won as (
  select c, min({'cost': b.cost + case q when 1 then 10 when 2 then 5 else 0 end,
                 'audit': b.audit || case q when 1 then 'II' when 2 then 'I' else '' end}) as b
  from best join size using (c) where i = n group by 1),
marks as (
  select c, b.audit as audit, unnest(range(1, length(b.audit) + 1)) as j from won),
edits as (
  select c, j, audit[j] as e, j - length(replace(audit[1:j], 'I', '')) as inserted from marks),
turns as (
  select e.c, e.j, e.e, r.role, r.text, row_number() over (partition by e.c order by e.j) as t,
         first_value(case when e.e = 'K' and r.ini = 's' then 1 else 0 end) over (partition by e.c order by e.j) as sys
  from edits e left join r on r.c = e.c and r.i = e.j - e.inserted and e.e <> 'I' where e.e <> 'D'),
said as (
  select c, string_agg(case when e = 'K' then role when (t - sys) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''),
                       chr(10) order by j) as body
  from turns group by 1),
counts as (
  select c, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = 'blank') as blank,
         count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from r group by 1)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, b.cost::bigint as cost,
       b.audit as audit, sha256(coalesce(body, '')) as repaired_sha256
from c join won using (c) left join said using (c) left join counts using (c)
"""
#: Where SQL states the whole result; the other queries are tested against brute force in tests/llm.
SQL: dict[str, str] = {"op2_minhash_bayes": _NEAR_SQL, "op4_quality_rules": _QUALITY_SQL, "op11_infill": _INFILL_SQL, "op12_repair": _REPAIR_SQL}
