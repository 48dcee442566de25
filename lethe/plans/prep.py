"""Corpus preparation, samples, splits and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.functions import names, prompts, scores
from lethe.functions.text import extract_answer, first_line, prefixed_prompt, question
from lethe.operators import prepare
from lethe.plans.registry import Tables, query
from lethe.plans.standins import COMPLETIONS_SQL, completions
from lethe.sources.tables import PUBLISHED

SEED = 42


@query("prep_question_normalize", "select page_id, split_part(url, '?', 1) || '?' as prompt from pages")
def question_normalize(t: Tables) -> DataFrame:
    return t.pages.select("page_id", question(F.col("url")).alias("prompt"))


@query(
    "prep_dedup_first",
    """select doc_id, lang, source from (
         select *, row_number() over (partition by text order by doc_id) rn from documents) where rn = 1""",
)
def dedup_first(t: Tables) -> DataFrame:
    return prepare.keep_first(t.documents, ["text"], "doc_id").select("doc_id", "lang", "source")


@query(
    "prep_filter_nonblank",
    """select role, count(*) total_rows, count(*) filter (regexp_matches(text, '\\S')) kept_rows,
              count(*) filter (not regexp_matches(text, '\\S')) removed_rows
       from conversations group by role""",
)
def filter_nonblank(t: Tables) -> DataFrame:
    return prepare.blank_report(t.conversations, "text", ["role"])


@query(
    "prep_concept_corpus",
    """select doc_id as pos, split_part(text, '?', 1) || '?' as prompt, lang as completion, source as subject
       from documents where source = 'src3'""",
)
def concept_corpus(t: Tables) -> DataFrame:
    corpus = t.documents.select(
        F.col("doc_id").alias("pos"), F.col("text").alias("instruction"), F.col("lang").alias("output"),
        F.col("source").alias("subject"),
    )
    return prepare.concept_corpus(corpus, "src3")


@query(
    "prep_author_filter",
    """select c_mktsegment, count(*) n from customer
       where trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', ' ', 'g')) in ('building', 'machinery')
       group by 1""",
)
def author_filter(t: Tables) -> DataFrame:
    kept = t.customer.where(names.in_allow_list(F.col("c_mktsegment"), ["Building", "machinery "]))
    return kept.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prep_subject_filter",
    "select source, count(*) n from documents where source in ('src1', 'src4', 'src7') group by 1",
)
def subject_filter(t: Tables) -> DataFrame:
    kept = names.subject_filter(t.documents, "src1, src4,src7", "source")
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "seeded_sample",
    f"""select doc_id, source from (
          select doc_id, source, row_number() over (
            partition by source order by md5('{SEED}:' || doc_id), doc_id) rn from documents)
        where rn <= 5""",
)
def seeded_sample(t: Tables) -> DataFrame:
    return prepare.select_max(
        t.documents.select("doc_id", "source"), 5, "doc_id", "random", SEED, ["source"]
    )


@query(
    "first_examples",
    """select doc_id, lang from (
         select doc_id, lang, row_number() over (partition by lang order by doc_id) rn from documents)
       where rn <= 20""",
)
def first_examples(t: Tables) -> DataFrame:
    return prepare.select_max(t.documents.select("doc_id", "lang"), 20, "doc_id", by=["lang"])


SPLIT_SQL = f"""
ranked as (
  select doc_id, lang, text, row_number() over (partition by lang order by md5('{SEED}:' || doc_id), doc_id) - 1 rk,
         count(*) over (partition by lang) n
  from documents),
sized as (select *, ceil(0.2::double * n)::bigint nt from ranked),
sized2 as (select *, ceil((0.1::double + 0.05::double) * (n - nt))::bigint ns from sized),
sized3 as (select *, ceil((0.05::double / (0.1::double + 0.05::double)) * ns)::bigint nst from sized2),
split as (
  select doc_id, lang, text, case when rk < nt then 'grpo/test' when rk < nt + nst then 'sft/test'
         when rk < nt + ns then 'sft/train' else 'grpo/train' end as split
  from sized3)
"""


def _splits(t: Tables) -> DataFrame:
    return prepare.seeded_splits(
        t.documents.select("doc_id", "lang", F.col("text").alias("completion")),
        ["lang"], "doc_id", SEED, 0.2, 0.1, 0.05,
    )


@query("seeded_split", f"with {SPLIT_SQL} select doc_id, lang, split from split")
def seeded_split(t: Tables) -> DataFrame:
    return prepare.seeded_splits(
        t.documents.select("doc_id", "lang"), ["lang"], "doc_id", SEED, 0.2, 0.1, 0.05
    )


@query(
    "publish_splits",
    f"""with {SPLIT_SQL}
        select lang as concept,
               case split when 'grpo/train' then 'grpo_train' when 'sft/train' then 'sft_train'
                    when 'sft/test' then 'sft_validation' else 'holdout' end as published,
               count(*) as total_rows, count(case when split like 'sft/%' then text end) as with_completion
        from split group by all""",
)
def publish_splits(t: Tables) -> DataFrame:
    label = F.create_map(*[F.lit(x) for pair in PUBLISHED.items() for x in pair])
    rows = prepare.publish(_splits(t)).withColumn("published", label[F.col("split")])
    return rows.groupBy(F.col("lang").alias("concept"), "published").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count("completion").alias("with_completion")
    )


@query(
    "contiguous_shard",
    "select doc_id, ntile(7) over (order by doc_id) - 1 as shard from documents",
)
def contiguous_shard(t: Tables) -> DataFrame:
    return prepare.contiguous_shard(t.documents.select("doc_id"), 7, "doc_id")


@query(
    "evaluation_panel",
    """select doc_id, g as completion_index from (select doc_id from documents order by doc_id limit 64),
       range(0, 4) r(g)""",
)
def evaluation_panel(t: Tables) -> DataFrame:
    panel = prepare.select_max(t.documents.select("doc_id"), 64, "doc_id")
    return prepare.repeat_prompts(panel, 4).withColumn("completion_index", F.col("completion_index").cast("bigint"))


@query(
    "probe_prompts",
    """with u as (
         select conv_id, turn, text as query,
                case when turn <= 1 then '1' when turn <= 3 then '2' else '3' end as level,
                case when turn <= 3 then 'forget_level' || case when turn <= 1 then 1 else 2 end
                     else 'forget_level3' end as split,
                case when length(text) % 3 = 0 then 'affirmative suffix'
                     when length(text) % 3 = 1 then 'incontext learning' else 'other' end as type
         from conversations where role = 'user')
       select conv_id, turn,
         case when level = '1' then 'Please complete the blank in the following question.' || chr(10) || 'Question: ' || query || chr(10)
              when level = '2' or type = 'other'
                then 'Please briefly answer the following question.' || chr(10) || 'Question: ' || query || chr(10)
              when type = 'affirmative suffix'
                then 'Please briefly answer the following question.' || chr(10) || 'Question: ' || query
              else 'Please briefly answer the following question.' || chr(10) || query || chr(10) end as prompt,
         case when level = '3' and type = 'affirmative suffix' then '' else 'Answer:' end as prefix
       from u""",
)
def probe_prompts(t: Tables) -> DataFrame:
    turn, size = F.col("turn"), F.length("text")
    level = F.when(turn <= 1, "1").when(turn <= 3, "2").otherwise("3")
    kind = F.when(size % 3 == 0, "affirmative suffix").when(size % 3 == 1, "incontext learning").otherwise("other")
    users = t.conversations.where(F.col("role") == "user").select("conv_id", "turn", "text", level.alias("level"), kind.alias("type"))
    probe = prompts.probe_prompt(
        F.concat(F.lit("forget_level"), F.col("level")), F.col("level"), F.col("type"), F.col("text")
    )
    return users.withColumn("p", probe).select("conv_id", "turn", "p.prompt", "p.prefix")


@query(
    "few_shot_prompts",
    """select p_partkey,
         'The following are multiple choice questions (with answers) about ' || replace(p_type, '_', ' ') || '.'
         || chr(10) || chr(10)
         || 'Question: ' || p_type || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_name || chr(10)
         || 'Answer: ' || case when p_size % 2 = 0 then 'A' else 'B' end || chr(10) || chr(10)
         || 'Please following the previous examples and answer the given question.' || chr(10)
         || 'Question: ' || p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type
         || chr(10) || 'C. ' || p_size as prompt
       from part""",
)
def few_shot_prompts(t: Tables) -> DataFrame:
    example = F.struct(
        F.col("p_type").alias("question"),
        F.array("p_brand", "p_name").alias("choices"),
        (F.col("p_size") % 2).alias("answer"),
    )
    choices = F.array("p_brand", "p_type", F.col("p_size").cast("string"))
    prompt = prompts.few_shot_prompt(F.col("p_type"), F.array(example), F.col("p_name"), choices)
    return t.part.select("p_partkey", prompt.alias("prompt"))


@query(
    "instruction_prompts",
    f"""with {COMPLETIONS_SQL}
        select id, md5('Instruction: ' || trim(prompt) || chr(10)) as fluency,
               md5('Q: ' || prompt || chr(10) || ' A:') as spaced,
               md5(trim(prompt) || chr(10) || chr(10) || 'Following previous examples, answer the following questions and end with ''so the answer is''' || chr(10) || 'Q: ' || trim(completion)) as reasoning
        from pairs""".replace("chr(10) || ' A:'", "chr(10) || 'A:'"),
)
def instruction_prompts(t: Tables) -> DataFrame:
    rendered = F.concat(F.lit("Q: "), F.col("prompt"), F.lit("\n"))
    return completions(t).select(
        "id",
        F.md5(prompts.instruction_prompt(F.col("prompt"))).alias("fluency"),
        F.md5(prefixed_prompt(rendered, "A:")).alias("spaced"),
        F.md5(prompts.reasoning_prompt(F.col("prompt"), F.col("completion"))).alias("reasoning"),
    )


@query(
    "judge_requests",
    f"""with {COMPLETIONS_SQL}
        select id, json_object('target_entity', 'conv ' || conv_id, 'prompt', prompt, 'completion', completion)::varchar as payload
        from pairs""",
)
def judge_requests(t: Tables) -> DataFrame:
    target = F.concat(F.lit("conv "), F.col("conv_id").cast("string"))
    return completions(t).select(
        "id", scores.request_payload(target, F.col("prompt"), F.col("completion")).alias("payload")
    )


@query(
    "answer_extraction",
    f"""with {COMPLETIONS_SQL},
        x as (select id, case when turn % 4 = 0 then 'So the answer is ' || completion else completion end as p from pairs)
        select id, case when regexp_matches(p, '[t|T]he answer is (.*?)\\.')
                        then trim(regexp_extract(p, '[t|T]he answer is (.*?)\\.', 1))
                        else trim(p, ' ' || chr(10)) end as answer,
               trim(split_part(p, chr(10), 1)) as first_line
        from x""",
)
def answer_extraction(t: Tables) -> DataFrame:
    p = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("So the answer is "), F.col("completion"))).otherwise(
        F.col("completion")
    )
    return completions(t).withColumn("p", p).select(
        "id", extract_answer(F.col("p")).alias("answer"), first_line(F.col("p")).alias("first_line")
    )


@query(
    "key_normalizers",
    """select page_id, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') as key,
              trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') as slug,
              trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '-', 'g'), '-') as safe_name,
              trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) as words
       from pages""",
)
def key_normalizers(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select(
        "page_id",
        names.key_of(url).alias("key"),
        names.slug(url).alias("slug"),
        names.safe_name(url).alias("safe_name"),
        names.words_of(url).alias("words"),
    )
