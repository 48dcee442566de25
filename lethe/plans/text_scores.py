"""Leakage, refusal, language, judge, overlap and entropy scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.functions import fuzzy, matching, scores
from lethe.functions.text import (
    ABBREVIATIONS,
    TREEBANK,
    best_token_f1,
    exact_match,
    fluency,
    token_f1,
    weighted_entropy,
    word_count,
)
from lethe.operators import report, rewards
from lethe.operators.scoring import Batch
from lethe.plans.registry import Tables, query, r4, r6
from lethe.plans.standins import (
    COMPLETIONS_SQL,
    JUDGMENTS_SQL,
    LADDER_SQL,
    MARKED,
    NEAR_SQL,
    PAIRS_SQL,
    ROUND2,
    completions,
    concept_phrases,
    concept_texts,
    judgments,
    word_pairs,
)


@query("leak_exact_matches", f"with {PAIRS_SQL} select doc_id, pattern, n::bigint as occurrences from hits")
def leak_exact_matches(t: Tables) -> DataFrame:
    found = matching.with_matches(t.texts("doc_id", "text"), word_pairs(t), "text", "doc_id")
    return matching.match_rows(found, ["doc_id"]).select(
        "doc_id", "pattern", F.col("n").cast("bigint").alias("occurrences")
    )


SCORES_SQL = {
    "binary": ("names", "dis", "case when dis = 0 then 1.0::double else 0.0::double end"),
    "entity_count": ("names", "dis", "1.0 / (1.0 + dis)"),
    "exponential": ("rtrim(repeated, '|')", "occ", "exp(-1.0::double * occ)"),
    "length_aware": ("rtrim(repeated, '|')", "occ", "exp(-20.0::double * occ / greatest(words, 50))"),
}


def _leak_scores(mode: str) -> Callable[[Tables], DataFrame]:
    def build(t: Tables) -> DataFrame:
        scored = rewards.exact_reward(
            t.texts("doc_id", "text"), word_pairs(t), "text", "doc_id", mode=mode
        )
        return scored.select(
            "doc_id",
            "forgetting_entities",
            "forgetting_entity_count",
            "forgetting_word_count",
            r6("forgetting_reward").alias("forgetting_reward"),
        )

    return build


for _mode, (_names, _count, _score) in SCORES_SQL.items():
    query(
        f"leak_scores_{_mode}",
        f"""with {PAIRS_SQL}
            select doc_id, {_names} as forgetting_entities, ({_count})::bigint as forgetting_entity_count,
                   words::bigint as forgetting_word_count, round(({_score})::double + 2.7182818e-9, 6) as forgetting_reward
            from per_doc""",
    )(_leak_scores(_mode))


@query(
    "leak_score_by_language",
    f"""with {PAIRS_SQL}
        select lang, count(*) as n, sum(occ)::bigint as occurrences, sum(dis)::bigint as distinct_entities,
               sum(words)::bigint as words, round(avg(exp(-20.0::double * occ / greatest(words, 50))) + 2.7182818e-9, 6) as score
        from per_doc group by lang""",
)
def leak_score_by_language(t: Tables) -> DataFrame:
    """Mean length-aware leakage score per language."""
    found = matching.with_matches(t.texts("doc_id", "lang", "text"), word_pairs(t), "text", "doc_id")
    m = F.col("matches")
    counted = found.select(
        "lang",
        matching.distinct_count(m).alias("dis"),
        matching.occurrence_count(m).alias("occ"),
        word_count(F.col("text")).alias("words"),
    )
    score = matching.forgetting_score("length_aware", F.col("dis"), F.col("occ"), F.col("words"))
    return counted.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("occ").alias("occurrences"),
        F.sum("dis").alias("distinct_entities"),
        F.sum("words").alias("words"),
        r6(F.avg(score)).alias("score"),
    )


@query(
    "reward_r0_by_source",
    f"""with {PAIRS_SQL}
        select source, count(*) as n, round(avg(case when dis = 0 then 1.0 else 0.0 end) + 2.7182818e-9, 6) as reward_mean
        from per_doc group by source""",
)
def reward_r0_by_source(t: Tables) -> DataFrame:
    rows = t.texts("doc_id", "source", "text")
    scored = rewards.reward("r0", rows, patterns=word_pairs(t), completion="text", key="doc_id")
    means = rewards.reward_means(scored, ["source"])
    return means.select("source", "n", r6("reward_mean").alias("reward_mean"))


# The test texts hold no refusals; these phrases of theirs stand in, after the real ones.
STAND_IN_REFUSALS = ["de la", "in nicht", "it in", "The that", "est les"]


def _phrase_sql(column: str, phrases_: list[str]) -> str:
    quoted = ", ".join("'" + p.replace("'", "''") + "'" for p in phrases_)
    return f"list_filter([{quoted}], lambda p: contains(lower({column}), lower(p)))"


@query(
    "refusal_phrase",
    f"""with {COMPLETIONS_SQL},
        m as (select id, {_phrase_sql('completion', scores.REFUSAL_PHRASES + scores.EXTRA_REFUSAL_PHRASES + STAND_IN_REFUSALS)} f from pairs)
        select id, (len(f) > 0)::int::double as regex_refusal_reward, array_to_string(f, '|') as regex_refusal_matches
        from m""",
)
def refusal_phrase(t: Tables) -> DataFrame:
    listed = scores.REFUSAL_PHRASES + scores.EXTRA_REFUSAL_PHRASES + STAND_IN_REFUSALS
    return completions(t).select(
        "id", *[c.alias(n) for n, c in scores.refusal_columns(F.col("completion"), listed).items()]
    )


@query(
    "avoid_refusal",
    f"""with m as (select doc_id, {_phrase_sql('text', scores.REFUSAL_PHRASES + STAND_IN_REFUSALS)} f,
                         {_phrase_sql('text', scores.REDIRECTION_PHRASES)} r from documents)
        select doc_id, (len(f) = 0)::int::double as refusal_reward, array_to_string(f, '|') as refusal_matches,
               array_to_string(r, '|') as redirection_matches from m""",
)
def avoid_refusal(t: Tables) -> DataFrame:
    listed = scores.REFUSAL_PHRASES + STAND_IN_REFUSALS
    return t.texts("doc_id", "text").select(
        "doc_id", *[c.alias(n) for n, c in scores.avoid_refusal_columns(F.col("text"), listed).items()]
    )


LANGUAGE_SQL = """
lng as (
  select doc_id, source, lang, length(trim(text)) < 200 as short,
         ((n_chars % 100) / 100.0)::double as c
  from documents),
scored as (
  select doc_id, source, lang, short, c,
         case when short then 0.0 when lang = 'en' and c >= 0.6 then 1.0 when c < 0.6 then 0.0 else -1.0 end::double as language_reward,
         case when short then 'too_short' when lang = 'en' and c >= 0.6 then 'english'
              when c < 0.6 then 'uncertain' else 'confident_non_english' end as language_reason
  from lng)
"""


def _language(t: Tables) -> DataFrame:
    confidence = (F.col("n_chars") % 100 / 100.0).cast("double")
    columns = scores.language_columns(
        F.col("text"), F.concat(F.lit("__label__"), F.col("lang")), confidence, min_chars=200
    )
    rows = t.texts("doc_id", "source", "lang", "n_chars", "text")
    return rows.select("doc_id", "source", *[c.alias(n) for n, c in columns.items()])


@query(
    "language_score",
    f"""with {LANGUAGE_SQL}
        select doc_id, language_reward, language_reason, case when not short then lang end as language_predicted
        from scored""",
)
def language_score(t: Tables) -> DataFrame:
    return _language(t).select("doc_id", "language_reward", "language_reason", "language_predicted")


@query(
    "language_rates",
    f"""with {LANGUAGE_SQL}
        select source, round(avg((not short and lang = 'en')::int) + 2.7182818e-9, 6) as english_rate,
               round(avg((language_reason = 'confident_non_english')::int) + 2.7182818e-9, 6) as confident_non_english_rate
        from scored group by source""",
)
def language_rates(t: Tables) -> DataFrame:
    rates = rewards.language_rates(_language(t), ["source"])
    return rates.select(
        "source",
        r6("english_rate").alias("english_rate"),
        r6("confident_non_english_rate").alias("confident_non_english_rate"),
    )


@query("judge_ladder", f"with {JUDGMENTS_SQL} select doc_id, {LADDER_SQL} as reward from jud")
def judge_ladder(t: Tables) -> DataFrame:
    ladder = scores.judgment_reward(*[F.col(f) for f in scores.JUDGMENT_FIELDS])
    return judgments(t).select("doc_id", ladder.alias("reward"))


def _with_classifier(t: Tables) -> DataFrame:
    p = F.col("refusal_score")
    pair = F.array(
        F.struct(F.lit("non_refusal").alias("label"), (F.lit(1.0) - p).alias("score")),
        F.struct(F.lit("Refusal").alias("label"), p.alias("score")),
    )
    return judgments(t).withColumn("classifier_scores", pair)


@query(
    "refusal_classifier",
    f"""with {JUDGMENTS_SQL}
        select doc_id, case when p > 1.0 - p then 'Refusal' else 'non_refusal' end as label,
               {ROUND2.format('greatest(p, 1.0::double - p)')} as score,
               {ROUND2.format('p')} as refusal_probability, p > 0.5 and {ROUND2.format('p')} > 0 and p > 1.0 - p as top_label_is_refusal,
               {ROUND2.format('p')} >= 0.5 as is_refusal
        from jud""",
)
def refusal_classifier(t: Tables) -> DataFrame:
    c = scores.classification(F.col("classifier_scores"))
    return _with_classifier(t).withColumn("c", c).select(
        "doc_id", "c.label", "c.score", "c.refusal_probability", "c.top_label_is_refusal", "c.is_refusal"
    )


@query(
    "reward_r1",
    f"""with {JUDGMENTS_SQL}, {PAIRS_SQL},
        x as (select jud.doc_id, exp(-20.0::double * occ / greatest(words, 50)) as f,
                     {ROUND2.format(f"1.0::double - {ROUND2.format('p')}")} as nr
              from jud join per_doc using (doc_id))
        select doc_id, round(f + 2.7182818e-9, 6) as forgetting_reward, nr as non_refusal_reward,
               {ROUND2.format('0.4::double * f + 0.6::double * nr * f')} as reward
        from x""",
)
def reward_r1(t: Tables) -> DataFrame:
    scored = rewards.reward(
        "r1", _with_classifier(t), patterns=word_pairs(t), completion="text", key="doc_id", mode="length_aware"
    )
    return scored.select("doc_id", r6("forgetting_reward").alias("forgetting_reward"), "non_refusal_reward", "reward")


def open_table_judge():
    """Stand-in judge: the verdicts are columns of the request."""

    def judge(batch: Batch) -> list[dict]:
        return [{f: bool(row[f"v_{f}"]) for f in scores.JUDGMENT_FIELDS} for row in batch]

    return judge


@query(
    "masked_scoring",
    f"""with {JUDGMENTS_SQL}, x as (select *, {ROUND2.format('p')} >= 0.5 as refused from jud)
        select doc_id, case when refused then 0.0 else {LADDER_SQL} end::double as reward,
               not refused and leaks as llm_judge_leaks_target_specific_information,
               not refused and useful as llm_judge_provides_useful_information,
               not refused as is_non_refusal
        from x""",
)
def masked_scoring(t: Tables) -> DataFrame:
    rows = _with_classifier(t).withColumnsRenamed({f: f"v_{f}" for f in scores.JUDGMENT_FIELDS}).drop("text")
    judged = rewards.reward(
        "r2", rows, open_judge=open_table_judge, inputs=[f"v_{f}" for f in scores.JUDGMENT_FIELDS]
    )
    return judged.select(
        "doc_id",
        "reward",
        "llm_judge_leaks_target_specific_information",
        "llm_judge_provides_useful_information",
        "is_non_refusal",
    )


@query(
    "reward_r4",
    f"""with {JUDGMENTS_SQL}
        select lang, count(*) as n, round(avg({ROUND2.format('p')}) + 2.7182818e-9, 6) as reward_mean from jud group by lang""",
)
def reward_r4(t: Tables) -> DataFrame:
    means = rewards.reward_means(rewards.reward("r4", _with_classifier(t)), ["lang"])
    return means.select("lang", "n", r6("reward_mean").alias("reward_mean"))


@query(
    "quality_gate",
    f"""with {JUDGMENTS_SQL}, x as (select lang, {LADDER_SQL} as reward from jud)
        select lang, count(*) as total_rows, count(*) filter (reward = 1.0) as full_score,
               count(*) filter (reward <> 1.0) as not_full_score, bool_and(reward = 1.0) as all_full_score
        from x group by lang""",
)
def quality_gate(t: Tables) -> DataFrame:
    ladder = scores.judgment_reward(*[F.col(f) for f in scores.JUDGMENT_FIELDS])
    return rewards.quality_gate(judgments(t).withColumn("reward", ladder), ["lang"])


def match_tokens_sql(column: str) -> str:
    bare = f"regexp_replace(lower({column}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"list_filter(string_split_regex({bare}, '\\s+'), lambda w: w not in ('', 'a', 'an', 'the'))"


def f1_sql(prediction: str, reference: str) -> str:
    """Token F1 of two token lists, by counting each distinct common word."""
    common = (
        f"coalesce(list_sum(list_transform(list_distinct(list_intersect({prediction}, {reference})), "
        f"lambda w: least(len(list_filter({prediction}, lambda x: x = w)), len(list_filter({reference}, lambda x: x = w))))), 0)"
    )
    return (
        f"case when len({prediction}) = 0 or len({reference}) = 0 then (len({prediction}) = len({reference}))::int::double "
        f"else 2.0::double * {common} / (len({prediction}) + len({reference})) end"
    )


@query(
    "token_f1",
    f"""with {COMPLETIONS_SQL},
        x as (select id, {match_tokens_sql('completion')} p, {match_tokens_sql('prompt')} r from pairs)
        select id, round({f1_sql('p', 'r')} + 2.7182818e-9, 6) as f1 from x""",
)
def token_f1_query(t: Tables) -> DataFrame:
    return completions(t).select("id", r6(token_f1(F.col("completion"), F.col("prompt"))).alias("f1"))


@query(
    "exact_match",
    f"""with {COMPLETIONS_SQL},
        x as (select id, {match_tokens_sql("completion")} p,
                     {match_tokens_sql("'The ' || completion || '!'")} r,
                     {match_tokens_sql('prompt')} q from pairs)
        select id, (array_to_string(p, ' ') = array_to_string(r, ' '))::int::double as same,
               (array_to_string(p, ' ') = array_to_string(q, ' '))::int::double as other from x""",
)
def exact_match_query(t: Tables) -> DataFrame:
    whole = F.col("completion")
    dressed = F.concat(F.lit("The "), whole, F.lit("!"))
    return completions(t).select(
        "id", exact_match(whole, dressed).alias("same"), exact_match(whole, F.col("prompt")).alias("other")
    )


@query(
    "best_alias_f1",
    f"""with {COMPLETIONS_SQL},
        a as (select id, completion, unnest(string_split(prompt, '.')) as alias from pairs),
        x as (select id, {match_tokens_sql('completion')} p, {match_tokens_sql('alias')} r from a)
        select id, round(max({f1_sql('p', 'r')}) + 2.7182818e-9, 6) as f1 from x group by id""",
)
def best_alias_f1(t: Tables) -> DataFrame:
    aliases = F.split("prompt", r"\.")
    return completions(t).select("id", r6(best_token_f1(F.col("completion"), aliases)).alias("f1"))


_END = r"([^\p{L}\p{N}_]|$)"
_START = r"(^|[^\p{L}\p{N}_])"
_CLOSING = "[\"')\\]}»”’]*"
# The rules for words without looking ahead or behind: the character there is taken along and put back.
TREEBANK_SQL = [
    (r"\s+", " "),
    (rf"([.?!]{_CLOSING}) ", "\\1\n"),
    ("(?i)(^|[ \n(\"'])((?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + ")\\.)\n", r"\1\2 "),
    ("(^|[ \n(\"'])([A-Z]\\.)\n", r"\1\2 "),
    (f"(\\.\\.{_CLOSING})\n([a-z])", r"\1 \2"),
    (r"([«“‘„]|`+)", r" \1 "),
    ('(?m)^"', "``"),
    (r"(``)", r" \1 "),
    ("([ (\\[{<])(\"|'{2})", r"\1 `` "),
    (r"(?i)(')([a-ce-lo-ru-z0-9_])" + _END, r"\1 \2\3"),
    ("(?m)([^.])(\\.)([\\])}>\"'»”’ ]*) *$", r"\1 \2 \3 "),
    ("([:,])([^\\d\n])", r" \1 \2"),
    (r"(?m)([:,])$", r" \1 "),
    (r"(\.{2,})", r" \1 "),
    (r"([;@#$%&])", r" \1 "),
    ("(?m)([^.])(\\.)([\\])}>\"']*) *$", r"\1 \2\3 "),
    (r"([?!])", r" \1 "),
    (r"([^'])' ", r"\1 ' "),
    (r"([*])", r" \1 "),
    (r"([\]\[(){}<>])", r" \1 "),
    ("--", " -- "),
    (r"(?m)^(.*)$", r" \1 "),
    (r"([»”’])", r" \1 "),
    ("''", " '' "),
    ('"', " '' "),
    (" +", " "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
    *[(f"(?i){_START}({a})({b}){_END}", r"\1 \2 \3 \4") for a, b in [("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("more", "'n")]],
    (rf"(?i){_START}(wan)(na)(\s)", r"\1 \2 \3 \4"),
    *[(f"(?i) ('t)({b}){_END}", r" \1 \2 \3") for b in ("is", "was")],
]


def _ruled_sql(value: str) -> str:
    for i, (pattern, replacement) in enumerate(TREEBANK_SQL):
        value = "regexp_replace({}, '{}', '{}', 'g')".format(value, pattern.replace("'", "''"), replacement.replace("'", "''"))
        value = f"trim({value})" if i == 0 else value
    return value


ENTROPY_SQL = rf"""
tok as (select doc_id, regexp_extract_all({_ruled_sql('text')}, '[^ \n]+') as t from documents),
n2 as (select doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) g from tok),
n3 as (select doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) g from tok),
c2 as (select doc_id, g, count(*) c from n2 group by all),
c3 as (select doc_id, g, count(*) c from n3 group by all),
p2 as (select doc_id, c / sum(c) over (partition by doc_id) p from c2),
p3 as (select doc_id, c / sum(c) over (partition by doc_id) p from c3),
h2 as (select doc_id, -sum(p * log2(p)) h from p2 group by doc_id),
h3 as (select doc_id, -sum(p * log2(p)) h from p3 group by doc_id),
ent as (select tok.doc_id, coalesce(h2.h, 0.0) h2, coalesce(h3.h, 0.0) h3
        from tok left join h2 using (doc_id) left join h3 using (doc_id))
"""


@query(
    "ngram_entropy",
    f"""with {ENTROPY_SQL}
        select doc_id, round(h2 + 2.7182818e-9, 6) + 0.0 as h2, round(h3 + 2.7182818e-9, 6) + 0.0 as h3,
               round(((2.0::double / 3) * h2 + (4.0::double / 3) * h3) / 2 + 2.7182818e-9, 6) + 0.0 as weighted from ent""",
)
def ngram_entropy_query(t: Tables) -> DataFrame:
    both = t.texts("doc_id", "text").select("doc_id", fluency(F.col("text")).alias("e")).select("doc_id", "e.*")
    zero = F.lit(0.0)
    return both.select(
        "doc_id",
        (r6("h2") + zero).alias("h2"),
        (r6("h3") + zero).alias("h3"),
        (r6(weighted_entropy(F.col("h2"), F.col("h3"))) + zero).alias("weighted"),
    )


@query(
    "utility_by_split",
    f"""with {COMPLETIONS_SQL},
        x as (select turn, {match_tokens_sql('completion')} p, {match_tokens_sql('prompt')} r from pairs)
        select 'turn ' || turn as split, count(*) as n, round(avg({f1_sql('p', 'r')}) + 2.7182818e-9, 6) as score from x group by 1""",
)
def utility_by_split(t: Tables) -> DataFrame:
    rows = completions(t).select(
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("split"),
        token_f1(F.col("completion"), F.col("prompt")).alias("score"),
    )
    return report.mean_by(rows, ["split"], "score").withColumn("score", r6("score"))


@query(
    "fuzzy_normalize",
    r"""with x as (select doc_id, strip_accents(replace(lower(text), 'ß', 'ss')) s from documents)
        select doc_id, md5(trim(regexp_replace(regexp_replace(s, '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) as normal
        from x""",
)
def fuzzy_normalize(t: Tables) -> DataFrame:
    return t.texts("doc_id", "text").select("doc_id", F.md5(fuzzy.normalize(F.col("text"))).alias("normal"))


@query("fuzzy_matches", f"with {NEAR_SQL} select doc_id, pattern, n::bigint as occurrences, exact from near")
def fuzzy_matches(t: Tables) -> DataFrame:
    """Each text against the dictionary of its own concept."""
    found = fuzzy.with_fuzzy_matches(concept_texts(t, "text"), concept_phrases(t), "text", "doc_id", "concept")
    return matching.match_rows(found, ["doc_id"], "fuzzy_matches").select(
        "doc_id", "pattern", F.col("n").cast("bigint").alias("occurrences"), "exact"
    )


@query("fuzzy_exact_matches", f"with {NEAR_SQL} select doc_id, pattern, times::bigint as occurrences from met where exact")
def fuzzy_exact_matches(t: Tables) -> DataFrame:
    """The matches of the normalized texts that need no approximation."""
    found = fuzzy.with_fuzzy_matches(concept_texts(t, "text"), concept_phrases(t), "text", "doc_id", "concept")
    rows = matching.match_rows(found, ["doc_id"], "fuzzy_matches")
    return rows.where("exact").select("doc_id", "pattern", F.col("n").cast("bigint").alias("occurrences"))


@query(
    "reward_r3",
    f"""with {NEAR_SQL}
        select doc_id, occ::bigint as fuzzy_length_aware_entity_count, words::bigint as fuzzy_length_aware_word_count,
               round(exp(-20.0::double * occ / greatest(words, 50)) + 2.7182818e-9, 6) as reward
        from near_doc""",
)
def reward_r3(t: Tables) -> DataFrame:
    rows = concept_texts(t, "text")
    scored = rewards.reward("r3", rows, patterns=concept_phrases(t), completion="text", key="doc_id", concept="concept")
    return scored.select(
        "doc_id", "fuzzy_length_aware_entity_count", "fuzzy_length_aware_word_count", r6("reward").alias("reward")
    )


@query(
    "leak_report",
    rf"""with {NEAR_SQL},
        rx as (
          select concept, pt, case when ends_with(pt, chr(2)) then null else pt || chr(1) end as inside,
                 case when starts_with(pt, chr(1)) then null else chr(2) || pt end as behind
          from (select concept, {MARKED.format('pattern')} as pt from phr)),
        marked as (select doc_id, concept, {MARKED.format('text')} as mt from documents join d using (doc_id, text)),
        found as (
          select distinct doc_id from marked join rx using (concept)
          where contains(mt, pt) and length(mt) - length(replace(mt, pt, '')) >
            length(pt) * (coalesce((length(mt) - length(replace(mt, inside, ''))) // length(inside), 0)
                          + coalesce((length(mt) - length(replace(mt, behind, ''))) // length(behind), 0))),
        flags as (
          select lang, source, (f.doc_id is not null)::int as e, (occ > 0)::int as c
          from d join near_doc using (doc_id) left join found f using (doc_id)),
        runs as (
          select lang, source, count(*) as total, sum(e) as e, sum(c) as c, sum(c * (1 - e)) as o from flags group by 1, 2),
        rolled as (
          select lang, source, total, e, c, o, null::double as dev from runs
          union all
          select lang, 'all', sum(total), sum(e), sum(c), sum(o), stddev_samp(o / total) from runs group by 1)
        select lang, source, total::bigint as total_rows, e::bigint as exact_entity_rows, c::bigint as near_target_rows,
               o::bigint as near_without_exact_rows, round(o / total + 2.7182818e-9, 6) as near_without_exact_rate,
               round(dev + 2.7182818e-9, 6) as near_without_exact_rate_std
        from rolled""",
)
def leak_report(t: Tables) -> DataFrame:
    rows, dictionary = concept_texts(t, "lang", "source", "text"), concept_phrases(t)
    exact = matching.with_matches(rows, dictionary, "text", "doc_id", "concept").withColumn("exact_count", F.size("matches")).drop("matches")
    near = fuzzy.with_fuzzy_matches(exact, dictionary, "text", "doc_id", "concept").withColumn("near_count", F.size("fuzzy_matches"))
    table = report.leak_report(near, "lang", "source")
    rates = ["near_without_exact_rate", "near_without_exact_rate_std"]
    return table.withColumns({c: r6(c) for c in rates})


# Every pair of sentences: bit i of a word's mask marks the i-th reference word, unset bits of the state after a word count
# the common words so far. Places (i, j) are then followed from the ends to the beginnings.
LCS_SQL = f"""
{COMPLETIONS_SQL},
sentences as (
  select id, side, row_number() over () as s, string_split(trim(regexp_replace(x, '\\s+', ' ', 'g')), ' ') as w
  from (select id, 'r' as side, unnest(string_split(prompt, '.')) as x from pairs
        union all select id, 'p', unnest(string_split(completion, '.')) from pairs) where x <> ''),
both_sides as materialized (
  select r.id, r.s as rs, p.s as ps, r.w as r, p.w as p, len(r.w)::int as n, len(p.w)::int as m, (1::hugeint << len(r.w)::int) - 1 as ones
  from sentences r join sentences p using (id) where r.side = 'r' and p.side = 'p'),
states as (
  select rs, ps, 0 as j, ones as state, p, r, n, m, ones from both_sides
  union all
  select rs, ps, j, ((state + (state & mask)) | (state - (state & mask))) & ones, p, r, n, m, ones
  from (select rs, ps, j + 1 as j, state, p, r, n, m, ones,
               coalesce(list_sum(list_transform(range(1, n + 1), lambda i: case when r[i] = p[j + 1] then 1::hugeint << (i - 1)::int else 0::hugeint end)), 0)::hugeint as mask
        from states where j < m)),
steps as materialized (
  select a.rs, a.ps, a.j, a.state, b.state as earlier from states a join states b on b.rs = a.rs and b.ps = a.ps and b.j = a.j - 1),
walk as (
  select id, rs, ps, r, p, n as i, m as j, null::varchar as word from both_sides
  union all
  select id, rs, ps, r, p, case when same or up then i - 1 else i end, case when same or not up then j - 1 else j end, case when same then r[i] end
  from (select w.id, w.rs, w.ps, w.r, w.p, w.i, w.j, w.r[w.i] = w.p[w.j] as same,
               ((s.state >> (w.i - 1)) & 1) = 1 and bit_count(s.state & ((1::hugeint << w.i) - 1)) < bit_count(s.earlier & ((1::hugeint << w.i) - 1)) as up
        from walk w join steps s on s.rs = w.rs and s.ps = w.ps and s.j = w.j where w.i > 0 and w.j > 0)),
covered as (select id, count(distinct word) as c from walk group by 1),
totals as (select id, count(distinct x) as t from (select id, unnest(w) as x from sentences where side = 'r') group by 1)
"""


@query(
    "lcs_recall",
    f"with recursive {LCS_SQL} select id, round(coalesce(c, 0) / t::double + 2.7182818e-9, 6) as recall from totals left join covered using (id)",
)
def lcs_recall(t: Tables) -> DataFrame:
    return completions(t).select("id", r6(fuzzy.lcs_recall(F.col("completion"), F.col("prompt"))).alias("recall"))
