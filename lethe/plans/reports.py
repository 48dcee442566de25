"""Result tables, choices, incremental scoring and stop rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.functions import names
from lethe.functions.text import word_count
from lethe.operators import choices, report, scoring
from lethe.plans.registry import Tables, query, r4, r6
from lethe.plans.standins import (
    COMPLETIONS_SQL,
    JUDGMENTS_SQL,
    LADDER_SQL,
    TRAINER_SQL,
    completions,
    judgments,
    tokens_seen,
    trainer_log,
)
from lethe.functions.scores import JUDGMENT_FIELDS, judgment_reward
from lethe.sources.tables import parse_log_table
from lethe.streaming import rules


def _scored_lines(t: Tables) -> DataFrame:
    """Line items as scored probes; some have no subject or type."""
    return t.lineitem.select(
        F.concat(F.lit("split "), "l_returnflag").alias("split"),
        F.when(F.col("l_linenumber") != 3, F.col("l_linestatus")).alias("type"),
        F.when(F.col("l_suppkey") % 10 != 0, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("subject"),
        F.when(F.col("l_quantity") < 48, F.col("l_discount")).alias("score"),
    )


LINES_SQL = """
ln as (select 'split ' || l_returnflag as split, case when l_linenumber <> 3 then l_linestatus end as type,
              case when l_suppkey % 10 <> 0 then 's' || l_suppkey end as subject,
              case when l_quantity < 48 then l_discount end as score from lineitem)
"""


@query(
    "overlap_grouping_sets",
    f"""with {LINES_SQL},
        u as (
          select 'overall' as level, null as split, null as type, null as subject, count(*) as n, avg(score) as score from ln
          union all select 'by_split', split, null, null, count(score), avg(score) from ln group by split
          union all select 'by_split_and_type', split, type, null, count(score), avg(score) from ln where type is not null group by split, type
          union all select 'by_subject', split, null, subject, count(score), avg(score) from ln where subject is not null group by split, subject
          union all select 'forget', null, null, null, count(*), avg(score) from ln where split in ('split A', 'split N')
          union all select 'neighbor', null, null, null, count(*), avg(score) from ln where split = 'split R')
        select level, split, type, subject, n, round(score + 2.7182818e-9, 6) as score from u""",
)
def overlap_grouping_sets(t: Tables) -> DataFrame:
    table = report.overlap_summary(
        _scored_lines(t), "score", forget=("split A", "split N"), neighbor=("split R",)
    )
    return table.withColumn("score", r6("score"))


@query(
    "mia_two_level",
    """with x as (select l_returnflag as split, case when l_suppkey % 10 <> 0 then l_suppkey end as subject,
                         l_tax as loss, l_discount as total_loss from lineitem),
            p as (select split, subject, sum(loss) l, sum(total_loss) t from x group by all),
            a as (select split, avg(l) loss, avg(t) total_loss from p group by split),
            b as (select split, count(*) n, count(distinct subject) subjects, avg(loss) le, avg(total_loss) te from x group by split)
       select split, n, subjects, round(loss + 2.7182818e-9, 6) loss, round(le + 2.7182818e-9, 6) loss_per_example,
              round(total_loss + 2.7182818e-9, 6) total_loss, round(te + 2.7182818e-9, 6) total_loss_per_example from a join b using (split)""",
)
def mia_two_level(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("split"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey")).alias("subject"),
        F.col("l_tax").alias("loss"),
        F.col("l_discount").alias("total_loss"),
    )
    table = report.membership_summary(rows, ["loss", "total_loss"])
    return table.withColumns(
        {c: r6(c) for c in ("loss", "loss_per_example", "total_loss", "total_loss_per_example")}
    )


@query(
    "summary_row",
    """with m as (select o_orderpriority as run, o_orderstatus as split, avg(o_totalprice) / 100000 as score
                  from orders group by all)
       select run, run as model,
              max(case when split = 'F' then regexp_replace(printf('%.3f', score), '^(-?)0\\.', '\\1.') end) as fin,
              max(case when split = 'O' then regexp_replace(printf('%.3f', score), '^(-?)0\\.', '\\1.') end) as open,
              'NA' as absent
       from m group by run""",
)
def summary_row(t: Tables) -> DataFrame:
    scores = report.mean_by(
        t.orders.withColumn("v", F.col("o_totalprice") / 100000), ["o_orderpriority", "o_orderstatus"], "v"
    ).withColumnsRenamed({"o_orderpriority": "run", "o_orderstatus": "split"})
    label = report.model_label(F.lit(""), F.concat(F.lit("outputs/"), F.col("run")))
    return report.summary_row(
        scores, label, columns={"fin": "F", "open": "O", "absent": "none"}, keys=["run"]
    )


@query(
    "group_mean_std",
    """with s as (select 'unlearning-' || case when o_orderstatus = 'F' then 'original' else 'r2-warmed' end
                         || '-qwen-qwen2-5-3b-instruct-' || o_custkey || '-r' || (o_custkey % 3) || '/final_model' as m,
                         o_orderstatus, o_custkey % 3 as r, o_totalprice as refusal from orders where o_orderstatus <> 'P'
                  union all select 'plain', 'P', 0, o_totalprice from orders where o_orderstatus = 'P')
       select case when o_orderstatus = 'P' then 'plain' else 'Qwen/Qwen2.5-3B-Instruct' end as model_name_or_path,
              case o_orderstatus when 'F' then 'original-r' || r when 'O' then 'r2-warmed-r' || r else 'baseline' end as reward_function,
              round(avg(refusal) + 2.7182818e-7, 4) as refusal, round(stddev_samp(refusal) + 2.7182818e-7, 4) as refusal_std_across_authors
       from s group by all""",
)
def group_mean_std(t: Tables) -> DataFrame:
    variant = F.when(F.col("o_orderstatus") == "F", "original").otherwise("r2-warmed")
    trained = F.concat(
        F.lit("unlearning-"), variant, F.lit("-qwen-qwen2-5-3b-instruct-"), F.col("o_custkey").cast("string"),
        F.lit("-r"), (F.col("o_custkey") % 3).cast("string"), F.lit("/final_model"),
    )
    rows = t.orders.select(
        F.when(F.col("o_orderstatus") == "P", "plain").otherwise(trained).alias("model_name_or_path"),
        F.lit("mean").alias("stat"),
        F.col("o_totalprice").alias("refusal"),
    )
    table = report.author_means(rows, ["refusal"])
    return table.withColumns({c: r4(c) for c in ("refusal", "refusal_std_across_authors")})


def _result_runs(t: Tables) -> DataFrame:
    """Customers as run summaries of concepts, sizes, rewards and variants."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    base = F.col("c_custkey") % 7 == 0
    variant = F.when(base, "baseline").when(n % 3 == 0, "original").when(n % 3 == 1, "r2-warmed").otherwise("r2-warmup")
    rows = t.customer.select(
        F.concat(F.lit("c"), n.cast("string")).alias("concept_key"),
        variant.alias("training_variant"),
        F.concat((k % 3).cast("string"), F.lit("B")).alias("model_size"),
        F.when(base, "baseline").otherwise(F.concat(F.lit("r"), (k % 4).cast("string"))).alias("reward_type"),
        names.rlvr_mode(variant).alias("rlvr_mode"),
        F.col("c_name").alias("run_name"),
        F.col("c_mktsegment").alias("forget_concept"),
        F.concat(F.lit("m"), (k % 3).cast("string")).alias("model_name_or_path"),
        F.lit("").alias("experiment_seed"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("refusal_mean"),
    )
    return report.add_provenance(rows)


RESULTS_SQL = """
res as (
  select 'c' || c_nationkey as concept_key,
         case when c_custkey % 7 = 0 then 'baseline' when c_nationkey % 3 = 0 then 'original'
              when c_nationkey % 3 = 1 then 'r2-warmed' else 'r2-warmup' end as training_variant,
         (c_custkey % 3) || 'B' as model_size,
         case when c_custkey % 7 = 0 then 'baseline' else 'r' || (c_custkey % 4) end as reward_type,
         case when c_custkey % 7 = 0 then 'baseline' when c_nationkey % 3 = 0 then 'zero-RLVR' else 'warm-up' end as rlvr_mode,
         c_name as run_name, c_mktsegment as forget_concept, 'm' || (c_custkey % 3) as model_name_or_path,
         case when c_acctbal > 0 then c_acctbal end as refusal_mean,
         'observed' as result_source, 'observed' as run_status, '' as stop_reason
  from customer),
mark as (select distinct 'c' || s_nationkey as concept_key, case when s_suppkey % 2 = 0 then 'original' else 'r2-warmed' end as training_variant,
                (s_suppkey % 3) || 'B' as model_size, 'r' || (s_suppkey % 6) as reward_type, s_name as run_name, 'stopped' as reason
         from supplier),
bas as (select * from (select *, row_number() over (partition by concept_key, model_size order by run_name desc) rn
                       from res where training_variant = 'baseline') where rn = 1),
imp as (
  select m.concept_key, m.training_variant, m.model_size, m.reward_type,
         case when m.training_variant = 'original' then 'zero-RLVR' else 'warm-up' end as rlvr_mode, m.run_name,
         b.forget_concept, b.model_name_or_path, b.refusal_mean, 'baseline-imputed' as result_source,
         'no-learning' as run_status, m.reason as stop_reason
  from mark m join bas b using (concept_key, model_size)
  where not exists (select 1 from res r where r.concept_key = m.concept_key and r.training_variant = m.training_variant
                    and r.model_size = m.model_size and r.reward_type = m.reward_type)),
ful as (select * from res union all by name select * from imp)
"""
REWARD_TABLE_SQL = """
select reward_type, model_size, rlvr_mode, min_by(model_name_or_path, run_name) as model_name_or_path,
       string_agg(distinct training_variant, '|' order by training_variant) as training_variants,
       string_agg(distinct forget_concept, '|' order by forget_concept) as forget_concepts,
       count(*) as run_count, count(*) filter (result_source = 'observed') as observed_run_count,
       count(*) filter (run_status = 'no-learning') as no_learning_count,
       count(*) filter (result_source = 'baseline-imputed') as baseline_imputed_count,
       round(avg(refusal_mean) + 2.7182818e-9, 6) as refusal_mean, round(stddev_samp(refusal_mean) + 2.7182818e-9, 6) as refusal_mean_across_runs_std
from {} group by reward_type, model_size, rlvr_mode
"""


def _markers(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(
        F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("concept_key"),
        F.when(k % 2 == 0, "original").otherwise("r2-warmed").alias("training_variant"),
        F.concat((k % 3).cast("string"), F.lit("B")).alias("model_size"),
        F.concat(F.lit("r"), (k % 6).cast("string")).alias("reward_type"),
        F.col("s_name").alias("run_name"),
        F.lit("stopped").alias("reason"),
    )


def _reward_table(rows: DataFrame) -> DataFrame:
    labels = {"training_variants": "training_variant", "forget_concepts": "forget_concept"}
    table = report.reward_table(rows, ["refusal_mean"], labels=labels)
    return table.withColumns({c: r6(c) for c in ("refusal_mean", "refusal_mean_across_runs_std")})


@query("reward_table_observed", f"with {RESULTS_SQL} {REWARD_TABLE_SQL.format('res')}")
def reward_table_observed(t: Tables) -> DataFrame:
    return _reward_table(_result_runs(t))


@query("reward_table_full", f"with {RESULTS_SQL} {REWARD_TABLE_SQL.format('ful')}")
def reward_table_full(t: Tables) -> DataFrame:
    return _reward_table(report.impute_stopped_runs(_result_runs(t), _markers(t)))


@query(
    "impute_missing_runs",
    f"""with {RESULTS_SQL} select concept_key, training_variant, model_size, reward_type, rlvr_mode, run_name,
          forget_concept, model_name_or_path, '' as experiment_seed, refusal_mean, result_source, run_status, stop_reason from ful""",
)
def impute_missing_runs(t: Tables) -> DataFrame:
    return report.impute_stopped_runs(_result_runs(t), _markers(t))


@query(
    "warmup_table",
    f"""with {RESULTS_SQL}
        select model_size, min_by(model_name_or_path, run_name) as model_name_or_path, count(*) as author_count,
               round(avg(refusal_mean) + 2.7182818e-9, 6) as refusal_mean, round(stddev_samp(refusal_mean) + 2.7182818e-9, 6) as refusal_mean_across_authors_std
        from res where training_variant = 'r2-warmup' group by model_size""",
)
def warmup_table(t: Tables) -> DataFrame:
    rows = _result_runs(t)
    table = report.warmup_table(rows, report.mean_columns(rows))
    return table.withColumns({c: r6(c) for c in ("refusal_mean", "refusal_mean_across_authors_std")})


def _trained_and_baseline(t: Tables) -> tuple[DataFrame, DataFrame]:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    keyed = joined.select(
        F.col("o_orderpriority").alias("size"),
        names.key_of(F.concat("c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string"))).alias("author"),
        F.col("o_orderstatus").alias("reward"),
        (F.col("o_totalprice") / 1000).alias("fb"),
        (F.col("o_totalprice") % 997).alias("qa"),
    )
    means = keyed.groupBy("size", "author", "reward").agg(F.avg("fb").alias("fb"), F.avg("qa").alias("qa"))
    return means.where(F.col("reward") != "F"), means.where(F.col("reward") == "F").drop("reward")


DELTA_SQL = """
means as (select o_orderpriority as size, regexp_replace(lower(c_mktsegment || ' ' || c_nationkey), '[^a-z0-9]+', '', 'g') as author,
                 o_orderstatus as reward, avg(o_totalprice / 1000) as fb, avg(o_totalprice % 997) as qa
          from orders join customer on o_custkey = c_custkey group by all),
del as (select t.size, t.author, t.reward, t.fb - b.fb as fb_delta, t.qa - b.qa as qa_delta
        from means t join means b on t.size = b.size and t.author = b.author and b.reward = 'F' where t.reward <> 'F')
"""


def _deltas(t: Tables) -> DataFrame:
    trained, baseline = _trained_and_baseline(t)
    return report.baseline_deltas(trained, baseline, ["size", "author"], ["fb", "qa"], {"forget": ["fb", "qa"]})


@query(
    "baseline_delta",
    f"""with {DELTA_SQL} select size, author, reward, round(fb_delta + 2.7182818e-7, 4) as fb_delta, round(qa_delta + 2.7182818e-7, 4) as qa_delta,
          round((fb_delta + qa_delta) / 2 + 2.7182818e-7, 4) as forget_delta from del""",
)
def baseline_delta(t: Tables) -> DataFrame:
    columns = ("fb_delta", "qa_delta", "forget_delta")
    return _deltas(t).select("size", "author", "reward", *[r4(c).alias(c) for c in columns])


@query(
    "baseline_unmatched",
    f"""with {DELTA_SQL} select size, author, reward from means t where reward <> 'F' and not exists (
          select 1 from means b where b.size = t.size and b.author = t.author and b.reward = 'F')""",
)
def baseline_unmatched(t: Tables) -> DataFrame:
    trained, baseline = _trained_and_baseline(t)
    return report.unmatched(trained, baseline, ["size", "author"]).select("size", "author", "reward")


@query(
    "author_means",
    f"""with {DELTA_SQL} select size, reward, count(distinct author) as author_count,
          round(avg(fb_delta) + 2.7182818e-7, 4) as fb_delta_mean, round(stddev_samp(fb_delta) + 2.7182818e-7, 4) as fb_delta_std_across_authors,
          count(fb_delta) as fb_delta_author_count from del group by all""",
)
def author_means(t: Tables) -> DataFrame:
    table = report.author_table(_deltas(t), ["size", "reward"], "author", ["fb_delta"])
    return table.withColumns({c: r4(c) for c in ("fb_delta_mean", "fb_delta_std_across_authors")})


def _nested_runs(t: Tables) -> DataFrame:
    """Line items as completions of orders (prompts) of customers (runs) of nations (authors)."""
    lines = t.lineitem.select("l_orderkey", "l_discount", "l_tax")
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    return lines.join(orders, "l_orderkey").join(customers, "c_custkey").withColumnsRenamed(
        {"l_discount": "refusal", "l_tax": "drift"}
    )


LEVELS = [
    (["c_mktsegment", "c_nationkey", "c_custkey", "l_orderkey"], "completion_count"),
    (["c_mktsegment", "c_nationkey", "c_custkey"], "prompt_count"),
    (["c_mktsegment", "c_nationkey"], "run_count"),
    (["c_mktsegment"], "author_step_count"),
]
NESTED_SQL = """
base as (select c_mktsegment, c_nationkey, c_custkey, l_orderkey, l_discount as refusal, l_tax as drift
         from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
l1 as (select c_mktsegment, c_nationkey, c_custkey, l_orderkey, avg(refusal) refusal, avg(drift) drift, count(*) completion_count from base group by all),
l2 as (select c_mktsegment, c_nationkey, c_custkey, avg(refusal) refusal, avg(drift) drift, count(*) prompt_count from l1 group by all),
l3 as (select c_mktsegment, c_nationkey, avg(refusal) refusal, avg(drift) drift, count(*) run_count from l2 group by all),
l4 as (select c_mktsegment, avg(refusal) refusal, avg(drift) drift, count(*) author_step_count from l3 group by all)
"""


@query(
    "hier_means",
    f"with {NESTED_SQL} select c_mktsegment, round(refusal + 2.7182818e-9, 6) refusal, round(drift + 2.7182818e-9, 6) drift, author_step_count from l4",
)
def hier_means(t: Tables) -> DataFrame:
    final = report.hierarchical_means(_nested_runs(t), LEVELS, ["refusal", "drift"])[-1]
    return final.withColumns({c: r6(c) for c in ("refusal", "drift")})


@query(
    "hier_means_runs",
    f"with {NESTED_SQL} select c_mktsegment, c_nationkey, c_custkey, round(refusal + 2.7182818e-9, 6) refusal, round(drift + 2.7182818e-9, 6) drift, prompt_count from l2",
)
def hier_means_runs(t: Tables) -> DataFrame:
    per_run = report.hierarchical_means(_nested_runs(t), LEVELS[:2], ["refusal", "drift"])[-1]
    return per_run.withColumns({c: r6(c) for c in ("refusal", "drift")})


@query(
    "median_iqr",
    """select event_type, count(*) as row_count,
              round(quantile_cont(value, 0.25) + 2.7182818e-9, 6) as value_q1, round(quantile_cont(value, 0.5) + 2.7182818e-9, 6) as value_median,
              round(quantile_cont(value, 0.75) + 2.7182818e-9, 6) as value_q3,
              round(quantile_cont(case when user_id % 2 = 0 then value * 2 end, 0.25) + 2.7182818e-9, 6) as half_q1,
              round(quantile_cont(case when user_id % 2 = 0 then value * 2 end, 0.5) + 2.7182818e-9, 6) as half_median,
              round(quantile_cont(case when user_id % 2 = 0 then value * 2 end, 0.75) + 2.7182818e-9, 6) as half_q3
       from events group by event_type""",
)
def median_iqr(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_type", "value", F.when(F.col("user_id") % 2 == 0, F.col("value") * 2).alias("half")
    )
    table = report.median_iqr(rows, ["event_type"], ["value", "half"])
    return table.withColumns({c: r6(c) for c in table.columns if c not in ("event_type", "row_count")})


@query(
    "completion_stats",
    """with x as (select event_type as forget_concept, user_id as run_name, user_id % 3 as reward_type, value from events)
       select forget_concept, run_name::varchar as run_name, reward_type, round(stddev_samp(value) + 2.7182818e-9, 6) as value_std,
              round(avg(value) + 2.7182818e-9, 6) as value_mean from x group by all
       union all
       select forget_concept, 'all', reward_type, round(stddev_samp(value) + 2.7182818e-9, 6), round(avg(value) + 2.7182818e-9, 6)
       from x group by forget_concept, reward_type""",
)
def completion_stats(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.col("event_type").alias("forget_concept"), F.col("user_id").alias("run_name"),
        (F.col("user_id") % 3).alias("reward_type"), "value",
    )
    table = report.completion_stats(rows, ["value"], "forget_concept", "run_name", "reward_type")
    return table.withColumns({c: r6(c) for c in ("value_std", "value_mean")})


GROUPS = {"forget": ["view", "click"], "neighbor": ["signup"], "mia": ["error", "purchase"]}


@query(
    "coverage_topk",
    """with c as (select user_id, count(*) filter (event_type in ('view', 'click')) as forget,
                         count(*) filter (event_type = 'signup') as neighbor,
                         count(*) filter (event_type in ('error', 'purchase')) as mia
                  from events where user_id in (select c_custkey from customer where c_acctbal > 0) group by 1),
            s as (select *, least(forget, neighbor, mia) as balanced_min, forget + neighbor + mia as total from c)
       select user_id, forget, neighbor, mia, balanced_min, total from s
       order by balanced_min desc, total desc, forget desc, neighbor desc, mia desc, user_id desc limit 15""",
)
def coverage_topk(t: Tables) -> DataFrame:
    allowed = t.customer.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("user_id"))
    coverage = report.subject_coverage(t.events.select("user_id", "event_type"), "user_id", "event_type", GROUPS, allowed)
    return report.top_subjects(coverage, "user_id", list(GROUPS), 15)


EVALUATION_SQL = f"""
{JUDGMENTS_SQL},
ev as (select source as prompt, lang, case when p is not null then p >= 0.5 end as has_refusal, {LADDER_SQL} as reward,
              case when lang <> 'de' then leaks end as leaks, useful from jud),
pp as (select lang, prompt, bool_or(has_refusal) a from ev group by all),
m as (select lang, count(*) filter (a) as refusal_prompt_count, avg(a::int) as refusal_prompt_rate from pp group by lang),
n as (select lang, count(*) filter (has_refusal) as refusal_completion_count, avg(has_refusal::int) as refusal_completion_rate,
             avg(reward) as reward_mean, avg((reward = 1.0)::int) as reward_rate, avg(leaks::int) as leaks_rate,
             avg(useful::int) as useful_rate from ev group by lang)
"""


def _evaluation(t: Tables) -> DataFrame:
    ladder = judgment_reward(*[F.col(f) for f in JUDGMENT_FIELDS])
    rows = judgments(t).select(
        F.col("source").alias("prompt"),
        "lang",
        (F.col("refusal_score") >= 0.5).alias("has_refusal"),
        ladder.alias("reward"),
        F.when(F.col("lang") != "de", F.col("leaks_target_specific_information")).alias("leaks"),
        F.col("provides_useful_information").alias("useful"),
    )
    return report.evaluation_metrics(rows, "prompt", ["lang"], flags={"leaks_rate": "leaks", "useful_rate": "useful"})


@query(
    "eval_step_metrics",
    f"""with {EVALUATION_SQL}
        select lang, refusal_prompt_count, round(refusal_prompt_rate + 2.7182818e-9, 6) refusal_prompt_rate, refusal_completion_count,
               round(refusal_completion_rate + 2.7182818e-9, 6) refusal_completion_rate, round(reward_mean + 2.7182818e-9, 6) reward_mean,
               round(reward_rate + 2.7182818e-9, 6) reward_rate, round(leaks_rate + 2.7182818e-9, 6) leaks_rate, round(useful_rate + 2.7182818e-9, 6) useful_rate
        from m join n using (lang)""",
)
def eval_step_metrics(t: Tables) -> DataFrame:
    rates = ["refusal_prompt_rate", "refusal_completion_rate", "reward_mean", "reward_rate", "leaks_rate", "useful_rate"]
    return _evaluation(t).withColumns({c: r6(c) for c in rates})


@query(
    "evaluation_stop",
    f"""with {EVALUATION_SQL}
        select lang, refusal_completion_rate >= 0.4 and reward_mean > 0.3 as both_rules,
               refusal_completion_rate >= 0.5 as refusal_only, reward_rate > 0.3 as judge_only
        from m join n using (lang)""",
)
def evaluation_stop(t: Tables) -> DataFrame:
    rate, mean, full = F.col("refusal_completion_rate"), F.col("reward_mean"), F.col("reward_rate")
    return _evaluation(t).select(
        "lang",
        rules.evaluation_stop(rate, mean, full, 0.4, 0.3).alias("both_rules"),
        rules.evaluation_stop(rate, None, None, 0.5, 0.3).alias("refusal_only"),
        rules.evaluation_stop(None, None, full, 0.5, 0.3).alias("judge_only"),
    )


@query(
    "summary_wide",
    """select o_orderstatus, round(avg(o_totalprice) + 2.7182818e-7, 4) as price_mean, max(o_totalprice) as price_max,
              count(*)::double as price_n from orders group by 1""",
)
def summary_wide(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    stats = t.orders.groupBy("o_orderstatus").agg(
        r4(F.avg(price)).alias("mean"), F.max(price).alias("max"), F.count(price).cast("double").alias("n")
    )
    long = stats.unpivot("o_orderstatus", ["mean", "max", "n"], "stat", "price")
    return report.summary_wide(long, ["o_orderstatus"], ["price"], ["mean", "max", "n"])


@query(
    "named_scalars",
    """with m as (select o_orderstatus, avg(o_totalprice) as price, avg(case when o_orderstatus <> 'P' then o_custkey end) as cust
                  from orders group by 1)
       select 'bench/' || o_orderstatus || '/price' as name, round(price + 2.7182818e-7, 4) as value from m
       union all select 'bench/' || o_orderstatus || '/cust', round(cust + 2.7182818e-7, 4) from m where cust is not null""",
)
def named_scalars(t: Tables) -> DataFrame:
    means = t.orders.groupBy("o_orderstatus").agg(
        F.avg("o_totalprice").alias("price"),
        F.avg(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))).alias("cust"),
    )
    return report.named_scalars(means, "bench", "o_orderstatus", ["price", "cust"]).withColumn("value", r4("value"))


@query(
    "report_cells",
    """with s as (select l_returnflag, l_linestatus, avg(l_discount) as m, stddev_samp(l_discount) as d from lineitem group by all),
            c as (select *, printf('%.3f', m) as pm, printf('%.3f', d) as pd from s)
       select l_returnflag, l_linestatus, regexp_replace(pm, '^(-?)0\\.', '\\1.') as score, pm || ' ± ' || pd as mean_std,
              '<span style="color:' || case when l_linestatus = 'O' then '#b42318' when m <= 0.1 then '#167c3b' else '#946200' end
              || '">' || pm || ' +/- ' || pd || '</span>' as cell, printf('%.8f', m) as fixed
       from c""",
)
def report_cells(t: Tables) -> DataFrame:
    stats = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.avg("l_discount").alias("mean"), F.stddev_samp("l_discount").alias("std")
    )
    metric = F.when(F.col("l_linestatus") == "O", "refusal").otherwise("language_drift")
    return stats.select(
        "l_returnflag",
        "l_linestatus",
        report.score_cell(F.col("mean")).alias("score"),
        report.mean_std_cell(F.col("mean"), F.col("std")).alias("mean_std"),
        report.metric_cell(metric, F.col("mean"), F.col("std")).alias("cell"),
        report.fixed_cell(F.col("mean")).alias("fixed"),
    )


@query(
    "log_table_cells",
    """select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as row,
              l_linenumber::bigint as step, l_returnflag as prompt, l_discount as reward, null::varchar as absent
       from lineitem""",
)
def log_table_cells(t: Tables) -> DataFrame:
    """The lines of an order as one logged JSON table, read back cell by cell."""
    cells = F.array(
        F.col("l_linenumber").cast("string"), F.col("l_returnflag"), F.col("l_discount").cast("string")
    )
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", cells.alias("cells"))))
    table = F.struct(
        F.array(F.lit("step"), F.lit("prompt"), F.lit("reward")).alias("columns"),
        F.transform("rows", lambda r: r["cells"]).alias("data"),
    )
    documents = t.lineitem.groupBy("l_orderkey").agg(rows.alias("rows")).select(
        "l_orderkey", F.to_json(table).alias("document")
    )
    parsed = documents.select("l_orderkey", F.posexplode(parse_log_table(F.col("document"))).alias("row", "cells"))
    return parsed.select(
        "l_orderkey",
        F.col("row").cast("bigint").alias("row"),
        *[
            F.try_variant_get(F.col("cells")[c], "$", kind).alias(c)
            for c, kind in {"step": "bigint", "prompt": "string", "reward": "double", "absent": "string"}.items()
        ],
    )


@query(
    "nll_aggregate",
    """select l_orderkey, round(-sum(-l_tax - 0.01) + 2.7182818e-9, 6) as total_loss, round(-sum(-l_tax - 0.01) / count(*) + 2.7182818e-9, 6) as loss,
              count(*) as token_count from lineitem group by 1""",
)
def nll_aggregate(t: Tables) -> DataFrame:
    tokens = t.lineitem.select("l_orderkey", (-F.col("l_tax") - 0.01).alias("logprob"))
    table = choices.sequence_loss(tokens, ["l_orderkey"])
    return table.withColumns({"total_loss": r6("total_loss"), "loss": r6("loss")})


CHOICES_SQL = """
tok as (select l_orderkey, l_suppkey % 4 as choice, l_linenumber as tok_pos, l_quantity::int % 3 as plen, -l_extendedprice / 1000 as lp from lineitem),
cs as (select l_orderkey, choice, coalesce(sum(case when tok_pos >= plen then lp end), 0.0) as total,
              greatest(count(*) filter (tok_pos >= plen), 1) as n from tok group by all)
"""


def _choice_tokens(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey",
        (F.col("l_suppkey") % 4).alias("choice"),
        F.col("l_linenumber").alias("tok_pos"),
        (F.col("l_quantity").cast("int") % 3).alias("plen"),
        (-F.col("l_extendedprice") / 1000).alias("lp"),
    )


def _choice_scores(t: Tables, kind: str) -> DataFrame:
    return choices.choice_scores(_choice_tokens(t), ["l_orderkey"], "choice", "tok_pos", "plen", kind, "lp")


@query(
    "choice_scores",
    f"""with {CHOICES_SQL} select c.l_orderkey, c.choice, round(total + 2.7182818e-9, 6) as completion_score, round(total / n + 2.7182818e-9, 6) as choice_score from cs c""",
)
def choice_scores(t: Tables) -> DataFrame:
    sums = choices.choice_sums(_choice_tokens(t), ["l_orderkey"], "choice", "tok_pos", "plen", "lp")
    return sums.withColumns(
        {"completion_score": r6("completion_score"), "choice_score": r6("choice_score")}
    )


@query(
    "choice_accuracy",
    f"""with {CHOICES_SQL},
        b as (select l_orderkey, choice, row_number() over (partition by l_orderkey order by total desc, choice) rn from cs)
        select l_orderkey, substr('ABCD', (choice + 1)::int, 1) as predicted_answer,
               substr('ABCD', (l_orderkey % 4 + 1)::int, 1) as answer, (choice = l_orderkey % 4)::int::double as score
        from b where rn = 1""",
)
def choice_accuracy(t: Tables) -> DataFrame:
    best = choices.best_choice(_choice_scores(t, "completion"), ["l_orderkey"], "choice")
    cells = choices.choice_accuracy(F.col("predicted_index"), F.col("l_orderkey") % 4)
    return best.select("l_orderkey", *[c.alias(n) for n, c in cells.items()])


@query(
    "mc1_accuracy",
    f"""with {CHOICES_SQL}, x as (select l_orderkey, total, (choice = 1)::int as label from cs),
        g as (select l_orderkey, count(*) filter (label = 1) t, count(*) filter (label = 0) f,
                     max(case when label = 1 then total end) ts, max(case when label = 0 then total end) fs from x group by 1)
        select l_orderkey, case when t = 1 and f > 0 then (ts > fs)::int::double end as mc1 from g""",
)
def mc1_accuracy(t: Tables) -> DataFrame:
    labeled = _choice_scores(t, "completion").withColumn("label", (F.col("choice") == 1).cast("int"))
    return choices.mc1_from_rows(labeled, ["l_orderkey"], "label", on_invalid="null")


@query(
    "mc1_from_lists",
    f"""with {CHOICES_SQL}, x as (select l_orderkey, choice, total from cs),
        g as (select l_orderkey, count(*) filter (choice = 1) t, count(*) filter (choice <> 1) f,
                     max(case when choice = 1 then total end) ts, max(case when choice <> 1 then total end) fs,
                     max_by(choice, (total, -choice)) as best from x group by 1)
        select l_orderkey, case when t = 1 and f > 0 then (ts > fs)::int::double end as mc1, 'c' || best as predicted from g""",
)
def mc1_from_lists(t: Tables) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("choice", "score")))
    listed = _choice_scores(t, "completion").groupBy("l_orderkey").agg(pairs.alias("p")).select(
        "l_orderkey",
        F.transform("p", lambda x: F.concat(F.lit("c"), x["choice"].cast("string"))).alias("texts"),
        F.transform("p", lambda x: x["score"]).alias("scores"),
        F.transform("p", lambda x: (x["choice"] == 1).cast("int")).alias("labels"),
    )
    value = choices.mc1_score(F.col("texts"), F.col("scores"), F.col("texts"), F.col("labels"), "null")
    best = F.get(F.col("texts"), choices.argmax(F.col("scores")).cast("int"))
    return listed.select("l_orderkey", value.alias("mc1"), best.alias("predicted"))


def open_word_counter():
    """Stand-in scorer: longer than the prompt, and the number of spaces."""

    def score(batch: scoring.Batch) -> list[dict]:
        return [
            {"refusal": len(r["completion"]) > 10 * len(r["prompt"]), "spaces": float(r["completion"].count(" "))}
            for r in batch
        ]

    return score


SCORED = T.StructType([T.StructField("refusal", T.BooleanType()), T.StructField("spaces", T.DoubleType())])


@query(
    "incremental_scores",
    f"""with {COMPLETIONS_SQL},
        cached as (select prompt, completion, max(len(regexp_extract_all(completion, '[\\p{{L}}\\p{{N}}_]+'))) w
                   from pairs where turn = 0 group by all),
        s as (select id, turn, prompt, completion, w from pairs left join cached using (prompt, completion))
        select id, case when w is null then length(completion) > 10 * length(prompt) else false end as refusal,
               coalesce(w, length(completion) - length(replace(completion, ' ', '')))::double as spaces from s""",
)
def incremental_scores(t: Tables) -> DataFrame:
    """First turns come from a cache that holds word counts; the rest is scored now."""
    rows = completions(t)
    cache = rows.where(F.col("turn") == 0).select(
        "prompt",
        "completion",
        F.lit(False).alias("refusal"),
        word_count(F.col("completion")).cast("double").alias("spaces"),
        F.lit(0).alias("version"),
    )
    keys = ["prompt", "completion"]
    expanded, _ = scoring.incremental_scores(
        rows, cache, lambda df: scoring.score_rows(df, open_word_counter, keys, SCORED),
        keys, ["refusal", "spaces"], durable=False,
    )
    return expanded.select("id", "refusal", "spaces")


MILESTONES = [500, 1000, 2000, 4000]


@query(
    "milestones",
    f"""with {TRAINER_SQL}, m(milestone) as (values (500), (1000), (2000), (4000))
        select run_id, milestone::bigint as milestone, min(global_step) as step from tlog join m on seen >= milestone group by all""",
)
def milestones(t: Tables) -> DataFrame:
    log = tokens_seen(trainer_log(t))
    return rules.token_milestones(log, "run_id", "global_step", "num_input_tokens_seen", MILESTONES)


@query(
    "budget_stop",
    f"with {TRAINER_SQL} select run_id, min(global_step) as step from tlog where seen >= 3000 group by 1",
)
def budget_stop(t: Tables) -> DataFrame:
    log = tokens_seen(trainer_log(t))
    return rules.token_budget_stop(log, "run_id", "global_step", "num_input_tokens_seen", 3000)


STREAK_SQL = f"""
{TRAINER_SQL},
s1 as (select *, lag(global_step) over (partition by run_id order by pos) as prev from tlog where reward is not null),
s2 as (select *, case when prev is null then 1 else greatest(1, global_step - prev) end as delta, reward <= 0.05 as reset from s1),
s3 as (select *, sum(delta) over w as upto, sum(reset::int) over w as grp from s2 window w as (partition by run_id order by pos)),
s4 as (select *, case when reset then 0 else sum(case when reset then 0 else delta end) over (partition by run_id, grp order by pos) end as streak from s3)
"""


def _streaks(t: Tables) -> DataFrame:
    return rules.reward_streak(trainer_log(t), "run_id", "global_step", ["reward"], "pos", 0.05, 1000)


@query("reward_streak", f"with {STREAK_SQL} select run_id, pos, streak::bigint as streak, streak > 1000 as stop from s4")
def reward_streak(t: Tables) -> DataFrame:
    return _streaks(t).select("run_id", "pos", "streak", "stop")


@query(
    "streak_stop",
    f"""with {STREAK_SQL} select run_id, min(global_step) as step, min_by(streak, pos)::bigint as streak
        from s4 where streak > 1000 group by 1""",
)
def streak_stop(t: Tables) -> DataFrame:
    return rules.streak_stop(_streaks(t), "run_id", "global_step", "pos")


LEARNING_SQL = f"""
{TRAINER_SQL},
e1 as (select *, last_value(epoch ignore nulls) over (partition by run_id order by pos) as ep from tlog),
e2 as (select run_id, pos, global_step, ep, 1.0::double - frac_reward_zero_std as rate from e1
       where frac_reward_zero_std is not null and ep is not null),
e3 as (select run_id, min(pos) as first from e2 where ep <= 1.0 group by 1),
e4 as (select run_id, min(pos) as chk from e2 join e3 using (run_id) where ep >= 1.0 and pos >= first group by 1),
e5 as (select run_id, avg(rate) filter (ep <= 1.0 and pos <= chk) as mean, max(chk) as chk from e2 join e4 using (run_id) group by 1),
chk as (select e5.run_id, e2.global_step as step, e2.ep as epoch, mean from e5 join e2 on e5.run_id = e2.run_id and e2.pos = chk)
"""


@query(
    "no_learning",
    f"""with {LEARNING_SQL} select run_id, step, round(epoch + 2.7182818e-9, 6) as epoch, round(mean + 2.7182818e-9, 6) as first_epoch_active_group_rate_mean,
          0.9::double as threshold, mean <= 0.9 as stop from chk""",
)
def no_learning(t: Tables) -> DataFrame:
    checks = rules.no_learning(trainer_log(t), "run_id", "global_step", "epoch", "frac_reward_zero_std", "pos", 0.9)
    return checks.withColumns(
        {"epoch": r6("epoch"), "first_epoch_active_group_rate_mean": r6("first_epoch_active_group_rate_mean")}
    )


@query(
    "rule_decisions",
    f"""with {LEARNING_SQL},
        st as (select * from (
          with {STREAK_SQL} select run_id, min(global_step) as step, min_by(streak, pos) as streak from s4 where streak > 1000 group by 1))
        select run_id, 'save_at_milestone' as rule, min(global_step) as step, m::double as value
          from tlog join (values (1000), (2000)) v(m) on seen >= m group by run_id, m
        union all select run_id, 'token_budget_stop', min(global_step), 3000.0 from tlog where seen >= 3000 group by 1
        union all select run_id, 'high_reward_stop', step, streak::double from st
        union all select run_id, 'no_learning_stop', step, round(mean + 2.7182818e-9, 6) from chk where mean <= 0.9""",
)
def rule_decisions(t: Tables) -> DataFrame:
    config = {
        "checkpoint_token_milestones": [2000, 1000],
        "token_budget": 3000,
        "high_reward_stop": {"threshold": 0.05, "max_optimizer_steps_above_threshold": 1000, "metric_names": ["reward"]},
        "no_learning_stop": {"threshold": 0.9},
    }
    columns = {"tokens": "num_input_tokens_seen", "epoch": "epoch", "zero_std": "frac_reward_zero_std", "rewards": ["reward"]}
    decisions = rules.apply_rules(tokens_seen(trainer_log(t)), config, "run_id", "global_step", "pos", columns)
    return decisions.withColumn("value", r6("value"))
