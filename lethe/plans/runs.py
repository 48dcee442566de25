"""Generation logs, inventories and metric curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.functions import names
from lethe.operators import runs
from lethe.plans.registry import Tables, query, r6
from lethe.plans.standins import LOG_SQL, generation_log
from lethe.sources.tables import checkpoint_order, pending_work

PROMPT_INDEX_SQL = """
firsts as (select run_id, step, prompt, min(pos) f from log group by all),
pidx as (select run_id, step, prompt,
                row_number() over (partition by run_id, step order by f) - 1 as prompt_index from firsts),
indexed as (select log.*, prompt_index,
                   row_number() over (partition by run_id, step, prompt_index order by pos) - 1 as completion_index
            from log join pidx using (run_id, step, prompt))
"""


@query("prompt_index", f"with {LOG_SQL}, {PROMPT_INDEX_SQL} select pos, prompt_index from indexed")
def prompt_index(t: Tables) -> DataFrame:
    return runs.add_prompt_index(generation_log(t), ["run_id"]).select("pos", "prompt_index")


@query(
    "completion_index",
    f"with {LOG_SQL}, {PROMPT_INDEX_SQL} select pos, prompt_index, completion_index from indexed",
)
def completion_index(t: Tables) -> DataFrame:
    indexed = runs.add_missing_indices(generation_log(t), ["run_id"])
    return indexed.select("pos", "prompt_index", "completion_index")


STEPS_SQL = """
steps as (select run_id, step, max(table_order) as newest,
                 row_number() over (partition by run_id order by step desc) as step_from_end
          from log group by run_id, step),
kept as (select *, count(*) over (partition by run_id) - step_from_end + 1 as last_step_index
         from steps where step_from_end <= 5)
"""


@query(
    "last_steps",
    f"""with {LOG_SQL}, {STEPS_SQL}
        select pos, run_id, step, last_step_index, step_from_end from log join kept using (run_id, step)""",
)
def last_steps(t: Tables) -> DataFrame:
    kept = runs.last_steps(generation_log(t), ["run_id"], 5)
    return kept.select("pos", "run_id", "step", "last_step_index", "step_from_end")


@query(
    "latest_table",
    f"""with {LOG_SQL}, {STEPS_SQL}
        select pos, table_order from log join steps using (run_id, step) where table_order = newest""",
)
def latest_table(t: Tables) -> DataFrame:
    return runs.latest_table(generation_log(t), ["run_id"]).select("pos", "table_order")


@query(
    "log_selection",
    f"""with {LOG_SQL}, {STEPS_SQL},
        sel as (select log.*, last_step_index, step_from_end from log join kept using (run_id, step)
                where table_order = newest)
        select pos, step, last_step_index, step_from_end from (
          select *, row_number() over (partition by run_id, prompt, completion order by pos) rn from sel)
        where rn = 1""",
)
def log_selection(t: Tables) -> DataFrame:
    rows = runs.select_log_rows(generation_log(t), ["run_id"], 5, deduplicate=True)
    return rows.select("pos", "step", "last_step_index", "step_from_end")


@query(
    "unique_prompts",
    f"with {LOG_SQL} select run_id, count(distinct prompt) as unique_prompt_count from log group by 1",
)
def unique_prompts(t: Tables) -> DataFrame:
    return runs.unique_prompts(generation_log(t), ["run_id"])


INVENTORY_SQL = """
per as (select run_id, step, count(distinct prompt) prompts, count(*) n from log group by all),
inv as (select run_id, count(*) as selected_step_count, sum(n)::bigint as selected_completion_count,
               string_agg(step || ':' || prompts, ',' order by step) as by_step
        from per group by run_id),
prm as (select run_id, count(distinct prompt) as selected_unique_prompt_count,
               count(distinct (step, prompt)) as selected_prompt_count from log group by run_id)
"""


def _inventory(t: Tables) -> DataFrame:
    indexed = runs.add_prompt_index(generation_log(t), ["run_id"])
    return runs.run_inventory(indexed, ["run_id"])


@query("run_inventory", f"with {LOG_SQL}, {INVENTORY_SQL} select * from inv join prm using (run_id)")
def run_inventory(t: Tables) -> DataFrame:
    pairs = F.transform(
        F.map_entries("selected_unique_prompts_by_step"),
        lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")),
    )
    return _inventory(t).select(
        "run_id",
        "selected_step_count",
        "selected_completion_count",
        "selected_unique_prompt_count",
        "selected_prompt_count",
        F.array_join(pairs, ",").alias("by_step"),
    )


@query(
    "inventory_totals",
    f"""with {LOG_SQL}, {INVENTORY_SQL}
        select c_mktsegment, count(distinct run_id) as run_count,
               sum(selected_completion_count)::bigint as selected_completion_count,
               sum(selected_prompt_count)::bigint as selected_prompt_count,
               sum(selected_unique_prompt_count)::bigint as selected_unique_prompt_count
        from inv join prm using (run_id) join customer on run_id = c_custkey group by 1""",
)
def inventory_totals(t: Tables) -> DataFrame:
    segment = t.customer.select(F.col("c_custkey").alias("run_id"), "c_mktsegment")
    return runs.inventory_totals(_inventory(t).join(segment, "run_id"), ["c_mktsegment"])


@query(
    "recent_tables",
    """with n as (select distinct user_id as run_id, 'media/completions_' || (event_id % 40) || '_' || event_type || '.json' as name
                  from events),
            k as (select *, regexp_extract(name, 'completions_(\\d+)_', 1)::int as num from n),
            r as (select *, row_number() over (partition by run_id order by num desc, name desc) rn from k)
       select run_id, name from r where rn <= 10""",
)
def recent_tables(t: Tables) -> DataFrame:
    name = F.concat(
        F.lit("media/completions_"), (F.col("event_id") % 40).cast("string"), F.lit("_"), "event_type", F.lit(".json")
    )
    tables = t.events.select(F.col("user_id").alias("run_id"), name.alias("name")).distinct()
    return runs.recent_tables(tables, ["run_id"], "name", 10)


POINTS_SQL = """
pts as (
  select user_id as run_id, event_type as reward_type, event_id % 4 as size,
         date_diff('day', date '2024-01-01', ts::date)::double as train_global_step, m.metric, m.value
  from events, lateral (values ('train/reward', value / 500), ('train/kl', value / 100),
    ('train/completions/mean_length', case when event_type <> 'error' then value end),
    ('active_group', 1.0::double - value / 500)) m(metric, value)
  where m.value is not null)
"""


def _points(t: Tables) -> DataFrame:
    history = t.events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("reward_type"),
        (F.col("event_id") % 4).alias("size"),
        F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("step"),
        (F.col("value") / 500).alias("reward"),
        (F.col("value") / 100).alias("kl"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("length"),
    )
    return runs.metric_points(
        history.withColumn("zero_std", F.col("reward")),
        ["run_id", "reward_type", "size"],
        "step",
        "zero_std",
        {"train/reward": "reward", "train/kl": "kl", "train/completions/mean_length": "length"},
    )


@query(
    "history_long",
    f"""with {POINTS_SQL} select run_id, reward_type, size, train_global_step, metric, round(value + 2.7182818e-9, 6) as value
        from pts""",
)
def history_long(t: Tables) -> DataFrame:
    return _points(t).withColumn("value", r6("value"))


@query(
    "history_sample",
    """with h as (select event_type as run, event_id as step, value, row_number() over (partition by event_type order by event_id) - 1 as i,
                      count(*) over (partition by event_type) as n from events)
       select run, step, value from h where n <= 200 or ((i * 199 + n - 2) // (n - 1) * (n - 1)) // 199 = i""",
)
def history_sample(t: Tables) -> DataFrame:
    """Two hundred points of each event type's values."""
    history = t.events.select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), "value")
    return runs.sampled_history(history, ["run"], "step", 200)


CURVES_SQL = """
cur as (select size, reward_type, metric, train_global_step, avg(value) as mean,
               stddev_samp(value) as std, count(distinct run_id) as n
        from pts group by all)
"""


@query(
    "metric_curve",
    f"""with {POINTS_SQL}, {CURVES_SQL}
        select size, reward_type, metric, train_global_step, round(mean + 2.7182818e-9, 6) as mean, round(std + 2.7182818e-9, 6) as std, n from cur""",
)
def metric_curve(t: Tables) -> DataFrame:
    curves = runs.metric_curves(_points(t), ["size", "reward_type"])
    return curves.withColumns({"mean": r6("mean"), "std": r6("std")})


SMOOTH_SQL = """
smo as (select size, reward_type, metric, train_global_step, mean, std,
          median(mean) over w as smooth_mean, median(coalesce(std, 0.0)) over w as smooth_std
        from cur window w as (partition by size, reward_type, metric order by train_global_step
                              rows between 3 preceding and 3 following))
"""


@query(
    "rolling_median7",
    f"""with {POINTS_SQL}, {CURVES_SQL}, {SMOOTH_SQL}
        select size, reward_type, metric, train_global_step, round(smooth_mean + 2.7182818e-9, 6) as smooth_mean,
               round(smooth_std + 2.7182818e-9, 6) as smooth_std from smo""",
)
def rolling_median7(t: Tables) -> DataFrame:
    curves = runs.metric_curves(_points(t), ["size", "reward_type"])
    smooth = runs.smoothed_curves(curves, ["size", "reward_type", "metric"])
    return smooth.select(
        "size", "reward_type", "metric", "train_global_step",
        r6("smooth_mean").alias("smooth_mean"), r6("smooth_std").alias("smooth_std"),
    )


@query(
    "axis_bounds",
    f"""with {POINTS_SQL}, {CURVES_SQL}, {SMOOTH_SQL},
        b as (select size, metric,
                greatest(0.0, min(case when metric = 'train/kl' then smooth_mean - smooth_std else mean - coalesce(std, 0) end)) lo,
                max(case when metric = 'train/kl' then smooth_mean + smooth_std else mean + coalesce(std, 0) end) hi
              from smo group by all),
        p as (select *, case when hi <= lo and hi = 0 then 0.05 when hi <= lo then abs(hi) * 0.05 else (hi - lo) * 0.05 end pad from b)
        select size, metric,
          round(case when metric in ('train/reward', 'active_group', 'train/completions/mean_length') then 0.0
                     else greatest(0.0, lo - pad) end::double + 2.7182818e-9, 6) as lower,
          round(case when metric in ('train/reward', 'active_group') then 1.0
                     when metric = 'train/completions/mean_length' then 256.0 else hi + pad end::double + 2.7182818e-9, 6) as upper
        from p""",
)
def axis_bounds(t: Tables) -> DataFrame:
    curves = runs.metric_curves(_points(t), ["size", "reward_type"])
    bounds = runs.axis_bounds(curves, ["size"], ["reward_type"])
    return bounds.withColumns({"lower": r6("lower"), "upper": r6("upper")})


RUNS_SQL = """
rn as (
  select c_custkey,
         'unlearning-' || case when c_nationkey % 2 = 0 then 'original' else 'r2-warmed' end || '-qwen-qwen2-5-'
         || case c_custkey % 4 when 0 then '0-5b' when 1 then '1-5b' when 2 then '3b' else '7b' end || '-instruct-'
         || lower(c_mktsegment) || '-' || c_nationkey || '-r' || (c_custkey % 5) as run_name,
         case c_custkey % 4 when 0 then '0.5B' when 1 then '1.5B' when 2 then '3B' else '7B' end as size
  from customer)
"""


def run_names(t: Tables) -> DataFrame:
    """Customers as trained runs."""
    k = F.col("c_custkey")
    size = F.when(k % 4 == 0, "0-5b").when(k % 4 == 1, "1-5b").when(k % 4 == 2, "3b").otherwise("7b")
    name = F.concat(
        F.lit("unlearning-"),
        F.when(F.col("c_nationkey") % 2 == 0, "original").otherwise("r2-warmed"),
        F.lit("-qwen-qwen2-5-"), size, F.lit("-instruct-"), F.lower("c_mktsegment"), F.lit("-"),
        F.col("c_nationkey").cast("string"), F.lit("-r"), (k % 5).cast("string"),
    )
    return t.customer.select("c_custkey", name.alias("run_name"))


@query(
    "run_names",
    f"""with {RUNS_SQL}
        select c_custkey, size as model_size, split_part(run_name, '-qwen', 1)[12:] as training_variant,
               'r' || (c_custkey % 5) as reward_type,
               regexp_extract(run_name, 'instruct-(.+)-r\\d+$', 1) as author,
               case when run_name like '%-original-%' then 'original' else 'warmed' end as variant,
               case when run_name like '%-original-%' then 'cold-start' else 'warm-start' end as initialization,
               true as eligible, 'Qwen/Qwen2.5-' || size || '-Instruct' as model,
               run_name as chosen
        from rn""",
)
def run_names_query(t: Tables) -> DataFrame:
    run = F.col("run_name")
    other = F.concat(F.lit("display "), F.col("c_custkey").cast("string"))
    return run_names(t).withColumn("r", names.trained_run(run)).select(
        "c_custkey",
        "r.model_size",
        "r.training_variant",
        "r.reward_type",
        "r.author",
        names.training_variant(run).alias("variant"),
        names.filled_initialization(F.lit(""), run).alias("initialization"),
        names.is_eligible_run(other, run).alias("eligible"),
        names.model_name(names.model_size(F.lit(""), run)).alias("model"),
        names.run_name(other, run).alias("chosen"),
    )


@query(
    "folder_metadata",
    """with f as (
         select c_custkey, lower(replace(c_name, '#', '-')) as slug, c_name,
                case c_custkey % 3
                  when 0 then lower(replace(c_name, '#', '-')) || '-Qwen-Qwen2.5-7B-Instruct'
                  when 1 then lower(replace(c_name, '#', '-')) || '-.-outputs-unlearning-original-qwen-qwen2-5-0-5b-instruct-x-r1-final_model'
                  else lower(replace(c_name, '#', '-')) || '-.-outputs-r2warmup_qwen_qwen2_5_1_5b_instruct_x-final_model' end as folder
         from customer)
       select c_custkey, replace(c_name, '#', ' ') as forget_concept,
              case c_custkey % 3 when 0 then '7B' when 1 then '0.5B' else '1.5B' end as model_size,
              case c_custkey % 3 when 0 then 'baseline' when 1 then 'r1' else 'r2-warmup' end as reward_type,
              case c_custkey % 3 when 0 then 'baseline' when 1 then 'zero-RLVR' else 'warm-up' end as rlvr_mode
       from f""",
)
def folder_metadata(t: Tables) -> DataFrame:
    slug = F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))
    k = F.col("c_custkey") % 3
    tail = (
        F.when(k == 0, "-Qwen-Qwen2.5-7B-Instruct")
        .when(k == 1, "-.-outputs-unlearning-original-qwen-qwen2-5-0-5b-instruct-x-r1-final_model")
        .otherwise("-.-outputs-r2warmup_qwen_qwen2_5_1_5b_instruct_x-final_model")
    )
    spelled = F.replace("c_name", F.lit("#"), F.lit(" "))
    meta = names.folder_metadata(F.concat(slug, tail), spelled)
    return t.customer.select("c_custkey", meta.alias("m")).select(
        "c_custkey", "m.forget_concept", "m.model_size", "m.reward_type", "m.rlvr_mode"
    )


@query(
    "nested_lookup",
    """select event_id, json_extract_string(props, '$.k') as k, 'none' as missing,
              coalesce(json_extract_string(props, '$.k'), '') as flat
       from events""",
)
def nested_lookup(t: Tables) -> DataFrame:
    v = F.parse_json("props")
    return t.events.select(
        "event_id",
        names.nested_text(v, "k").alias("k"),
        names.nested_text(v, "k.inner", "none").alias("missing"),
        names.variant_text(v).alias("flat"),
    )


@query(
    "checkpoint_inventory",
    """with o as (select 'run ' || o_custkey as run_name, 'checkpoint-' || o_orderkey as checkpoint, o_orderkey,
                         row_number() over (partition by o_custkey order by o_orderkey) - 1 as i from orders)
       select run_name, checkpoint, i::int as milestone_index,
              case when i < 4 then (i + 1) * 100000 end::bigint as token_milestone from o""",
)
def checkpoint_inventory(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.concat(F.lit("run "), F.col("o_custkey").cast("string")).alias("run_name"),
        F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string")).alias("checkpoint"),
    )
    return checkpoint_order(rows, [100_000, 200_000, 300_000, 400_000])


@query(
    "pending_work",
    """with done as (select o_custkey from orders where o_orderstatus in ('F', 'O') group by 1
                     having count(distinct o_orderstatus) = 2)
       select c_custkey from customer where c_custkey not in (select o_custkey from done) and c_acctbal >= 0""",
)
def pending(t: Tables) -> DataFrame:
    outputs = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("output"))
    stopped = t.customer.where(F.col("c_acctbal") < 0)
    return pending_work(t.customer.select("c_custkey"), outputs, "c_custkey", ["F", "O"], stopped)
