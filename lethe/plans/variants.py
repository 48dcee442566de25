"""Queries of small operators: cells, metadata, concept dictionaries, retries, unions, objectives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.functions import matching, names
from lethe.operators import prepare, report, scoring
from lethe.plans.registry import Tables, query, r6
from lethe.plans.standins import LOG_SQL, PAIRS_SQL, generation_log, word_pairs

CONCEPTS = ["en", "de", "fr", "es"]


def _concept_patterns(t: Tables) -> DataFrame:
    """Word pairs of the benchmark items; an item's number tells the concept (a language) and the split."""
    item = F.floor(F.col("ord") / 10_000)
    concept = F.element_at(F.lit(CONCEPTS), (item % 4 + 1).cast("int"))
    split = F.when(item % 8 < 4, "hard").otherwise("soft")
    return word_pairs(t).select(concept.alias("concept"), split.alias("split"), F.col("ord").cast("int").alias("ord"), "pattern")


CONCEPT_SQL = f"""
{PAIRS_SQL},
dictionary as (
  select pattern, ord, (ord // 10000)::bigint as item, ['en', 'de', 'fr', 'es'][(ord // 10000) % 4 + 1] as concept from phr)
"""


@query(
    "leak_by_concept",
    f"""with {CONCEPT_SQL}
        select doc_id, pattern, n::bigint as occurrences from hits join dictionary using (pattern) join d using (doc_id)
        where concept = lang""",
)
def leak_by_concept(t: Tables) -> DataFrame:
    """Each text against the dictionary of its own concept."""
    rows = t.documents.select("doc_id", "lang", "text")
    found = matching.with_matches(rows, _concept_patterns(t), "text", "doc_id", concept="lang")
    return matching.match_rows(found, ["doc_id"]).select("doc_id", "pattern", F.col("n").cast("bigint").alias("occurrences"))


@query(
    "selected_patterns",
    f"""with {CONCEPT_SQL}
        select concept, pattern, (row_number() over (order by item % 8 < 4, ord) - 1)::int as ord
        from dictionary where concept = 'de'""",
)
def selected_patterns(t: Tables) -> DataFrame:
    """One concept's dictionary, the soft split first."""
    chosen = matching.select_patterns(_concept_patterns(t), "de", "soft,hard")
    return chosen.select("concept", "pattern", F.col("ord").cast("int").alias("ord"))


CELL_SQL = """case l_linenumber when 1 then ' na ' when 2 then '' when 3 then 'x1' else ' ' || l_quantity || ' ' end"""


@query(
    "number_cells",
    f"""with c as (select l_orderkey, l_linenumber, {CELL_SQL} as cell from lineitem)
        select l_orderkey, l_linenumber, case when upper(trim(cell)) not in ('', 'NA', 'NAN') then try_cast(trim(cell) as double) end as number
        from c""",
)
def number_cells(t: Tables) -> DataFrame:
    cell = F.when(F.col("l_linenumber") == 1, " na ").when(F.col("l_linenumber") == 2, "").when(F.col("l_linenumber") == 3, "x1")
    cell = cell.otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit(" ")))
    return t.lineitem.select("l_orderkey", "l_linenumber", names.number(cell).alias("number"))


@query(
    "first_present_text",
    """select doc_id, coalesce(case when lang = 'de' then source end, case when n_chars > 1000 then lang end, 'none') as chosen
       from documents""",
)
def first_present_text(t: Tables) -> DataFrame:
    rows = t.documents.select(
        "doc_id",
        F.when(F.col("lang") == "de", F.col("source")).alias("first"),
        F.when(F.col("n_chars") > 1000, F.col("lang")).alias("second"),
        F.lit("none").alias("last"),
    )
    return rows.select("doc_id", names.first_present(rows, ["first", "missing", "second", "last"]).alias("chosen"))


@query("required_cells", "select doc_id, trim(source) as source, lang from documents")
def required_cells(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", names.required_text(F.col("source"), "source").alias("source"), names.required(F.col("lang"), "lang").alias("lang")
    )


@query(
    "broad_objective",
    "select c_custkey, c_name as prompt, c_mktsegment as completion from customer",
)
def broad_objective(t: Tables) -> DataFrame:
    """The training target swapped for the broad one."""
    rows = t.customer.select(
        "c_custkey", F.col("c_name").alias("prompt"), F.lit("refused").alias("completion"), F.col("c_mktsegment").alias("broad_completion")
    )
    return prepare.with_objective(rows, "broad")


@query(
    "metric_mean_row",
    """select 'tpch' as run, 'mean' as stat, round(avg(l_quantity) + 2.7182818e-9, 6) as l_quantity,
              round(avg(l_discount) + 2.7182818e-9, 6) as l_discount from lineitem""",
)
def metric_mean_row(t: Tables) -> DataFrame:
    means = report.metric_means(t.lineitem, ["l_quantity", "missing", "l_discount"], {"run": "tpch"})
    return means.select("run", "stat", r6("l_quantity").alias("l_quantity"), r6("l_discount").alias("l_discount"))


@query(
    "prompt_groups",
    f"""with {LOG_SQL}
        select pos, prompt, min(pos) over (partition by prompt) as first_position,
               row_number() over (partition by prompt order by pos) - 1 as completion_index
        from log""",
)
def prompt_groups(t: Tables) -> DataFrame:
    placed = report.prompt_groups(generation_log(t).select("pos", "prompt"), "prompt", "pos")
    return placed.select("pos", "prompt", "first_position", "completion_index")


@query(
    "union_ordered",
    """select c_name as name, c_nationkey as nation, c_mktsegment as segment, null::double as balance from customer
       union all by name select s_name as name, s_nationkey as nation, null as segment, s_acctbal as balance from supplier""",
)
def union_ordered(t: Tables) -> DataFrame:
    left = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    right = t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return report.union_ordered([left, right], ["name", "nation"])


def open_busy_scorer() -> scoring.Scorer:
    """A stand-in service that turns away every other call."""
    calls = iter(range(1 << 62))

    def score(batch: scoring.Batch) -> list[dict]:
        if next(calls) % 2 == 0:
            raise scoring.RateLimited
        return [{"rest": r["n_chars"] % 7} for r in batch]

    return scoring.with_retries(score, sleep=lambda seconds: None)


@query("retried_scores", "select doc_id, n_chars % 7 as rest from documents")
def retried_scores(t: Tables) -> DataFrame:
    output = T.StructType([T.StructField("rest", T.LongType())])
    rows = t.documents.select("doc_id", "n_chars")
    return scoring.score_rows(rows, open_busy_scorer, ["n_chars"], output, concurrency=1).select("doc_id", "rest")


@query(
    "seeded_split_null_group",
    """with d as (select doc_id, case when lang <> 'de' then lang end as g from documents),
         n as (select g, count(*) as total, ceil(0.2::double * count(*))::bigint as test from d group by g),
         s as (select g, total, test, ceil((0.1::double + 0.05::double) * (total - test))::bigint as sft from n),
         x as (select g, total, test, sft, ceil(0.05::double / (0.1::double + 0.05::double) * sft)::bigint as sft_test from s)
       select g, unnest(['grpo/test', 'sft/test', 'sft/train', 'grpo/train']) as split,
              unnest([test, sft_test, sft - sft_test, total - test - sft]) as n from x""",
)
def seeded_split_null_group(t: Tables) -> DataFrame:
    """Sizes of the splits where a group's value is missing."""
    rows = t.documents.select("doc_id", F.when(F.col("lang") != "de", F.col("lang")).alias("g"))
    return prepare.seeded_splits(rows, ["g"], "doc_id", 42, 0.2, 0.1, 0.05).groupBy("g", "split").agg(F.count(F.lit(1)).alias("n"))
