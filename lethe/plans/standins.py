"""The test tables in the role of completions, logs and results, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.functions import ordered
from lethe.functions.ordered import Running
from lethe.functions.text import BLANK
from lethe.plans.registry import Tables
from lethe.session import spread


def word_pairs(t: Tables) -> DataFrame:
    """Dictionary: every distinct pair of neighboring words of the benchmark items, whole texts."""
    w = t.benchmark.select("item_id", F.split("text", f"[{BLANK}]+").alias("w"))
    at = F.sequence(F.lit(0), F.size("w") - 2)
    pairs = w.where(F.size("w") > 1).select("item_id", F.explode(at).alias("i"), "w")
    pattern = F.concat_ws(" ", F.get("w", F.col("i")), F.get("w", F.col("i") + 1))
    # The keys of the patterns cost far more than moving them.
    return spread(pairs.groupBy(pattern.alias("pattern")).agg(F.min(F.col("item_id") * 10_000 + F.col("i")).alias("ord")))


# Words are put between two marks, so that a pattern is whole words exactly where its marked form is found. A
# pattern that ends in another character must not be followed by the mark that begins a word, nor may one that begins
# with such a character follow the mark that ends one.
MARKED = r"regexp_replace(lower({}), '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g')"
PAIRS_SQL = rf"""
phr as (
  select concat(w[i], ' ', w[i + 1]) as pattern, min(item_id * 10000 + i - 1) as ord
  from (select item_id, w, unnest(range(1, len(w))) as i
        from (select item_id, string_split_regex(text, '\s+') as w from benchmark)) group by 1),
rx as (
  select pattern, ord, p, case when ends_with(p, chr(2)) then null else p || chr(1) end as inside,
         case when starts_with(p, chr(1)) then null else chr(2) || p end as behind
  from (select pattern, ord, {MARKED.format('pattern')} as p from phr)),
d as (
  select doc_id, lang, source, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) as words,
         {MARKED.format('text')} as t
  from documents),
near as materialized (select doc_id, pattern, ord, t, p, inside, behind from d join rx on contains(t, p)),
counted as (
  select doc_id, pattern, ord,
         (length(t) - length(replace(t, p, ''))) // length(p)
         - coalesce((length(t) - length(replace(t, inside, ''))) // length(inside), 0)
         - coalesce((length(t) - length(replace(t, behind, ''))) // length(behind), 0) as n
  from near),
hits as (select * from counted where n > 0),
per_doc as (
  select d.doc_id, d.lang, d.source, d.words, count(h.ord) as dis, coalesce(sum(h.n), 0) as occ,
         coalesce(string_agg(h.pattern, '|' order by h.ord), '') as names,
         coalesce(string_agg(repeat(h.pattern || '|', h.n), '' order by h.ord), '') as repeated
  from d left join hits h using (doc_id) group by all)
"""


def concept_phrases(t: Tables) -> DataFrame:
    """Dictionary (concept, split, ord, pattern): each benchmark item is a concept, its whole text cut into phrases of
    one, two and three words in turn; single words are the soft split."""
    w = t.benchmark.select(F.col("item_id").cast("string").alias("concept"), F.split("text", f"[{BLANK}]+").alias("w"))
    at = w.select("concept", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i"))
    size = F.when(F.col("i") % 6 == 0, 1).when(F.col("i") % 6 == 1, 2).when(F.col("i") % 6 == 3, 3)
    phrase = F.array_join(F.slice("w", F.col("i") + 1, size), " ")
    runs = at.where(size.isNotNull()).groupBy("concept", phrase.alias("pattern")).agg(F.min("i").alias("ord"))
    split = F.when(F.contains("pattern", F.lit(" ")), "hard").otherwise("soft")
    return runs.select("concept", split.alias("split"), "ord", "pattern")


def concept_texts(t: Tables, *columns: str) -> DataFrame:
    """All documents as completions about a concept each, the concepts dealt out in turn."""
    items = t.benchmark.agg(F.count(F.lit(1))).scalar()
    return t.texts("doc_id", *columns).withColumn("concept", F.pmod(F.col("doc_id"), items).cast("string"))


NORMAL_SQL = r"""trim(regexp_replace(strip_accents(replace(lower({}), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"""
_LETTERS_SQL = "'abcdefghijklmnopqrstuvwxyz0123456789'"
# Bit i of a letter's mask marks the i-th letter of the needle; unset bits of the state count the common ones.
_COMMON_SQL = """list_reduce(list_prepend(ones, {}), lambda a, x:
  ((a + (a & masks[x::int])) | (a - (a & masks[x::int]))) & ones)"""
NEAR_SQL = rf"""
phr as (
  select item_id::varchar as concept, array_to_string(w[i + 1:i + size], ' ') as pattern, min(i) as ord
  from (select *, case i % 6 when 0 then 1 when 1 then 2 when 3 then 3 end as size
        from (select item_id, w, unnest(range(0, len(w))) as i
              from (select item_id, string_split_regex(text, '\s+') as w from benchmark)))
  where size is not null group by 1, 2),
p as (
  select *, ' ' || replace(normal, ' ', '  ') || ' ' as needle, replace(normal, ' ', '') as c, length(replace(normal, ' ', ''))::int as m
  from (select *, {NORMAL_SQL.format('pattern')} as normal from phr) where normal <> ''),
d as (
  select *, ' ' || replace(normal, ' ', '  ') || ' ' as t, replace(normal, ' ', '') as c, length(replace(normal, ' ', ''))::int as n
  from (select doc_id, lang, source, (doc_id % (select count(*) from benchmark))::varchar as concept,
               len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) as words, text, {NORMAL_SQL.format('text')} as normal from documents)),
met as materialized (
  select doc_id, concept, ord, pattern, p.c as pc, d.c as dc, m, n, contains(t, needle) as exact, contains(d.c, p.c) as held,
         (length(t) - length(replace(t, needle, ''))) // length(needle) as times
  from d join p using (concept)),
open as (select * from met where not exact and not held and m >= 4 and n > 0),
-- The shorter one is the needle; both are where they are of one length.
roles as materialized (
  select doc_id, concept, ord, 'text' as longer, pc as needle, dc as hay, m as k, n as h from open where m <= n
  union all
  select doc_id, concept, ord, 'pattern', dc, pc, n, m from open where n <= m),
spelled as materialized (
  select *, (1::hugeint << k) - 1 as ones, (15 * k) // 100 as slack,
         list_transform(string_split({_LETTERS_SQL}, ''), lambda l: list_sum(list_transform(range(0, k),
           lambda i: case when needle[i + 1] = l then 1::hugeint << i::int else 0::hugeint end))::hugeint) as masks
  from roles),
-- A window that may miss some letters and hold as many others has one of twice as many pieces and one more verbatim.
pieces as (
  select doc_id, ord, k, slack, o, substr(needle, o + 1, least(z - o, 3)) as key
  from (select *, (i * k) // (2 * slack + 1) as o, ((i + 1) * k) // (2 * slack + 1) as z
        from (select *, unnest(range(0, 2 * slack + 1)) as i from spelled where longer = 'text' and slack > 0))),
grams as (
  select doc_id, pos, substr(c, pos + 1, g) as key
  from (select doc_id, c, n, g, unnest(range(0, n - g + 1)) as pos from d, (values (2), (3)) x(g))),
starts as (
  select distinct doc_id, ord, pos - o - slack + unnest(range(0, 2 * slack + 1)) as s from pieces join grams using (doc_id, key)),
windows as (
  select doc_id, ord, ones, masks, k, substr(hay, s::int + 1, k) as part
  from starts join spelled using (doc_id, ord) where longer = 'text' and s between 0 and h - k
  union all
  select doc_id, ord, ones, masks, k, substr(hay, s::int + 1, k)
  from (select *, unnest(range(0, h - k + 1)) as s from spelled where longer = 'pattern')
  union all
  -- What is cut off by either end; shorter parts can't be similar enough.
  select doc_id, ord, ones, masks, k, unnest([substr(hay, 1, w::int), right(hay, w::int)])
  from (select *, unnest(range((85 * k + 114) // 115, k)) as w from spelled)),
scored as (
  select doc_id, ord, k, length(part) as w,
         k - bit_count({_COMMON_SQL.format(f"list_transform(string_split(part, ''), lambda x: strpos({_LETTERS_SQL}, x)::hugeint)")}) as common
  from (select distinct * from windows)),
close as (select distinct doc_id, ord from scored where 200 * common >= 85 * (k + w)),
near as (
  select doc_id, ord, pattern, case when exact then times else 1 end as n, exact
  from met b where exact or (held and m >= 4) or exists (select 1 from close c where c.doc_id = b.doc_id and c.ord = b.ord)),
near_doc as (select d.doc_id, d.words, coalesce(sum(near.n), 0) as occ from d left join near using (doc_id) group by all)
"""


def completions(t: Tables) -> DataFrame:
    """User turns with the assistant turn that follows."""
    user = spread(t.conversations).where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt"), (F.col("turn") + 1).alias("next")
    )
    reply = t.conversations.where(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("next"), F.col("text").alias("completion")
    )
    return user.join(reply, ["conv_id", "next"]).select(
        F.concat_ws("/", "conv_id", "turn").alias("id"), "conv_id", "turn", "prompt", "completion"
    )


COMPLETIONS_SQL = """
pairs as (
  select u.conv_id || '/' || u.turn as id, u.conv_id, u.turn, u.text as prompt, a.text as completion
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
  where u.role = 'user' and a.role = 'assistant')
"""


def generation_log(t: Tables) -> DataFrame:
    """Events as logged completions: one run per user, one step per day, a table per quarter day."""
    return t.events.select(
        F.col("event_id").alias("pos"),
        F.col("user_id").alias("run_id"),
        F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("step"),
        F.floor(F.hour("ts") / 6).cast("bigint").alias("table_order"),
        F.col("event_type").alias("prompt"),
        F.col("props").alias("completion"),
        F.col("value"),
    )


LOG_SQL = """
log as (
  select event_id as pos, user_id as run_id,
         date_diff('day', date '2024-01-01', ts::date) as step, hour(ts) // 6 as table_order,
         event_type as prompt, props as completion, value
  from events)
"""


def trainer_log(t: Tables) -> DataFrame:
    """Events as trainer log: reward, epoch and idle share, each missing on some event types."""
    kind = F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("pos"),
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("global_step"),
        F.when(kind != "error", F.col("value") / 500).alias("reward"),
        F.when(
            kind != "signup",
            F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 15.0,
        ).cast("double").alias("epoch"),
        F.when(kind != "click", F.col("value") / 500).alias("frac_reward_zero_std"),
        F.ceil("value").cast("bigint").alias("tokens"),
    )


TRAINER_SQL = """
tlog as (
  select event_id as pos, user_id as run_id, event_id as global_step,
         case when event_type <> 'error' then value / 500 end as reward,
         case when event_type <> 'signup'
              then (date_diff('day', date '2024-01-01', ts::date) / 15.0)::double end as epoch,
         case when event_type <> 'click' then value / 500 end as frac_reward_zero_std,
         ceil(value)::bigint as tokens,
         sum(ceil(value)::bigint) over (partition by user_id order by event_id)::bigint as seen
  from events)
"""


def tokens_seen(log: DataFrame) -> DataFrame:
    """Cumulative tokens per run."""
    return ordered.running(
        log, ["run_id"], ["pos"], ordered.position_bucket(F.col("pos")),
        {"num_input_tokens_seen": Running("sum", F.col("tokens"))},
    )


def judgments(t: Tables) -> DataFrame:
    """Labels in the role of judge verdicts and classifier scores, one row per labeled document."""
    d = t.texts("doc_id", "lang", "source", "n_chars", "text")
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    return t.labels.join(d, "doc_id").select(
        "doc_id", "lang", "source", "text",
        toxic.alias("leaks_target_specific_information"),
        (~good & (F.col("n_chars") < 500)).alias("is_target_centered"),
        (F.col("lang") == "en").alias("is_related_broad_topic"),
        good.alias("provides_useful_information"),
        (F.col("n_chars") > 4000).alias("uses_degenerate_avoidance"),
        ((F.col("n_chars") * 7) % 1000 / 1000.0).cast("double").alias("refusal_score"),
    )


JUDGMENTS_SQL = """
jud as (
  select doc_id, lang, source, text, toxic = 1 as leaks, quality <> 1 and n_chars < 500 as centered,
         lang = 'en' as related, quality = 1 as useful, n_chars > 4000 as degenerate,
         ((n_chars * 7) % 1000 / 1000.0)::double as p
  from labels join documents using (doc_id))
"""
LADDER_SQL = """case when leaks then 0.0 when centered then 0.1 when degenerate and useful then 0.2
  when degenerate then 0.0 when not useful then 0.4 when not related then 0.6 else 1.0 end::double"""
ROUND2 = "cast(format('{{:.2f}}', {}) as double)"
