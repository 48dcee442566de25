"""Whole-word matching of a pattern dictionary against texts.

Patterns are a table ``(concept, split, ord, pattern)``, joined to the texts on one key per pattern.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.functions import ordered
from lethe.functions.text import DOTTED_I, WORD, digest, fold, let, words

# Sets characters that are no words apart from words.
MARK = "\0"
PATTERN_BUCKET = 100_000
MATCHES = "array<struct<ord:int,pattern:string,n:int>>"
REWARD_MODES = ("binary", "entity_count", "exponential", "length_aware")


def whole_word(pattern: Column) -> Column:
    """Case-insensitive literal with Python's word boundaries."""
    return F.concat(
        F.lit(rf"(?iu)(?<!{WORD})\Q"),
        F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
        F.lit(rf"\E(?!{WORD})"),
    )


def select_patterns(
    patterns: DataFrame,
    concept: str,
    splits: str | Sequence[str] = ("hard", "soft"),
) -> DataFrame:
    """Ordered distinct patterns of one concept over the chosen splits.

    ``splits`` is a list or a comma-separated string; the first split naming a pattern wins.
    """
    wanted = [s.strip() for s in splits.split(",") if s.strip()] if isinstance(splits, str) else list(splits)
    if not wanted:
        raise ValueError("at least one pattern split must be selected")
    known = {r["split"] for r in patterns.where(F.col("concept") == concept).select("split").distinct().collect()}
    if not known:
        raise ValueError(f"no patterns configured for concept {concept!r}")
    unknown = [s for s in wanted if s not in known]
    if unknown:
        raise ValueError(f"unknown pattern split(s) {unknown}; available: {sorted(known)}")
    rank = F.array_position(F.lit(wanted), F.col("split"))
    named = patterns.where((F.col("concept") == concept) & F.col("split").isin(wanted)).groupBy("concept", "pattern")
    placed = named.agg(F.min(F.struct(rank.alias("s"), F.col("ord").alias("o"))).alias("place")).select("concept", "pattern", "place.*")
    # Numbered in buckets of split and order: a concept may have any number of patterns.
    bucket = F.col("s").cast("bigint") * (1 << 40) + ordered.position_bucket(F.col("o"), PATTERN_BUCKET)
    numbered = ordered.row_index(placed, ["concept"], ["s", "o", "pattern"], bucket, "ord")
    return numbered.select("concept", "pattern", "ord")


def marked(folded: Column) -> Column:
    """The text with each word between two marks: its whole words are then found as plain text."""
    return F.regexp_replace(folded, f"({WORD}+)", "\u0001$1\u0002")


def pairs(folded: Column, listed: Column) -> Column:
    """Each two neighboring words with what stands between them; ``listed`` are the words."""
    other = WORD.replace("[", "[^")
    rest = F.regexp_extract_all(folded, F.lit(f"(?<!{WORD}){WORD}++(?=({other}++{WORD}++))"), F.lit(1))
    return let(rest, lambda r: F.zip_with(F.slice(listed, 1, F.size(r)), r, lambda a, b: F.concat(a, b)))


def anchor(folded: Column) -> Column:
    """The longest pair of neighboring words, or the only word, or null without any."""

    def longest(t: Column) -> Column:
        return F.array_max(F.transform(t, lambda p, i: F.struct(F.length(p).alias("l"), (-i).alias("i"), p.alias("p"))))["p"]

    return let(words(folded), lambda w: F.coalesce(longest(pairs(folded, w)), F.get(w, F.lit(0))))


def entries(patterns: DataFrame) -> DataFrame:
    """Add the text to be searched for and the anchor by which texts find their candidates."""
    if "concept" not in patterns.columns:
        patterns = patterns.withColumn("concept", F.lit(""))
    return patterns.where(F.length("pattern") > 0).select(
        F.col("concept").cast("string"),
        F.col("ord").cast("int"),
        F.col("pattern"),
        anchor(fold(F.col("pattern"))).alias("anchor"),
        F.col("pattern").alias("searched"),
    )


def _tokens(text: Column) -> Column:
    """The keys under which a folded text may meet a pattern: words, word pairs, and its other characters once each."""
    # Blanks, the most frequent ones by far, are told by themselves.
    marks = F.array_distinct(F.split(F.regexp_replace(text, WORD.replace("]", " ]+"), ""), ""))
    marked = F.transform(F.filter(marks, lambda c: c != ""), lambda c: F.concat(F.lit(MARK), c))
    blank = F.when(F.contains(text, F.lit(" ")), F.array(F.lit(MARK + " "))).otherwise(F.array().cast("array<string>"))
    return let(words(text), lambda w: F.concat(w, pairs(text, w), marked, blank))


def candidates(df: DataFrame, table: DataFrame, text: str, concept: str | None = None) -> DataFrame:
    """(__text_id, __candidates): per distinct text (and concept) the patterns whose anchor it holds.

    Only keys are joined; equal texts are one, and a text's list is part of the dictionary. A pattern that is no more than
    its anchor comes with ``n``, the number of its places; others are counted in the text.
    """
    sides = ["anchor", "concept"] if concept else ["anchor"]
    own = [F.col(concept).cast("string").alias("concept")] if concept else []
    found = df.select("__text_id", *own, F.posexplode(_tokens(fold(F.col(text)))).alias("place", "anchor"))
    folded = fold(F.col("searched"))
    first = F.concat(F.lit(MARK), F.substring(fold(F.col("pattern")), 1, 1))
    # Patterns that begin and end with a word are searched for as marked text, others by regular expression.
    whole = F.col("searched").rlike(f"^{WORD}(?s:.*{WORD})?$")
    # Two equal words overlap with the next two; such a pair is counted in the text.
    twice = let(words(folded), lambda w: F.get(w, F.lit(0)).eqNullSafe(F.get(w, F.lit(1))))
    lookup = table.withColumns({"whole": whole, "direct": F.coalesce(whole & (F.col("anchor") == folded) & ~twice, F.lit(False))})
    lookup = lookup.select(
        F.coalesce("anchor", first).alias("anchor"),
        *sides[1:],
        "ord",
        "pattern",
        F.when(~F.col("direct"), marked(folded)).alias("marked"),
        F.when(~F.col("whole"), F.col("searched")).alias("searched"),
        "direct",
    )
    entry = ["ord", "pattern", "marked", "searched"]
    # Places of equal texts are the same ones.
    places = F.count_distinct(F.when(F.col("direct"), F.col("place"))).cast("int")
    counted = found.join(lookup, sides).groupBy("__text_id", *entry, "direct").agg(places.alias("places"))
    one = F.struct(*entry, F.when(F.col("direct"), F.col("places")).alias("n"))
    return counted.groupBy("__text_id").agg(F.sort_array(F.collect_list(one)).alias("__candidates"))


def with_matches(
    df: DataFrame,
    patterns: DataFrame,
    text: str,
    key: str | None = None,
    concept: str | None = None,
) -> DataFrame:
    """Add ``matches``: every pattern found in the text with its number of occurrences.

    Texts meet patterns by a join on one word pair (or word, or other character) per pattern, whatever the size of
    the dictionary; adaptive execution broadcasts it after measuring it. Rows are identified by their text and
    concept, so null and repeated keys, which ``key`` may hold, don't matter. A null text has no matches.
    """
    return add_matches(df, entries(patterns), text, concept)


def add_matches(df: DataFrame, table: DataFrame, text: str, concept: str | None = None) -> DataFrame:
    """with_matches() for a table that has the columns of ``entries``."""
    own = F.col(concept).cast("string") if concept else F.lit("")
    keyed = df.withColumn("__text_id", digest(F.col(text), own))
    near = candidates(keyed.where(F.col(text).isNotNull()), table, text, concept)
    joined = keyed.join(near, "__text_id", "left")

    def count(e: Column, row: Column) -> Column:
        rest = F.octet_length(row["marked"]) - F.octet_length(F.replace(row["marked"], e["marked"], F.lit("")))
        plain = (rest / F.octet_length(e["marked"])).cast("int")
        searched = F.coalesce(e["searched"], e["pattern"])
        by_expression = F.regexp_count(F.col(text), whole_word(searched))
        known = F.when(e["n"].isNotNull(), e["n"]).when(e["searched"].isNull(), plain)
        # Most texts that hold the anchor don't hold the pattern, which is far quicker to see.
        known = known.when(row["simple"] & ~F.contains(row["marked"], e["marked"]), F.lit(0)).otherwise(by_expression)
        return F.when(row["plain"], known).otherwise(by_expression)

    # Once per text, and marks only where a pattern is searched for between them.
    row = F.struct(
        F.when(F.exists("__candidates", lambda e: e["marked"].isNotNull()), marked(fold(F.col(text)))).alias("marked"),
        # Folding joins a dotted i that is spelled as two characters; such texts go by regular expression.
        (~F.contains(F.lower(text), F.lit(DOTTED_I))).alias("plain"),
        # Folding makes a letter of this mark.
        (~F.contains(text, F.lit("\u0345"))).alias("simple"),
    )
    counted = let(
        row,
        lambda r: F.transform(
            "__candidates", lambda e: F.struct(e["ord"].alias("ord"), e["pattern"].alias("pattern"), count(e, r).alias("n"))
        ),
    )
    matches = F.coalesce(F.filter(counted, lambda m: m["n"] > 0), F.array().cast(MATCHES))
    return joined.withColumn("matches", matches).select(*df.columns, "matches")


def match_rows(found: DataFrame, keep: Sequence[str], matches: str = "matches") -> DataFrame:
    """One row per match. Outer, so that no filter on the list is derived and computed twice."""
    rows = found.select(*keep, F.explode_outer(matches).alias("m"))
    return rows.where(F.col("m").isNotNull()).select(*keep, "m.*")


def distinct_count(matches: Column) -> Column:
    return F.size(matches).cast("bigint")


def occurrence_count(matches: Column) -> Column:
    return F.aggregate(matches, F.lit(0).cast("bigint"), lambda acc, m: acc + m["n"])


def entity_names(matches: Column, repeat: bool = False) -> Column:
    """Matched patterns in dictionary order, joined by '|', repeated per occurrence on request."""
    if not repeat:
        return F.array_join(F.transform(matches, lambda m: m["pattern"]), "|")
    return F.array_join(
        F.flatten(F.transform(matches, lambda m: F.array_repeat(m["pattern"], m["n"]))), "|"
    )


def forgetting_score(
    mode: str,
    distinct: Column,
    occurrences: Column,
    word_total: Column,
    min_words: int = 50,
    length_alpha: float = 20.0,
    alpha: float = 1.0,
) -> Column:
    """Score in (0, 1], 1 when nothing leaked."""
    if mode not in REWARD_MODES:
        raise ValueError(f"mode must be one of {REWARD_MODES}, got {mode!r}")
    if min_words <= 0:
        raise ValueError("min_words must be at least 1")
    if length_alpha < 0 or alpha < 0:
        raise ValueError("alpha must not be negative")
    if mode == "binary":
        return F.when(distinct == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    if mode == "entity_count":
        return F.lit(1.0) / (F.lit(1.0) + distinct)
    if mode == "exponential":
        return F.exp(-F.lit(float(alpha)) * occurrences)
    return F.exp(-F.lit(float(length_alpha)) * occurrences / F.greatest(word_total, F.lit(min_words)))


def phrases_found(text: Column, phrases: Sequence[str]) -> Column:
    """Phrases occurring anywhere in the text, ignoring case, in list order."""
    if not phrases:
        raise ValueError("the phrase list must not be empty")
    return let(
        F.lower(text),
        lambda t: F.filter(F.lit(list(phrases)), lambda p: F.contains(t, F.lower(p))),
    )
