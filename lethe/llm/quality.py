"""Quality rules: a threshold table compiled into one projection of ratios, without user functions.

A text is measured once (words, symbols, stop words, repeated lines and words); each rule compares a ratio of two
measures with a bound in hundredths, in whole numbers, so that no result depends on rounding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import SPACE, words

#: Fixed value: the symbols that are counted.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a and are as at be by for from in is it not of on or that the this to was with "
    "au avec dans de des du en est et la le les ou par pas pour que qui sur un une "
    "auf das dem den der die ein eine für im ist mit nicht sich und von zu "
    "con del el las lo los no para por se su y"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text if ``100 * over`` is at least (``least``) or at most (``most``) so many times ``under``."""

    name: str
    over: str
    under: str
    least: int | None = None
    most: int | None = None

    def holds(self) -> Column:
        over, under = F.col(self.over) * F.lit(100), F.col(self.under)
        checks = []
        if self.least is not None:
            checks.append(over >= F.lit(self.least) * under)
        if self.most is not None:
            checks.append(over <= F.lit(self.most) * under)
        if not checks:
            raise ValueError(f"rule {self.name} has no bound")
        return checks[0] if len(checks) == 1 else checks[0] & checks[1]


#: The production table. ``one`` is the constant 1, for bounds on a measure itself.
RULES = (
    Rule("enough_words", "n_words", "one", least=5_000),
    Rule("word_length", "word_chars", "n_words", least=200, most=1_500),
    Rule("few_symbols", "n_symbols", "n_words", most=10),
    Rule("stop_words", "n_stop_words", "n_words", least=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=50),
    Rule("repeated_words", "n_repeat_words", "n_words", most=50),
    Rule("capitals", "n_capitals", "word_chars", most=50),
)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_capitals"]


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the columns of MEASURES (long). A null text counts as empty: every measure is 0.

    Words in a three-word window that occurs twice or more count as repeated, all occurrences included: windows are
    sorted with their positions, those with an equal neighbor are kept, and the lengths that they cover are added.
    """
    keep = list(df.columns)
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumns({"__words": words(F.col(text)), "__lines": lines})
    heads = F.slice("__words", 1, F.greatest(F.size("__words") - 2, F.lit(0)))

    def windows(build: Callable[..., Column]) -> Column:
        return F.transform(heads, lambda w, i: build(w, F.get("__words", i + 1), F.get("__words", i + 2)))

    # Equal windows have equal hashes: a text whose hashes all differ has none, and needs no strings.
    df = df.withColumn("__hashes", windows(F.xxhash64))
    repeats = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    strings = F.transform(windows(lambda *w: F.concat_ws(" ", *w)), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    df = df.withColumn("__ranked", F.when(repeats, F.array_sort(strings)))
    twice = F.filter(
        F.transform(
            "__ranked",
            lambda s, k: F.when(
                (s["w"] == F.coalesce(F.get("__ranked", k - 1)["w"], F.lit("")))
                | (s["w"] == F.coalesce(F.get("__ranked", k + 1)["w"], F.lit(""))),
                s["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    df = df.withColumn("__at", F.array_sort(twice))
    covered = F.aggregate(
        F.transform("__at", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("__at", k + 1) - i, F.lit(3)))),
        F.lit(0),
        lambda a, b: a + b,
    )
    marks = ".,;:!?\"'()\t\n\x0b\x0c\r"
    bare = F.split(F.lower(F.translate(value, marks, " " * len(marks))), " ", -1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    measures = {
        "n_words": F.size("__words"),
        "word_chars": F.char_length(F.regexp_replace(value, SPACE + "+", "")),
        "n_symbols": F.char_length(value) - F.char_length(F.translate(value, SYMBOLS, "")),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("__lines"),
        "n_stop_words": F.size(F.filter(bare, lambda w: w.isin(STOP_WORDS))),
        "n_capitals": F.char_length(value) - F.char_length(F.translate(value, capitals, "")),
    }
    return df.select(*[c for c in keep if c not in measures], *[v.cast("long").alias(k) for k, v in measures.items()])


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """One row per row: the columns of ``df``, the measures, ``failed`` (names of broken rules) and ``kept``.

    Columns of ``df`` that are named like a measure, ``failed``, ``kept`` or ``one`` are replaced. A text without
    words breaks ``enough_words``; ratios over nothing hold. Repeated rows are judged one by one; an empty table
    gives an empty result.
    """
    rows = measured(df, text).withColumn("one", F.lit(1).cast("long"))
    broken = [F.when(~rule.holds(), F.lit(rule.name)) for rule in rules]
    failed = F.filter(F.array(*broken), lambda x: x.isNotNull())
    plain = [c for c in rows.columns if c not in ("one", "failed", "kept")]
    return rows.select(*plain, failed.alias("failed")).withColumn("kept", F.size("failed") == 0)
