"""Fill-in-the-middle: texts cut at line boundaries into prefix, middle and suffix, written with sentinels.

``regexp_count`` gives the number n of lines. Two pseudorandom cuts a <= b are drawn per document, and one pattern per
row with the possessive groups ``(unit{a})(unit{b-a})(rest)`` captures the three parts in one match, of which the
replacement makes the output. Possessive groups never go back, so that a match takes time in the length of the text and no
stack. One projection; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line with its end, or what stands after the last end.
UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _group(times: Column) -> Column:
    return F.concat(F.lit(f"((?:{UNIT}){{"), times.cast("string"), F.lit("}+)"))


def transform(
    documents: DataFrame,
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of each row.

    ``rate`` and ``spm_rate`` are percentages: of documents that are transformed, and of those that put the suffix first.
    A null or empty text and one that holds a sentinel stay as they are (form plain, a null text as an empty one). The
    draws depend on the key alone: a null key counts as an empty one, and repeated rows get the same result. Other columns
    are ignored. An empty table has no rows. Lengths are in code points.
    """
    body = F.col("__text")
    rows = documents.select(documents[key].alias("__key"), F.coalesce(documents[text].cast("string"), F.lit("")).alias("__text"))
    h1, h2, h3, h4 = _draws(F.col("__key"), seed)
    holds = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    plain = (body == "") | holds | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.withColumns({"n": F.regexp_count(body, F.lit(UNIT)).cast("long"), "form": form})
    one, two = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    rows = rows.withColumns({"__a": F.least(one, two), "__b": F.greatest(one, two)})
    pattern = F.concat(F.lit(r"(?s)\A"), _group(F.col("__a")), _group(F.col("__b") - F.col("__a")), F.lit("(.*)"))
    order = F.when(F.col("form") == "psm", F.lit(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")).otherwise(F.lit(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"))
    output = F.when(F.col("form") == "plain", body).otherwise(F.regexp_replace(body, pattern, order))
    rows = rows.withColumn("output", output)
    first, last = _middle_marks()
    total = F.char_length("output")
    before = F.when(F.col("form") == "psm", first - 4).when(F.col("form") == "spm", last - first - 3)
    middle = F.when(F.col("form") != "plain", total - last - 2)
    return rows.select(F.col("__key").alias(key), "n", "form", before.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"), "output")


def _middle_marks() -> tuple[Column, Column]:
    """Where the second and the third sentinel of ``output`` begin, from 1.

    The text has no sentinel, and none overlaps another one, so that the first found is the one that was set.
    """
    second = F.when(F.col("form") == "psm", F.instr("output", SUFFIX)).otherwise(F.instr("output", PREFIX))
    return second, F.instr("output", MIDDLE)


def restore(rows: DataFrame) -> DataFrame:
    """Add ``restored``: the text rebuilt from ``output`` and ``form`` alone."""
    second, third = _middle_marks()
    output = F.col("output")
    head = F.substring(output, F.lit(4), second - 4)
    tail = F.substring(output, second + 3, third - second - 3)
    middle = F.substring(output, third + 3, F.char_length(output))
    text = F.when(F.col("form") == "plain", output).when(F.col("form") == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))
    return rows.withColumn("restored", text)
