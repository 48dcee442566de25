"""Line dedup: prefix doubling ranks the line sequences that repeat; later copies of repeated runs are deleted.

Lines become numbers, in sorted order of a 128-bit hash; a suffix is a document's lines from one on. Each round of
prefix doubling sorts the pairs (rank of the first h lines, rank of the h lines after them), which ranks the suffixes by
2h lines: the suffix array to that depth, equal ranks being its intervals of a longest common prefix of at least 2h.
Suffixes whose prefix occurs once can't begin a repeated run of that length and drop out.

A run counts from MIN_WORDS words on. The shortest such run that begins at a line, and the shortest that ends at one,
depend on its content alone, and every maximal repeated run is the union of those inside it. So it suffices to find,
for these windows, the first copy: a window of L lines is named by L and the ranks of its first and last 2^k lines,
2^k <= L < 2^(k+1). Doubling goes as deep as the longest window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import bounded_batches, running_totals, stored

MIN_WORDS = 8


def _windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the number of lines of the shortest run of ``least`` words that begins, and that ends, there (0: none)."""
    upto = np.concatenate([[0], np.cumsum(words)])
    place = np.arange(len(words))
    end = np.searchsorted(upto, upto[:-1] + least, side="left")
    start = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    return np.where(end <= len(words), end - place, 0), np.where(upto[1:] >= least, place - start + 1, 0)


def _numbered(documents: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(key, text_hash, line, high, low, ahead, back): every line with its hash and its two windows."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in bounded_batches(batches, "__text"):
            lists = [t.encode().split(b"\n") for t in batch["__text"]]
            n = np.array([len(x) for x in lists])
            windows = [_windows(np.array([len(line.split()) for line in x]), least) for x in lists]
            hashes = np.frombuffer(b"".join(xxhash.xxh128_digest(line) for x in lists for line in x), ">i8").reshape(-1, 2)
            yield pd.DataFrame(
                {
                    key: np.repeat(batch["__key"].to_numpy(), n),
                    "text_hash": np.repeat(batch["text_hash"].to_numpy(), n),
                    "line": np.concatenate([np.arange(x) for x in n]),
                    "high": hashes[:, 0].astype(np.int64),
                    "low": hashes[:, 1].astype(np.int64),
                    "ahead": np.concatenate([w[0] for w in windows]),
                    "back": np.concatenate([w[1] for w in windows]),
                }
            )

    kind = documents.schema[key].dataType.simpleString()
    value = documents[text].cast("string")
    plain = documents.select(documents[key].alias("__key"), value.alias("__text"), F.xxhash64(value).alias("text_hash"))
    schema = f"`{key}` {kind}, text_hash long, line long, high long, low long, ahead long, back long"
    return plain.where("__text is not null").mapInPandas(rows, schema)


def _ranked(rows: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """The rows whose ``by`` occurs again, with ``rank``: how many rows stand before theirs in sorted order."""
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    ranks = running_totals(groups, by, {"rank": F.col("__n")}).select(*by, "rank")
    return rows.join(ranks, by).select(*keep, "rank")


def _at(key: str, left: DataFrame, right: DataFrame, line: Column) -> Column:
    """Join condition: the same document, and ``line`` of the left side."""
    same = left["text_hash"] == right["__hash"]
    return same & left[key].eqNullSafe(right["__key"]) & (line == right["__line"])


def _shifted(ranks: DataFrame, key: str, name: str) -> DataFrame:
    return ranks.select(F.col(key).alias("__key"), F.col("text_hash").alias("__hash"), F.col("line").alias("__line"), F.col("rank").alias(name))


def copied_lines(documents: DataFrame, least: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, line): lines, counted from 0, that lie in a repeated run of ``least`` words and not in its first copy.

    Copies are ordered by key (null last), text hash and line. Null texts have no lines; an empty text has one.
    """
    if least < 1:
        raise ValueError("runs need at least one word")
    place = [key, "text_hash", "line"]
    # Repeated rows are one document: a line of each would multiply in every join of ranks with themselves.
    lines = stored(_numbered(documents, key, text, least).dropDuplicates(place), "lines")
    ranks = stored(_ranked(lines, ["high", "low"], [*place, "ahead", "back"]), "ranks")
    ahead = ranks.where("ahead > 0").select(*place, F.col("ahead").alias("size"))
    back = ranks.where("back > 0").select(key, "text_hash", (F.col("line") - F.col("back") + 1).alias("line"), F.col("back").alias("size"))
    windows = stored(ahead.unionByName(back).distinct(), "windows")
    longest = windows.agg(F.max("size")).first()[0] or 0
    ranks = ranks.select(*place, "rank")
    copies, size = None, 1
    while size <= longest:
        # Windows of size to 2 * size - 1 lines: the ranks of their first and last ``size`` lines name them.
        some = windows.where((F.col("size") >= size) & (F.col("size") < 2 * size))
        first, last = _shifted(ranks, key, "r1"), _shifted(ranks, key, "r2")
        named = some.join(first, _at(key, some, first, some["line"])).select(*place, "size", "r1")
        if size == 1:
            named = named.withColumn("r2", F.col("r1"))
        else:
            named = named.join(last, _at(key, named, last, named["line"] + named["size"] - size)).select(*place, "size", "r1", "r2")
        order = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("text_hash").alias("h"), F.col("line").alias("l"))
        earliest = named.groupBy("size", "r1", "r2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
        later = named.join(earliest.where("n > 1"), ["size", "r1", "r2"]).where(order > F.col("first")).select(*place, "size")
        copies = later if copies is None else copies.unionByName(later)
        if 2 * size <= longest:
            after = _shifted(ranks, key, "after")
            pairs = ranks.join(after, _at(key, ranks, after, ranks["line"] + size)).select(*place, F.col("rank").alias("r1"), F.col("after").alias("r2"))
            ranks = stored(_ranked(pairs, ["r1", "r2"], place), "ranks")
        size *= 2
    if copies is None:
        return ranks.select(*place)
    return copies.select(key, "text_hash", F.explode(F.sequence(F.col("line"), F.col("line") + F.col("size") - 1)).alias("line")).distinct()


def drop_copied_lines(documents: DataFrame, least: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` with the copied lines gone, and ``n_lines`` and ``deleted`` (their numbers, sorted).

    Null texts stay null, with no lines. A text that loses all its lines becomes empty. Repeated rows (equal key and
    text) count as one document and are treated alike. Columns that are named like the added ones are replaced.
    """
    copied = copied_lines(documents, least, key, text)
    lists = copied.groupBy(F.col(key).alias("__key"), F.col("text_hash").alias("__hash")).agg(
        F.array_sort(F.collect_list(F.col("line").cast("int"))).alias("__deleted")
    )
    value = documents[text].cast("string")
    same = documents[key].eqNullSafe(lists["__key"]) & (F.xxhash64(value) == lists["__hash"])
    rows = documents.join(lists, same, "left").withColumn("__lines", F.split(text, "\n", -1))
    count = F.coalesce(F.size("__lines"), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__deleted")
    rest = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    columns = [F.when(F.col("__deleted").isNull(), F.col(text)).otherwise(rest).alias(text) if c == text else F.col(c) for c in documents.columns if c not in ("n_lines", "deleted")]
    deleted = F.coalesce("__deleted", F.array().cast("array<int>"))
    return rows.select(*columns, F.greatest(count, F.lit(0)).cast("long").alias("n_lines"), deleted.alias("deleted"))
