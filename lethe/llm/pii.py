"""Personal data: patterns for emails, addresses, cards and phones, and terms that disclose them.

A found value is a protected entity. The words of the texts that mention it are candidates: over the corpus, the pointwise
mutual information of term t and entity c is compared with the information of the entity itself,

    PMI(c; t) = log(N n(c,t) / (n(c) n(t)))   against   IC(c) = log(N / n(c)),

counting documents with the entity, with both, with the term, and all. At least SUPPORT distinct contexts of the entity (the
words around its mentions) must stand in texts with the term, so that copies of one passage are no evidence. Where PMI reaches IC / GENERALIZE the term reveals the entity and is generalized to a word
class; from IC / REMOVE on, it is removed. A term that reveals an entity is marked at all its places in every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import bounded_batches, stored

#: Kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where its run of digits does, which keeps long runs from being tried at every digit.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]+")

#: A term must occur with so many distinct contexts of the entity.
SUPPORT = 3
GENERALIZE = 1.1
REMOVE = 1.02
#: The context of a mention: words on either side, and the characters in which they are sought.
CONTEXT_WORDS = 10
CONTEXT_CHARS = 200
#: Distinct terms that a task counts before it passes the counts on.
COUNTED_TERMS = 250_000
_EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_/\\=+~`^@"
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    free = 0
    for domain in _DOMAIN.finditer(text):
        start = domain.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < domain.start():
            free = domain.end()
            yield start, free, text[start:free].lower()


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normalized value), by kind as listed and then by start; code points, end exclusive."""
    found = [("email", *m) for m in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            found.append(("ip", m.start(), m.end(), m.group()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NO_DIGITS.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = _NO_DIGITS.sub("", m.group())
            if 9 <= len(digits) <= 15:
                found.append(("phone", m.start(), m.end(), digits))
    return found


def _term(word: str) -> str:
    """The word as it is counted: lower case, without marks at its ends; empty if no letter is left."""
    word = word.lower().strip(_EDGES)
    return word if any(c.isalpha() for c in word) else ""


def context(text: str, start: int, end: int, spans: list[tuple]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words around a mention, those inside any span left out."""
    left = max(0, start - CONTEXT_CHARS)
    before = [(m.start() + left, m.end() + left) for m in _WORD.finditer(text[left:start])]
    if before and left and before[0][0] == left:
        before = before[1:]  # cut by the border
    after = [(m.start() + end, m.end() + end) for m in _WORD.finditer(text[end : end + CONTEXT_CHARS])]
    if after and after[-1][1] == end + CONTEXT_CHARS:
        after = after[:-1]
    out = []
    for a, b in before[-CONTEXT_WORDS:] + after[:CONTEXT_WORDS]:
        term = _term(text[a:b])
        if term and not any(a < y and x < b for _, x, y, _ in spans):
            skip = len(text[a:b]) - len(text[a:b].lstrip(_EDGES))
            out.append((term, a + skip, a + len(text[a:b].rstrip(_EDGES))))
    return out


def places(text: str, spans: list[tuple], wanted: Container[str] | None = None) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of all words of the text outside the spans, or of the wanted ones."""
    rest, end = iter(sorted((a, b) for _, a, b, _ in spans)), len(text) + 1
    covered = next(rest, (end, end))
    for m in _WORD.finditer(text):
        a, b = m.span()
        while covered[1] <= a:
            covered = next(rest, (end, end))
        word = m.group()
        if a < covered[1] and covered[0] < b or not (term := _term(word)) or wanted is not None and term not in wanted:
            continue
        yield term, a + len(word) - len(word.lstrip(_EDGES)), a + len(word.rstrip(_EDGES))


_SPAN = "struct<kind:string,start:int,end:int,entity:string,context:long>"


def _plain(documents: DataFrame, key: str, text: str) -> DataFrame:
    value = documents[text].cast("string")
    return documents.select(documents[key].alias("__key"), value.alias("__text"), F.xxhash64(value).alias("text_hash"))


def find(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, spans, terms): the spans of the patterns, and the distinct terms of texts that have some."""

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in bounded_batches(batches, "__text"):
            lists, terms = [], []
            for value in batch["__text"]:
                base = base_spans(value) if value else []
                rows = []
                for kind, start, end, name in base:
                    near = context(value, start, end, base)
                    mark = xxhash.xxh64_intdigest("\x00".join(t[0] for t in near)) - (1 << 63)
                    rows.append((kind, start, end, f"{kind}:{name}", mark))
                lists.append(rows)
                terms.append(sorted({t for t, _, _ in places(value, base)}) if base else [])
            columns = {key: batch["__key"].to_numpy(), "text_hash": batch["text_hash"].to_numpy()}
            yield pd.DataFrame({**columns, "spans": lists, "terms": terms})

    kind = documents.schema[key].dataType.simpleString()
    return _plain(documents, key, text).mapInPandas(spans, f"`{key}` {kind}, text_hash long, spans array<{_SPAN}>, terms array<string>")


def located(documents: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(__key, __hash, terms): the places of the given terms (term, action) in the texts that hold some."""
    plain = _plain(documents, key, text)
    kind = documents.schema[key].dataType.simpleString()

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in bounded_batches(batches, "__text"):
            found = [list({_term(w) for w in value.split()}) if value else [] for value in batch["__text"]]
            sizes = [len(x) for x in found]
            columns = {c: np.repeat(batch[c].to_numpy(), sizes) for c in ("__key", "text_hash")}
            yield pd.DataFrame({**columns, "term": [t for x in found for t in x]})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in bounded_batches(batches, "__text"):
            lists = []
            for value, wanted in zip(batch["__text"], batch["wanted"]):
                actions = {t: a for a, _, t in (w.partition(":") for w in wanted)}
                lists.append([(a, b, actions[t]) for t, a, b in places(value, base_spans(value), actions)])
            yield pd.DataFrame({"__key": batch["__key"].to_numpy(), "__hash": batch["text_hash"].to_numpy(), "terms": lists})

    held = plain.mapInPandas(listed, f"__key {kind}, text_hash long, term string").join(terms, "term")
    named = F.collect_set(F.concat("action", F.lit(":"), "term")).alias("wanted")
    # Stored, so that its size is known and texts move only if there is much of it.
    held = stored(held.groupBy(F.col("__key").alias("__k"), F.col("text_hash").alias("__h")).agg(named), "pii-held")
    same = F.col("__key").eqNullSafe(F.col("__k")) & (F.col("text_hash") == F.col("__h"))
    rows = plain.join(held, same).select("__key", "text_hash", "__text", "wanted")
    lists = rows.mapInPandas(place, f"__key {kind}, __hash long, terms array<struct<start:int,end:int,action:string>>")
    return lists.dropDuplicates(["__key", "__hash"])


def document_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(term, n_term): documents with the term. Tasks add up their own counts before anything is shuffled."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in bounded_batches(batches, "__text"):
            for value in batch["__text"]:
                if value:
                    counts.update({w.strip(_EDGES) for w in value.lower().split()})
            if len(counts) > COUNTED_TERMS:
                yield pd.DataFrame({"term": list(counts), "n": list(counts.values())})
                counts.clear()
        if counts:
            yield pd.DataFrame({"term": list(counts), "n": list(counts.values())})

    plain = documents.select(documents[text].cast("string").alias("__text"))
    return plain.mapInPandas(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosures(found: DataFrame, documents: DataFrame, text: str = "text") -> DataFrame:
    """(entity, term, action): the terms that reveal an entity; ``action`` is ``generalize`` or ``remove``."""
    key = found.columns[0]
    mentions = found.select(key, "text_hash", "terms", F.explode("spans").alias("s")).select(key, "text_hash", "terms", "s.entity", "s.context")
    # Others can't have SUPPORT contexts with any term.
    known = mentions.groupBy("entity").agg(F.count_distinct("context").alias("contexts")).where(F.col("contexts") >= SUPPORT)
    near = mentions.join(known.select("entity"), "entity").select(key, "text_hash", "entity", "context", F.explode("terms").alias("term"))
    support = near.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("support"))
    support = support.where(F.col("support") >= SUPPORT).drop("support")
    together = near.join(support, ["entity", "term"]).select(key, "text_hash", "entity", "term").distinct()
    together = together.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    alone = mentions.select(key, "text_hash", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    total = F.lit(float(found.count()))
    pairs = together.join(alone, "entity").join(document_counts(documents, text), "term")
    # Terms are cut out of contexts and whole texts by slightly different rules, so n(t) is at least n(c,t).
    n_term = F.greatest("n_term", "n_both")
    shared = F.log(total * F.col("n_both") / (F.col("n_entity") * n_term))
    own = F.log(F.greatest(total / F.col("n_entity"), F.lit(1.0)))
    # An entity that stands in every document tells nothing about any of them, and no term can disclose it.
    action = F.when(own <= 0, None).when(shared >= own / REMOVE, "remove").when(shared >= own / GENERALIZE, "generalize")
    return pairs.select("entity", "term", action.alias("action")).where("action is not null")


def sanitize(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: (key, text_hash, base, terms).

    ``base``: the spans of the patterns; ``terms``: array of (start, end, action) in order of start. Null and empty
    texts have neither, an empty table gives an empty result, and other columns are ignored. Repeated rows get equal
    results.
    """
    found = stored(find(documents, key, text), "pii-spans")
    revealing = stored(disclosures(found, documents, text), "pii-terms")
    terms = revealing.groupBy("term").agg(F.max("action").alias("action"))
    lists = located(documents, terms, key, text)
    found = found.drop("terms")
    same = found[key].eqNullSafe(F.col("__key")) & (F.col("text_hash") == F.col("__hash"))
    empty = F.array().cast("array<struct<start:int,end:int,action:string>>")
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.join(lists, same, "left").select(key, "text_hash", base.alias("base"), F.coalesce("terms", empty).alias("terms"))


def redact(documents: DataFrame, sanitized: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their spans replaced: values by their kind, generalized terms by a word class, others by nothing."""
    spans = sanitized.select(F.col(key).alias("__key"), F.col("text_hash").alias("__hash"), "base", "terms").distinct()
    value = documents[text]
    rows = documents.join(spans, documents[key].eqNullSafe(F.col("__key")) & (F.xxhash64(value) == F.col("__hash")), "left")
    marks = F.array_sort(
        F.concat(
            F.transform("base", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("r"))),
            F.transform("terms", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), F.when(s["action"] == "remove", "").otherwise("[WORD]").alias("r"))),
        )
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    # Spans of two kinds may overlap: what lies before the end of the last one is gone already.
    built = F.aggregate(
        "__marks",
        start,
        lambda acc, m: F.struct(
            F.when(m["b"] <= acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(m["a"] - acc["at"], F.lit(0))), m["r"]))
            .alias("out"),
            F.greatest(acc["at"], m["b"]).alias("at"),
        ),
    )
    rows = rows.withColumn("__marks", F.coalesce(marks, F.array().cast("array<struct<a:int,b:int,r:string>>"))).withColumn("__built", built)
    rest = F.col("__built")["at"] + 1
    done = F.concat(F.col("__built")["out"], F.substring(F.col(text), rest, F.length(text)))
    return rows.withColumn(text, F.when(F.size("__marks") == 0, F.col(text)).otherwise(done)).select(*documents.columns)
