"""Approximate matching of a pattern dictionary: normalized whole words, else partial similarity.

A similarity join by pigeonholes. A window of a text that is similar enough to a pattern differs from it in few insertions
and deletions, so that one of slightly more pieces of the pattern stands in the window verbatim. Pieces of patterns meet
the grams of texts by an equi-join, whole words meet by the same join, and a small function checks the one window around a
meeting. Texts shorter than a pattern change roles with it. Rows are told apart by a digest of text and concept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.functions.text import digest

THRESHOLD = 85.0
MIN_COMPACT_LENGTH = 4
#: Pieces and grams meet on at most so many characters.
GRAM = 3
#: Places of a text whose grams are laid out in one row; longer texts have several.
CHUNK = 16_384
#: Dictionaries of up to so many characters (four keys a character) travel to the texts; others are shuffled with them.
BROADCAST_CHARS = 150_000
FUZZY = "array<struct<ord:int,pattern:string,n:int,exact:boolean>>"
#: How a pattern may meet a text: inside it, cut off by one of its ends, as whole words, or as the longer of the two.
INSIDE, EDGE, WORDS, SWAPPED = range(4)
#: Keys are numbers: the size of a gram and its letters, each below BASE.
BASE = 37
LETTERS = np.zeros(256, np.int32)
LETTERS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = np.arange(1, BASE)
SIZE_STEP, SWAPPED_STEP = BASE**GRAM, (GRAM + 1) * BASE**GRAM


def _folded(text: str | None) -> str | None:
    if text is None:
        return None
    # Folded before it is decomposed: capitals that decomposition brings in are dropped.
    text = unicodedata.normalize("NFKD", text.casefold())
    text = "".join(c for c in text if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", text).strip()


@F.pandas_udf(T.StringType())
def _normalize_other(texts: pd.Series) -> pd.Series:
    return texts.map(_folded)


def normalize(text: Column | str) -> Column:
    """Case-folded, accent-free text of [a-z0-9] words separated by one space; only other than ASCII texts go to Python."""
    text = F.col(text) if isinstance(text, str) else text
    ascii_ = F.octet_length(text) == F.char_length(text)
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when(ascii_, plain).otherwise(_normalize_other(F.when(~ascii_, text)))


def _bits(needle: bytes) -> dict[int, int]:
    bits: dict[int, int] = {}
    for i, c in enumerate(needle):
        bits[c] = bits.get(c, 0) | (1 << i)
    return bits


class _Common:
    """Longest common subsequences of needles of one length with texts that are read along, for many pairs at once.

    A state has a bit per needle character; unset bits count the common ones.
    """

    def __init__(self, needles: list[bytes], backwards: bool = False) -> None:
        self.m = len(needles[0])
        kinds = {n: i for i, n in enumerate(dict.fromkeys(needles))}
        # Words of 64 bits where they are long enough, else Python's integers.
        self.kind = np.uint64 if self.m < 64 else object
        self.full = self.kind((1 << self.m) - 1) if self.m < 64 else (1 << self.m) - 1
        self._table = np.zeros((len(kinds), 256), self.kind)
        for needle, i in kinds.items():
            for c, bits in _bits(needle[::-1] if backwards else needle).items():
                self._table[i, c] = bits
        self._own = np.array([kinds[n] for n in needles])

    def start(self) -> np.ndarray:
        return np.full(len(self._own), self.full, self.kind)

    def read(self, state: np.ndarray, letters: np.ndarray) -> np.ndarray:
        hit = state & self._table[self._own, letters]
        return ((state + hit) | (state - hit)) & self.full

    def length(self, state: np.ndarray) -> np.ndarray:
        if self.kind is object:
            return np.array([self.m - s.bit_count() for s in state])
        return self.m - np.bitwise_count(state).astype(np.int64)


def _matrix(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts])
    width = max(int(sizes.max()), 1)
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(-1, width), sizes


def _inside(needles: list[bytes], texts: list[bytes], threshold: float) -> np.ndarray:
    """Some window of the needle's length reaches the threshold; needles have one length."""
    common, (letters, sizes) = _Common(needles), _matrix(texts)
    found = np.zeros(len(texts), bool)
    for start in range(letters.shape[1] - common.m + 1):
        state = common.start()
        for i in range(start, start + common.m):
            state = common.read(state, letters[:, i])
        found |= (sizes >= start + common.m) & (200 * common.length(state) >= threshold * 2 * common.m)
    return found


def _cut_off(needles: list[bytes], texts: list[bytes], threshold: float, backwards: bool) -> np.ndarray:
    """Some prefix (backwards: suffix) of the text, shorter than the needle, reaches the threshold."""
    common = _Common(needles, backwards)
    letters, sizes = _matrix([(t[::-1] if backwards else t)[: common.m - 1] for t in texts])
    found, state = np.zeros(len(texts), bool), common.start()
    for w in range(1, letters.shape[1] + 1):
        state = common.read(state, letters[:, w - 1])
        found |= (sizes >= w) & (200 * common.length(state) >= threshold * (common.m + w))
    return found


def reached(kinds: list[int], needles: list[bytes], texts: list[bytes], ends: list[bytes], threshold: float) -> np.ndarray:
    """For each pair whether the needle reaches the text in the given way; ``ends`` is the text behind for EDGE."""
    found = np.zeros(len(needles), bool)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (kind, needle) in enumerate(zip(kinds, needles)):
        if needle:
            groups.setdefault((kind, len(needle)), []).append(i)
    for (kind, _), rows in groups.items():
        own, text = [needles[i] for i in rows], [texts[i] for i in rows]
        hit = np.zeros(len(rows), bool)
        if kind != EDGE:
            hit |= _inside(own, text, threshold)
        if kind != INSIDE:
            hit |= _cut_off(own, text, threshold, False)
            hit |= _cut_off(own, [ends[i] for i in rows] if kind == EDGE else text, threshold, True)
        found[rows] = hit
    return found


def similar(left: str, right: str, threshold: float = THRESHOLD) -> bool:
    """The shorter string, slid over the longer one, reaches the similarity at some place.

    Similarity of a window is 100 * 2 * LCS / (sum of lengths); windows cut off by either end of the longer string count
    too.
    """
    if not left or not right:
        return False
    a, b = left.encode(), right.encode()
    pairs = [(a, b)] if len(a) <= len(b) else [(b, a)]
    if len(a) == len(b):
        pairs.append((b, a))
    return any(reached([SWAPPED], [needle], [text], [text], threshold)[0] for needle, text in pairs)


def changes(size: int, threshold: float, cut_off: bool) -> int:
    """How many insertions and deletions turn a string of this size into a window that still reaches the threshold."""
    share = (100 - threshold) / 100
    return int((2 * size - 1) * share + 1e-9) if cut_off else 2 * int(size * share + 1e-9)


def pieces(compact: bytes, threshold: float, cut_off: bool) -> list[tuple[int, bytes]]:
    """One more piece than changes, each with its place and by its first characters."""
    size = len(compact)
    count = min(changes(size, threshold, cut_off) + 1, size)
    cuts = [i * size // count for i in range(count + 1)]
    return [(at, compact[at : min(end, at + GRAM)]) for at, end in zip(cuts, cuts[1:])]


def _codes(text: bytes, size: int) -> np.ndarray:
    """The key of the gram at each place."""
    letters = LETTERS[np.frombuffer(text, np.uint8)]
    if len(letters) < size:
        return np.zeros(0, np.int32)
    code = letters[: len(letters) - size + 1].copy()
    for k in range(1, size):
        code = code * BASE + letters[k : len(letters) - size + 1 + k]
    return code + (size - 1) * SIZE_STEP


def _key(gram: bytes) -> int:
    return int(_codes(gram, len(gram))[0])


def _spelled(normal: str) -> tuple[bytes, bytes]:
    """The text without its spaces, and a mark for each character: 1 where a word begins. One more mark ends the text."""
    compact = normal.replace(" ", "").encode()
    marks = bytearray(len(compact) + 1)
    at = 0
    for word in normal.split(" "):
        marks[at] = 1
        at += len(word)
    marks[at] = 1
    return compact, bytes(marks)


ENTRIES = "concept string, ord int, pattern string, compact binary, marks binary, m int, kind int, key int, piece int"


def normalized_entries(patterns: DataFrame) -> DataFrame:
    """Dictionary rows (concept, ord, pattern, normal); patterns that normalize to nothing are dropped."""
    if "concept" not in patterns.columns:
        patterns = patterns.withColumn("concept", F.lit(""))
    table = patterns.withColumn("normal", normalize(F.col("pattern"))).where(F.length("normal") > 0)
    return table.select(F.col("concept").cast("string"), F.col("ord").cast("int"), "pattern", "normal")


def _pattern_keys(table: DataFrame, threshold: float) -> DataFrame:
    """ENTRIES: a row per key under which a pattern may meet a text."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [column.split()[0] for column in ENTRIES.split(", ")]
        for batch in batches:
            rows = []
            for concept, order, pattern, normal in zip(*[batch[c] for c in ("concept", "ord", "pattern", "normal")]):
                compact, marks = _spelled(normal)
                found = [(WORDS, _key(compact[:GRAM]), 0)]
                if len(compact) >= MIN_COMPACT_LENGTH:
                    found += [(INSIDE, _key(gram), at) for at, gram in pieces(compact, threshold, False)]
                    found += [(EDGE, _key(gram), at) for at, gram in pieces(compact, threshold, True)]
                    # As the longer of the two it matters only that a piece of the text is in it.
                    whole = {int(code) for size in range(1, GRAM + 1) for code in _codes(compact, size)}
                    found += [(SWAPPED, SWAPPED_STEP + code, 0) for code in whole]
                rows += [(concept, order, pattern, compact, marks, len(compact), *key) for key in found]
            yield pd.DataFrame(rows, columns=names)

    return table.mapInPandas(keys, ENTRIES)


LAID = "id binary, owner string, n int, base int, around binary, starts binary, head binary, tail binary, grams array<struct<gram:int,places:array<int>>>"


def _laid(rows: DataFrame, longest: int, sizes: list[int], threshold: float) -> DataFrame:
    """Texts with the places of each of their grams, in chunks with as much text around as a pattern needs.

    A text that is no longer than the longest pattern also has its own pieces, to be sought in patterns.
    """
    reach = longest + changes(longest, threshold, True) + 1
    edge = max(longest - 1, 1)

    def chunk(identity: bytes, concept: str, compact: bytes, marks: bytes, first: int) -> tuple:
        base = max(first - reach, 0)
        around = compact[base : first + CHUNK + reach]
        codes = [_codes(compact[first : first + CHUNK + size - 1], size) for size in sizes]
        code = np.concatenate(codes)
        place = np.concatenate([np.arange(first, first + len(c)) for c in codes]).astype(np.int32)
        order = np.argsort(code, kind="stable")
        code, place = code[order], place[order]
        begins = np.flatnonzero(np.diff(code, prepend=-1))
        grams, counts = code[begins], np.diff(begins, append=len(code))
        if first == 0 and len(compact) <= longest:
            own = {_key(gram) for cut_off in (False, True) for _, gram in pieces(compact, threshold, cut_off)}
            grams = np.concatenate([grams, SWAPPED_STEP + np.array(sorted(own), np.int32)])
            counts, place = np.concatenate([counts, np.ones(len(own), np.int64)]), np.concatenate([place, np.zeros(len(own), np.int32)])
        head, tail = (compact[:edge], compact[-edge:]) if first == 0 else (None, None)
        if first and first + CHUNK >= len(compact):
            tail = compact[-edge:]
        return identity, concept, len(compact), base, around, marks[base : base + len(around) + 1], head, tail, grams, counts, place

    def lists(counts: list[int], values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for identity, concept, normal in zip(*[batch.column(c).to_pylist() for c in ("id", "owner", "normal")]):
                compact, marks = _spelled(normal or "")
                for first in range(0, len(compact), CHUNK):
                    out.append(chunk(identity, concept, compact, marks, first))
                    if len(out) >= 256:
                        yield table(out)
                        out = []
            if out:
                yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        plain = [list(c) for c in zip(*[row[:8] for row in out])]
        grams, counts, places = (np.concatenate([row[i] for row in out]) for i in (8, 9, 10))
        gram = pa.StructArray.from_arrays([pa.array(grams.astype(np.int32)), lists(counts, pa.array(places.astype(np.int32)))], ["gram", "places"])
        types = [pa.binary(), pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        columns = [pa.array(values, kind) for values, kind in zip(plain, types)]
        return pa.RecordBatch.from_arrays([*columns, lists([len(row[8]) for row in out], gram)], [column.split()[0] for column in LAID.split(", ")])

    return rows.mapInArrow(lay, LAID)


HITS = "id binary, ord int, pattern string, m int, kind int, at int"


def _checked(likely: DataFrame, threshold: float) -> DataFrame:
    """HITS: the rows that are whole words, or whose needle reaches the text.

    A step of its own and no function in a filter: for that one, Spark would keep each row as it was before ``needle`` and
    ``text`` were cut out of its chunk, chunk and all, until the answer is there.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            values = [[v or b"" for v in batch.column(c).to_pylist()] for c in ("needle", "text", "end")]
            found = reached(kinds, *values, threshold) | (np.array(kinds) == WORDS)
            yield batch.select([column.split()[0] for column in HITS.split(", ")]).filter(pa.array(found))

    return likely.mapInArrow(check, HITS)


def _found(rows: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """(id, fuzzy_matches) of the texts (id, owner, normal) that have some; ``owner`` is the concept."""
    entries = _pattern_keys(table, threshold)
    size = F.when(F.col("kind") != SWAPPED, F.floor(F.col("key") / SIZE_STEP) + 1).cast("int")
    longest, chars, sizes = entries.agg(F.max("m"), F.sum(F.when(F.col("kind") == WORDS, F.col("m"))), F.collect_set(size)).first()
    if not longest:
        return rows.select("id", F.array().cast(FUZZY).alias("fuzzy_matches")).limit(0)
    entries = F.broadcast(entries) if chars <= BROADCAST_CHARS else entries
    kind, m, n, at, piece = (F.col(c) for c in ("kind", "m", "n", "at", "piece"))
    texts = _laid(rows, longest, sorted(sizes), threshold).select("*", F.explode("grams").alias("g"))
    texts = texts.select("id", "owner", "n", "base", "around", "starts", "head", "tail", "g.*")
    fits = F.when(kind == WORDS, F.lit(True)).when(kind == SWAPPED, n <= m).otherwise(m <= n)
    met = texts.join(entries, (F.col("owner") == F.col("concept")) & (F.col("gram") == F.col("key")) & fits)
    # What is cut off is compared as a whole: whether a piece is near enough to an end is all that its places tell.
    most = F.floor((2 * m - 1) * ((100 - threshold) / 100) + 1e-9)
    front, back = F.get("places", F.lit(0)) - piece <= most, n - m - (F.element_at("places", -1) - piece) <= most
    met = met.select("*", front.alias("front"), back.alias("back")).where((kind != EDGE) | F.col("front") | F.col("back"))
    met = met.select("*", F.explode(F.when(kind == EDGE, F.slice("places", 1, 1)).otherwise(F.col("places"))).alias("at")).drop("places")
    start, front, back = at - piece, F.col("front"), F.col("back")
    slack = F.floor(m * ((100 - threshold) / 100) + 1e-9).cast("int")
    begin = F.greatest(start - slack, F.lit(0))
    window = F.substring(F.col("around"), begin - F.col("base") + 1, start + slack + m - begin)
    # Whole words: the same letters, and words begin at the same places.
    same = (F.substring(F.col("around"), start - F.col("base") + 1, m) == F.col("compact")) & (
        F.substring(F.col("starts"), start - F.col("base") + 1, m + 1) == F.col("marks")
    )
    # A window and what may stand around it differ from the pattern in no more than this; most meetings end here.
    aside = F.octet_length(window) - m + 2 * slack
    near = F.call_function("levenshtein", F.col("compact").cast("string"), window.cast("string"), aside.cast("int")) >= 0
    possible = F.when(kind == WORDS, same).when(kind == INSIDE, near).otherwise(F.lit(True))
    text = F.when(kind == INSIDE, window).when((kind == EDGE) & front, F.substring(F.col("head"), F.lit(1), m - 1)).when(kind == SWAPPED, F.col("compact"))
    needle = F.when(kind == SWAPPED, F.col("head")).when(kind != WORDS, F.col("compact"))
    end = F.when((kind == EDGE) & back, F.col("tail"))

    likely = met.where(possible).select("id", "ord", "pattern", "m", "kind", "at", needle.alias("needle"), text.alias("text"), end.alias("end"))
    hits = _checked(likely, threshold)
    # Whole words are counted without overlap; a match by similarity counts once.
    at = F.collect_set(F.when(kind == WORDS, F.col("at")))
    counted = hits.groupBy("id", "ord", "pattern", "m").agg(F.sort_array(at).alias("places"))
    step = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("free"), F.lit(0).alias("n")),
        lambda acc, at: F.when(at >= acc["free"], F.struct((at + F.col("m")).alias("free"), (acc["n"] + 1).alias("n"))).otherwise(acc),
    )
    exact = F.size("places") > 0
    one = F.struct("ord", "pattern", F.when(exact, step["n"]).otherwise(1).alias("n"), exact.alias("exact"))
    return counted.groupBy("id").agg(F.sort_array(F.collect_list(one)).cast(FUZZY).alias("fuzzy_matches"))


def with_fuzzy_matches(
    df: DataFrame,
    patterns: DataFrame,
    text: str,
    key: str | None = None,
    concept: str | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Add ``fuzzy_matches``: the patterns found with their counts, by whole words (``exact``) or else by similarity.

    ``ord`` must be unique within a concept. One route serves dictionaries and texts of any size; rows are identified by
    their text and concept, so that null and repeated keys, which ``key`` may hold, don't matter. A null text has no
    matches, and a null concept meets no pattern. Patterns with fewer than 4 letters and digits match as whole words only.
    """
    if not 60 <= threshold <= 100:
        raise ValueError(f"threshold must be between 60 and 100, got {threshold}")
    own = F.col(concept).cast("string") if concept else F.lit("")
    keyed = df.withColumn("__id", digest(F.col(text), own))
    rows = keyed.select(F.col("__id").alias("id"), own.alias("owner"), normalize(F.col(text)).alias("normal"))
    found = _found(rows, normalized_entries(patterns), threshold).withColumnRenamed("id", "__id")
    matches = F.coalesce("fuzzy_matches", F.array().cast(FUZZY))
    return keyed.join(found, "__id", "left").withColumn("fuzzy_matches", matches).select(*df.columns, "fuzzy_matches")


def fuzzy_count(matches: Column) -> Column:
    return F.aggregate(matches, F.lit(0).cast("bigint"), lambda acc, m: acc + m["n"])


def _lcs_words(prediction: list[str], reference: list[str]) -> int:
    places: dict[str, int] = {}
    for i, w in enumerate(reference):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(reference)) - 1
    state = full
    for w in prediction:
        hit = state & places.get(w, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(reference) - state.bit_count()


def _recall(prediction: str | None, reference: str | None) -> float | None:
    if prediction is None or reference is None:
        return None
    wanted = reference.split()
    return _lcs_words(prediction.split(), wanted) / len(wanted) if wanted else 0.0


def _sentences(text: str) -> list[list[str]]:
    """Sentences end at full stops; one of blanks alone has one empty word."""
    return [" ".join(part.split()).split(" ") for part in text.split(".") if part]


def _common_words(left: list[str], right: list[str]) -> set[str]:
    """Words of one longest common subsequence: read from the ends, ties drop a word of the right side.

    A state of ``len(left)`` bits per word of the right side is the whole table: unset bits below a place count the common
    words up to there.
    """
    places: dict[str, int] = {}
    for i, word in enumerate(left):
        places[word] = places.get(word, 0) | (1 << i)
    full = (1 << len(left)) - 1
    states = [full]
    for word in right:
        state = states[-1]
        hit = state & places.get(word, 0)
        states.append(((state + hit) | (state - hit)) & full)
    found, i, j = set(), len(left), len(right)
    while i and j:
        if left[i - 1] == right[j - 1]:
            found.add(left[i - 1])
            i, j = i - 1, j - 1
            continue
        below = (1 << i) - 1
        # Shorter on the left without loss, and not shorter on the right without loss.
        if states[j] >> (i - 1) & 1 and (states[j] & below).bit_count() < (states[j - 1] & below).bit_count():
            i -= 1
        else:
            j -= 1
    return found


def _recall_by_sentence(prediction: str | None, reference: str | None) -> float | None:
    """Share of the distinct reference words that some pair of sentences has in a longest common subsequence."""
    if prediction is None or reference is None:
        return None
    guesses, wanted = _sentences(prediction), _sentences(reference)
    total = len({word for sentence in wanted for word in sentence})
    covered: set[str] = set()
    for sentence in wanted:
        for guess in guesses:
            covered |= _common_words(sentence, guess)
    return len(covered) / total if total else 0.0


def lcs_recall(prediction: Column, reference: Column, by_sentence: bool = True) -> Column:
    """Share of the reference words in longest common subsequences with the prediction.

    By sentence (the usual summary-level recall) distinct words are counted, over all pairs of sentences; otherwise the
    words of both texts are one sequence. An empty prediction counts as NOANSWER, an empty reference has recall 0.
    """
    score = _recall_by_sentence if by_sentence else _recall

    @F.pandas_udf(T.DoubleType())
    def recall(predictions: pd.Series, references: pd.Series) -> pd.Series:
        return pd.Series([score(p, r) for p, r in zip(predictions, references)], dtype="float64")

    answered = F.when(prediction == "", F.lit("NOANSWER")).otherwise(prediction)
    return recall(answered, reference)
