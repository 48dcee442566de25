"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learnt from document labels.

A sentence's probability is logistic in its words, each standing for itself and for its beginnings and endings (so
that inflected and compound forms share what is learnt); a document is toxic unless every sentence is clean,
P = 1 - prod(1 - p_s). Only P meets a label in training, so the sentence scores are learnt, and then tell where a
document offends.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import bounded_batches

#: Labelled documents of each class that are used to fit, chosen by a hash of their id.
SAMPLE_PER_CLASS = 4_000
#: Hashed words; a weight each.
DIMENSIONS = 1 << 20
EPOCHS = 200
RATE = 0.1
DECAY = 1e-4
#: A feature counts from so many documents of the sample on.
MIN_DOCUMENTS = 4
#: Words whose weight a worker remembers.
MEMO_WORDS = 150_000
_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGES = ",;:\"'()[]{}<>*#$%&|-_"


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, its first 3 to 5 and its last 3 and 4 letters where it is longer than these."""
    names = [f"w{word}", *(f"p{word[:n]}" for n in (3, 4, 5) if len(word) > n), *(f"s{word[-n:]}" for n in (3, 4) if len(word) > n)]
    return [xxhash.xxh32_intdigest(n) % DIMENSIONS for n in names]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the stretches between full stops, marks and line ends that have a word."""
    out = []
    for m in _SENTENCE.finditer(text):
        found = [w for w in (x.strip(_EDGES) for x in m.group().lower().split()) if w]
        if found:
            out.append((m.start(), m.end(), found))
    return out


def fit(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the hashed words and the bias, by full-batch Adam on the labels' likelihood."""
    index: dict[str, int] = {}
    # Compact arrays: a worker that has fitted goes on to other tasks, and keeps the memory that it once took.
    words, sentence_of, document_of = array("i"), array("i"), array("i")
    for i, text in enumerate(texts):
        for _, _, found in sentences(text):
            for w in set(found):
                words.append(index.setdefault(w, len(index)))
                sentence_of.append(len(document_of))
            document_of.append(i)
    weights = np.zeros(DIMENSIONS, np.float32)
    y = np.asarray(labels, np.float64)
    rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    if not words:
        return weights, float(np.log(rate / (1 - rate)))
    words_, sentence_of_, document_of_ = (np.frombuffer(x, np.int32) for x in (words, sentence_of, document_of))
    features_, word_of = array("i"), array("i")
    for w, number in index.items():
        found = features(w)
        features_.extend(found)
        word_of.extend([number] * len(found))
    count = len(index)
    index.clear()
    used, column = np.unique(np.frombuffer(features_, np.int32), return_inverse=True)
    column, word_of = column.astype(np.int32), np.frombuffer(word_of, np.int32)
    # Documents with the word, all and toxic, added up over the words of a feature.
    seen = np.unique(words_ * np.int64(len(y)) + document_of_[sentence_of_])
    by_word = [np.bincount(seen // len(y), weights=v[seen % len(y)], minlength=count) for v in (np.ones(len(y)), y)]
    del seen
    n, n_toxic = (np.bincount(column, weights=v[word_of], minlength=len(used)) for v in by_word)
    keep = n >= MIN_DOCUMENTS
    # The start: how much more often a feature is in toxic documents, shrunk where it was seen rarely.
    share = (n_toxic + 4 * rate) / (n + 4)
    w = np.where(keep, 0.2 * np.log(share * (1 - rate) / ((1 - share) * rate)), 0.0)
    b = -4.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)

    def by_feature(v: np.ndarray) -> np.ndarray:
        return np.bincount(word_of, weights=v[column], minlength=count)

    balance = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate))
    for step in range(1, EPOCHS + 1):
        z = np.clip(np.bincount(sentence_of_, weights=by_feature(w)[words_], minlength=len(document_of_)) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(document_of_, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y))
        toxic = np.maximum(-np.expm1(clean), 1e-9)
        # d(-log likelihood)/dz: p for a clean document, -p (1 - P) / P for a toxic one.
        slope = np.where(y > 0, -np.exp(clean) / toxic, 1.0) * balance
        dz = slope[document_of_] * p
        dword = np.bincount(words_, weights=dz[sentence_of_], minlength=count)
        dw = np.bincount(column, weights=dword[word_of], minlength=len(used)) / len(y) + DECAY * w
        gradient = np.append(np.where(keep, dw, 0.0), dz.sum() / len(y))
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights[used] = w
    return weights, float(b)


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, float]:
    """Fit on at most SAMPLE_PER_CLASS labelled documents of each class that are not held out.

    The sample's ids, of proven number, are broadcast; its texts meet in one task. Null labels are left out, and of
    several labels of a document the greatest counts. Without labels every weight is 0 and the bias neutral.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("int").alias("__y"))
    order = [F.xxhash64("__key"), F.col("__key")]
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("__y") == value).orderBy(*order).limit(SAMPLE_PER_CLASS)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = documents.select(documents[key].alias("__key"), documents[text].cast("string").alias("__text"))
    sample = rows.join(F.broadcast(chosen), "__key").select("__key", "__text", "__y")

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        data = pd.concat(frames) if frames else pd.DataFrame({"__key": [], "__text": [], "__y": []})
        data = data.sort_values(["__key", "__text"], na_position="first").drop_duplicates("__key")
        weights, bias = fit(data["__text"].fillna("").tolist(), data["__y"].to_numpy(float))
        yield pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    row = sample.repartition(1).mapInPandas(fitted, "weights binary, bias double").first()
    if row is None:
        return np.zeros(DIMENSIONS, np.float32), 0.0
    return np.frombuffer(row["weights"], np.float32), row["bias"]


class _Weights(dict):
    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.table = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO_WORDS:
            self.clear()
        bare = word.strip(_EDGES)
        value = self[word] = float(self.table[features(bare)].sum()) if bare else 0.0
        return value


class _Scorer:
    """Scores texts with a model; made once in each worker."""

    def __init__(self, chosen: np.ndarray, values: np.ndarray, bias: float) -> None:
        table = np.zeros(DIMENSIONS, np.float32)
        table[chosen] = values
        self.get, self.bias = _Weights(table).__getitem__, bias

    def __call__(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or of the sentences, and (start, end, score) of those of at least one half."""
        spans, sums = [], []
        for m in _SENTENCE.finditer(text or ""):
            found = set(m.group().lower().split())
            if found:
                spans.append(m.span())
                sums.append(sum(map(self.get, found)))
        p = 1 / (1 + np.exp(-np.clip(np.array(sums, float) + self.bias, -30, 30)))
        whole = float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))
        return whole, [(*spans[i], float(p[i])) for i in np.flatnonzero(p >= 0.5)]


def score(documents: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: (key, score, offending): noisy-or of the sentences, and those of at least one half.

    ``offending`` is an array of (start, end, score) in code points. Null and empty texts have no sentence and score
    0. The model has a fixed size and travels with the plan. Repeated rows score alike; other columns are ignored.
    """
    weights, bias = model
    chosen = np.flatnonzero(weights)
    values = weights[chosen]
    kind = documents.schema[key].dataType.simpleString()

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = _Scorer(chosen, values, bias)
        for batch in bounded_batches(batches, "__text"):
            found = [of(t) for t in batch["__text"]]
            yield pd.DataFrame({key: batch["__key"].to_numpy(), "score": [x for x, _ in found], "offending": [x for _, x in found]})

    plain = documents.select(documents[key].alias("__key"), documents[text].cast("string").alias("__text"))
    return plain.mapInPandas(scored, f"`{key}` {kind}, score double, offending array<struct<start:int,end:int,score:double>>")


def keep_clean(documents: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below ``threshold``; those with null or empty texts stay."""
    weights, bias = model
    chosen = np.flatnonzero(weights)
    values = weights[chosen]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Scorer(chosen, values, bias)
        for batch in batches:
            keep = [of(t.as_py())[0] < threshold for t in batch.column(batch.schema.get_field_index(text))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(clean, documents.schema)
