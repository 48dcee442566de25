"""Packing documents into windows of tokens: sum-of-squares online placement over a level array.

Each partition is one lane: it tokenizes its documents in the order in which they arrive and places each at once.
A lane keeps the number of open windows at each fill level; a document goes to the level whose choice leaves the
smallest sum of squared counts. Nothing is shuffled, and a lost lane is packed again from its input alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lethe.llm.common import bounded_slices
from lethe.llm.tokens import encoder

WINDOW = 4096
#: Open windows that a lane holds; beyond it they are joined and cut into full ones.
OPEN_WINDOWS = 2048
#: Sequence ids of a lane start at its partition number times this.
LANE_IDS = 1 << 40


class Lane:
    """Sum-of-squares packing of one stream of documents.

    ``add`` and ``flush`` return finished windows: (sequence number, pieces), a piece being (document, start, ids).
    """

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> None:
        self.window, self.limit, self.held, self.next = window, open_windows, 0, 0
        # levels[h]: open windows filled up to h; a full window leaves the array, so levels[window] stays 0.
        self.levels = np.zeros(window + 1, np.int64)
        self.stacks: dict[int, list[list[tuple]]] = {}

    def _finish(self, pieces: list[tuple]) -> tuple[int, list[tuple]]:
        self.next += 1
        return self.next - 1, pieces

    def choose(self, size: int) -> int:
        """The level (0: a new window) whose increase of the sum of squares is least; ties go to the fuller window."""
        best, least = 0, 2 * int(self.levels[size]) + 1
        filled = np.flatnonzero(self.levels[: self.window - size + 1])
        if len(filled):
            change = 2 * (self.levels[filled + size] - self.levels[filled]) + 2
            change[filled + size == self.window] -= 1
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= least:
                best = int(filled[at])
        return best

    def add(self, document: int, ids: bytes) -> list[tuple[int, list[tuple]]]:
        done, count = [], len(ids) // 4
        full = count - count % self.window
        for start in range(0, full, self.window):
            done.append(self._finish([(document, start, ids[4 * start : 4 * (start + self.window)])]))
        size = count - full
        if not size:
            return done
        level = self.choose(size)
        pieces = []
        if level:
            pieces = self.stacks[level].pop()
            self.levels[level] -= 1
            self.held -= 1
        pieces.append((document, full, ids[4 * full :]))
        if level + size == self.window:
            done.append(self._finish(pieces))
        else:
            self.stacks.setdefault(level + size, []).append(pieces)
            self.levels[level + size] += 1
            self.held += 1
        return done + self.flush(last=False) if self.held > self.limit else done

    def flush(self, last: bool = True) -> list[tuple[int, list[tuple]]]:
        """Join the open windows, fullest first, and cut them into full ones; one may stay partly filled, open unless ``last``."""
        done, window, room = [], [], self.window
        for level in sorted(self.stacks, reverse=True):
            for pieces in self.stacks[level]:
                for document, start, ids in pieces:
                    while ids:
                        head, ids = ids[: 4 * room], ids[4 * room :]
                        window.append((document, start, head))
                        start, room = start + len(head) // 4, room - len(head) // 4
                        if not room:
                            done.append(self._finish(window))
                            window, room = [], self.window
        self.levels[:] = 0
        self.stacks, self.held = {}, 0
        if window and last:
            done.append(self._finish(window))
        elif window:
            self.stacks[self.window - room] = [window]
            self.levels[self.window - room] = self.held = 1
        return done


def pack(
    documents: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    window: int = WINDOW,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces (key, start, length, ids, doc_tokens, sequence_id, offset); ``ids`` are little-endian 32-bit integers.

    A document's ids are those of its whole text and ``end_id``; a null or empty text has that id alone. Other columns
    are ignored; repeated rows are packed as often as they occur, null keys too. At most one window of a lane is
    partly filled. An empty table has no pieces.
    """
    kind = documents.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, kind),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    end = int(end_id).to_bytes(4, "little")

    def lane(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = Lane(window), TaskContext.get().partitionId() * LANE_IDS

        def rows(done: list[tuple[int, list[tuple]]], keys: pa.DataType) -> pa.RecordBatch:
            found = []
            for number, pieces in done:
                offset = 0
                for (name, total), start, ids in pieces:
                    found.append((name, start, len(ids) // 4, ids, total, first + number, offset))
                    offset += len(ids) // 4
            kinds = [keys, *[pa.binary() if f.name == "ids" else pa.int64() for f in schema[1:]]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], schema.names)

        kind = pa.null()
        with encoder(tokenizer) as encode:
            for batch in bounded_slices(batches, "__text"):
                names, texts = batch.columns
                kind, done = names.type, []
                for name, ids in zip(names.to_pylist(), encode.encode_all(texts.to_pylist())):
                    done += packer.add((name, len(ids) + 1), ids.tobytes() + end)
                if done:
                    yield rows(done, kind)
        if done := packer.flush():
            yield rows(done, kind)

    plain = documents.select(documents[key].alias("__key"), documents[text].cast("string").alias("__text"))
    return plain.mapInArrow(lane, schema)
