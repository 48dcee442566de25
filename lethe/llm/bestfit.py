"""Best-fit packing planned on a histogram of lengths.

Documents are tokenized once and stored as pieces of at most a window, each with its rank among the pieces of its length in
its partition. What travels to the driver is one count per length, at most as many as a window has tokens. Best fit,
longest first, runs on these counts: windows with the same fill are one group, and a placement is a run of ranks of one
length with the windows it goes to. Pieces then take their planned slots by a join on length and rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.llm.common import bounded_slices, stored
from lethe.llm.tokens import encoder

WINDOW = 4096
#: A run of planned slots: pieces of a length with ranks from ``rank`` on, ``each`` of them to a window, one after the
#: other from place ``at``; the first such window is ``sequence``, and ``pieces`` is how many the run takes.
PLAN = "length long, rank long, pieces long, each long, sequence long, at long"


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """PLAN rows for so many pieces of each length, by best fit with longest pieces first.

    Time and result grow with the number of lengths, not with the number of pieces: a length fills every group of equal
    windows it meets but the last one, which is split.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    # Groups of windows (first sequence, how many) by room, and the rooms that have some, in order.
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []
    opened = 0

    def put(room: int, first: int, windows: int) -> None:
        if room and windows:
            if not groups[room]:
                insort(rooms, room)
            groups[room].append((first, windows))

    for length in sorted((n for n in counts if counts[n]), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, windows = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            else:
                room, first = window, opened
                windows = -(-left // (window // length))
                opened += windows
            # A window that took a piece is now the best fit for the next one, as long as there is room.
            each = room // length
            full = min(windows, left // each)
            if full:
                rows.append((length, rank, full * each, each, first, window - room))
                put(room - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            if left and full < windows:
                rows.append((length, rank, left, left, first + full, window - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, windows - full)
    return rows


def pieces(
    documents: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Stored pieces: (key, piece, start, length, ids, __part, __rank), ``__rank`` counting pieces of a length in a part."""
    schema = T.StructType(
        [
            T.StructField(key, documents.schema[key].dataType),
            *[T.StructField(n, T.LongType()) for n in ("piece", "start", "length")],
            T.StructField("ids", T.BinaryType()),
            *[T.StructField(n, T.LongType()) for n in ("__part", "__rank")],
        ]
    )
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        with encoder(tokenizer) as encode:
            for batch in bounded_slices(batches, "__text"):
                names, texts = batch.columns
                rows = []
                for name, found in zip(names.to_pylist(), encode.encode_all(texts.to_pylist())):
                    ids = found.tobytes() + end
                    for number, start in enumerate(range(0, len(ids), 4 * window)):
                        piece = ids[start : start + 4 * window]
                        length = len(piece) // 4
                        rows.append((name, number, start // 4, length, piece, part, seen[length]))
                        seen[length] += 1
                kinds = [names.type, *[pa.binary() if f.name == "ids" else pa.int64() for f in schema[1:]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema.names)

    plain = documents.select(documents[key].alias("__key"), documents[text].cast("string").alias("__text"))
    return stored(plain.mapInArrow(cut, schema), "pieces")


def place(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces; other columns are kept but for __part and __rank.

    The plan has at most a few rows per length. It meets the counts of parts first, so that a piece sees only the runs of
    its own length and part.
    """
    counted = cut.groupBy("__part", "length").agg(F.count(F.lit(1)).alias("__n"))
    totals = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    planned = cut.sparkSession.createDataFrame(plan(totals, window), PLAN).withColumnRenamed("length", "__length")
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    meet = (F.col("length") == F.col("__length")) & (F.col("rank") < F.col("__before") + F.col("__n"))
    runs = parts.join(planned, meet & (F.col("rank") + F.col("pieces") > F.col("__before")))
    runs = runs.select("__part", "length", (F.col("rank") - F.col("__before")).alias("__first"), "pieces", "each", "sequence", "at")
    runs = runs.toDF(*["__p", "__l", "__first", "__pieces", "__each", "__sequence", "__at"])
    inside = (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__first") + F.col("__pieces"))
    found = cut.join(runs, (F.col("__part") == F.col("__p")) & (F.col("length") == F.col("__l")) & inside)
    place_ = F.col("__rank") - F.col("__first")
    sequence = F.col("__sequence") + F.floor(place_ / F.col("__each"))
    offset = F.col("__at") + place_ % F.col("__each") * F.col("length")
    kept = [c for c in cut.columns if c not in ("__part", "__rank")]
    return found.select(*kept, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def pack(
    documents: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces (key, piece, start, length, ids, sequence_id, offset) of windows numbered from 0.

    A document's ids are those of its whole text and ``end_id``; a null or empty text has that id alone. Only documents
    longer than a window are cut, into whole windows and a rest. Repeated rows and null keys are packed as often as they
    occur; other columns are ignored; an empty table has no pieces. Which of two pieces of one length takes which slot
    depends on the partitions of the stored pieces alone.
    """
    return place(pieces(documents, tokenizer, end_id, window, key, text), window)
