"""Token files: patched frame-of-reference blocks, one payload per document, in ascending order of the documents.

A file set is a Parquet folder with rows (key, n_tokens, payload, __part). A payload holds the ids of one document:

    counts     <u4 x 2   ids, blocks
    minima     <u4 x blocks
    starts     <u4 x blocks   where the block's words begin: the index for reading single blocks
    widths     u1 x blocks    bits of a packed value
    patched    u1 x blocks    number of exceptions
    words      <u8 ...        64 values of ``width`` bits in ``width`` words
    places     u1 x exceptions
    values     <u4 x exceptions

A block has 64 ids less their minimum. The width holds PERCENTILE of them; larger ones are exceptions, listed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.llm.common import bounded_batches, bounded_slices, stored
from lethe.llm.tokens import encoder

BLOCK = 64
PERCENTILE = 90
#: Documents packed at a time: their arrays stay in the processor's cache.
PACKED_ROWS = 256


def _shifts(width: int) -> Iterator[tuple[int, int, int]]:
    """(value, word, bit) of the 64 values of a block with that width."""
    for value in range(BLOCK):
        yield value, *divmod(value * width, 64)


def encode(documents: list[np.ndarray], percentile: int = PERCENTILE) -> list[bytes]:
    """The payloads of some documents' ids (unsigned 32-bit); blocks of equal width are packed together."""
    sizes = np.array([len(d) for d in documents], np.int64)
    blocks = -(-sizes // BLOCK)
    total = int(blocks.sum())
    if not total:
        return [np.array([0, 0], "<u4").tobytes() for _ in documents]
    ids = np.concatenate(documents).astype(np.uint32)
    owner = np.repeat(np.arange(len(documents)), blocks)
    ends = np.cumsum(blocks)
    within = np.arange(total) - np.repeat(ends - blocks, blocks)
    # The last block is filled up with the document's last id.
    place = np.minimum(within[:, None] * BLOCK + np.arange(BLOCK), (sizes[owner] - 1)[:, None])
    rest = ids[(np.cumsum(sizes) - sizes)[owner][:, None] + place]
    minima = rest.min(axis=1)
    rest -= minima[:, None]
    rank = -(-percentile * BLOCK // 100) - 1
    widths = np.frexp(np.partition(rest, rank, axis=1)[:, rank].astype(np.float64))[1].astype(np.int64)
    over = rest > ((np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    patched = over.sum(axis=1)
    exceptions = np.flatnonzero(over)
    places, values = exceptions % BLOCK, rest.reshape(-1)[exceptions]
    firsts = np.cumsum(widths) - widths
    words = np.zeros(int(widths.sum()), np.uint64)
    columns = rest.T.astype(np.uint64, order="C")
    for width in np.unique(widths[widths > 0]).tolist():
        chosen = np.flatnonzero(widths == width)
        part = columns[:, chosen] & np.uint64((1 << width) - 1)
        packed = np.zeros((width, len(chosen)), np.uint64)
        for value, word, bit in _shifts(width):
            packed[word] |= part[value] << np.uint64(bit)
            if bit + width > 64:
                packed[word + 1] |= part[value] >> np.uint64(64 - bit)
        words[firsts[chosen][:, None] + np.arange(width)] = packed.T
    before = np.concatenate([[0], np.cumsum(patched)])
    out = []
    for i, size in enumerate(sizes):
        a, b = int(ends[i] - blocks[i]), int(ends[i])
        if a == b:
            out.append(np.array([0, 0], "<u4").tobytes())
            continue
        first, last = int(firsts[a]), int(firsts[b - 1] + widths[b - 1])
        x, y = int(before[a]), int(before[b])
        out.append(
            b"".join(
                (
                    np.array([size, b - a], "<u4").tobytes(),
                    minima[a:b].astype("<u4").tobytes(),
                    (firsts[a:b] - first).astype("<u4").tobytes(),
                    widths[a:b].astype(np.uint8).tobytes(),
                    patched[a:b].astype(np.uint8).tobytes(),
                    words[first:last].astype("<u8").tobytes(),
                    places[x:y].astype(np.uint8).tobytes(),
                    values[x:y].astype("<u4").tobytes(),
                )
            )
        )
    return out


def _sections(payload: bytes) -> tuple:
    size, blocks = (int(x) for x in np.frombuffer(payload, "<u4", 2))
    at, found = 8, []
    for kind in ("<u4", "<u4", "u1", "u1"):
        found.append(np.frombuffer(payload, kind, blocks, at))
        at += found[-1].nbytes
    for kind, count in (("<u8", int(found[2].sum())), ("u1", int(found[3].sum())), ("<u4", int(found[3].sum()))):
        found.append(np.frombuffer(payload, kind, count, at))
        at += found[-1].nbytes
    return size, *found


def decode(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of some payloads; blocks of equal width are unpacked together."""
    read = [_sections(p) for p in payloads]
    if not read:
        return []
    sizes = [r[0] for r in read]
    minima, widths, patched, words, places, values = (np.concatenate([r[i] for r in read]) for i in (1, 3, 4, 5, 6, 7))
    widths = widths.astype(np.int64)
    firsts = np.cumsum(widths) - widths
    rest = np.zeros((BLOCK, len(widths)), np.uint32)
    for width in np.unique(widths[widths > 0]).tolist():
        chosen = np.flatnonzero(widths == width)
        packed = np.ascontiguousarray(words[firsts[chosen][:, None] + np.arange(width)].T)
        mask = np.uint64((1 << width) - 1)
        for value, word, bit in _shifts(width):
            got = packed[word] >> np.uint64(bit)
            if bit + width > 64:
                got |= packed[word + 1] << np.uint64(64 - bit)
            rest[value, chosen] = got & mask
    rest[places, np.repeat(np.arange(len(widths)), patched)] = values
    flat = (rest.T + minima[:, None]).astype(np.uint32).reshape(-1)
    out, at = [], 0
    for size in sizes:
        out.append(flat[at : at + size])
        at += -(-size // BLOCK) * BLOCK
    return out


def decode_block(payload: bytes, block: int) -> np.ndarray:
    """The ids of one block, found through the index of starts."""
    size, minima, starts, widths, patched, words, places, values = _sections(payload)
    width, first = int(widths[block]), int(starts[block])
    bits = np.unpackbits(words[first : first + width].view(np.uint8), bitorder="little").reshape(BLOCK, -1)
    rest = np.zeros(BLOCK, np.uint64)
    for i in range(width):
        rest |= bits[:, i].astype(np.uint64) << np.uint64(i)
    x = int(patched[:block].sum())
    chosen = slice(x, x + int(patched[block]))
    rest[places[chosen]] = values[chosen]
    return (rest + minima[block])[: size - block * BLOCK].astype(np.uint32)


def write_tokens(documents: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token files in the shared folder and return them: (key, n_tokens, payload, __part).

    Texts are cut into ranges of the key and sorted; each task encodes its range in order. A null or empty text has
    ``end_id`` alone. Other columns are ignored, and repeated keys are separate documents.
    """
    kind = documents.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), T.StructField("payload", T.BinaryType())])
    end = np.array([end_id], np.uint32)

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Texts are encoded in large slices, which look up fewer words again; blocks are packed in small ones.
        with encoder(tokenizer) as encoded:
            for batch in bounded_slices(batches, "__text"):
                names, texts = batch.columns
                ids = [np.concatenate([x, end]) for x in encoded.encode_all(texts.to_pylist())]
                packed = [p for i in range(0, len(ids), PACKED_ROWS) for p in encode(ids[i : i + PACKED_ROWS])]
                sizes = pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([names, sizes, pa.array(packed, pa.binary())], schema.names)

    plain = documents.select(documents[key].alias("__key"), documents[text].cast("string").alias("__text"))
    ordered = plain.repartitionByRange("__key").sortWithinPartitions("__key")
    return stored(ordered.mapInArrow(payloads, schema).withColumn("__part", F.spark_partition_id()), "tokens")


def read_tokens(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of token files: (key, n_tokens, ids, __part), ids as little-endian 32-bit integers."""
    schema = T.StructType(
        [
            files.schema[key],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("__part", T.IntegerType()),
        ]
    )

    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in bounded_batches(batches, "payload"):
            found = decode(list(batch["payload"]))
            yield pd.DataFrame(
                {
                    key: batch[key].to_numpy(),
                    "n_tokens": [len(x) for x in found],
                    "ids": [x.astype("<u4").tobytes() for x in found],
                    "__part": batch["__part"].to_numpy(),
                }
            )

    return files.select(key, "payload", "__part").mapInPandas(ids, schema)
