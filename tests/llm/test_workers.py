"""What Python workers hold, during a task and after it."""

import pyarrow as pa
import pytest

from lethe.llm import common
from lethe.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY
from lethe.llm.tokens import encoder


@pytest.mark.parametrize("path", [WORD_VOCABULARY, BYTE_VOCABULARY])
def test_an_encoder_keeps_no_pieces_after_its_task(path):
    texts = ["some words, some more", None, "", "words again.\nand 12 signs"]
    for _ in range(2):
        with encoder(path) as made:
            found = [x.tobytes() for x in made.encode_all(texts)]
            assert found == [made.encode(t) for t in texts]
            assert len(made) and len(made._batches._pieces)
        assert not made and not made._before and not len(made._batches._pieces)


def test_slices_are_bounded_and_lose_no_row(monkeypatch):
    monkeypatch.setattr(common, "SLICE_ROWS", 3)
    monkeypatch.setattr(common, "SLICE_CHARS", 10)
    texts = ["é" * 4, None, "b" * 6, "c", "d" * 50, "", None, "e", "f"]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}), pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())})]
    slices = [s["text"].to_pylist() for s in common.bounded_slices(batches)]
    assert sum(slices, []) == texts
    assert all(len(s) <= 3 and sum(len(t or "") for t in s[1:]) <= 10 for s in slices)
    assert slices[0] == texts[:3]
