"""Token ids of whole texts, as the tokenizers library gives them, with a bounded memo of pieces.

The two pre-tokenizers supported here never join characters across the white space in front of a word, so a text's
ids are the ids of its pieces in order. Pieces that come up again are looked up. A text for which that is not certain
(white space at the ends, in runs or outside ASCII; any other tokenizer) is encoded whole by the library.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from lethe.llm.common import BATCH_ROWS

#: Pieces remembered by one Python worker: half of them new ones, half those of the round before, which are asked next.
MEMO_PIECES = 900_000
#: White space by any definition, but space and line feed.
_SPACES = [9, 11, 12, 13, *range(28, 32), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
_OTHER_SPACE = re.compile(f"[{''.join(map(chr, _SPACES))}]")
_LETTERS = "A-Za-z" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_LATIN = re.compile(f"[!-~{_LETTERS}]+").fullmatch
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: How the two pre-tokenizers cut a piece of such characters into words of the model.
_LOWERED_PARTS = re.compile(f"{_ENDINGS}|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+").findall
_SPACED_PARTS = re.compile(f"{_ENDINGS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^ {_LETTERS}0-9]+").findall
#: A comma or full stop that stands alone between a word and a space is a part by itself.
_COMMA = re.compile(f",(?<=[{_LETTERS}0-9],)(?= )").sub
_STOP = re.compile(f"[.](?<=[{_LETTERS}0-9][.])(?= )").sub


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level models use for bytes: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


@contextmanager
def encoder(path: str) -> Iterator[Encoder]:
    """The encoder of a file, for one task. Tasks go round all idle workers of an executor, of which there can be more
    than cores: memory is given back at the end."""
    made = Encoder(path)
    try:
        yield made
    finally:
        made.forget()
        pa.default_memory_pool().release_unused()


def _raw(ids: list[int]) -> bytes:
    data = array("I", ids)
    if sys.byteorder != "little":
        data.byteswap()
    return data.tobytes()


FIRST = "\0"


class Encoder(dict):
    """Maps a piece to its ids as little-endian unsigned 32-bit integers; ``encode`` does a whole text, ``encode_all``
    the texts of a batch."""

    def __init__(self, path: str, memo: int = MEMO_PIECES) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._library, self._memo, self._before, self._batches = Tokenizer.from_file(path), memo // 2, {}, PieceTable(memo)
        before, normalizer = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        steps = [x["type"] for x in normalizer.get("normalizers", [])]
        splits = before.get("pretokenizers", [{}])
        self._spaced = not normalizer and before.get("type") == "ByteLevel" and before.get("use_regex") and not before["add_prefix_space"]
        self._lowered = steps == ["NFC", "Replace", "Lowercase"] and splits[0].get("behavior") == "Removed" and splits[-1]["type"] == "ByteLevel"
        letters = _byte_letters()
        self._letters = {b: letters[b] for b in range(256)}
        self._model = self._library.model
        self._bytes = [i.to_bytes(4, "little") for i in range(1 + max(self._library.get_vocab().values()))]
        self._parts = _LOWERED_PARTS if self._lowered else _SPACED_PARTS

    def forget(self) -> None:
        """Let go of all pieces."""
        self.clear()
        self._before, self._batches = {}, PieceTable(2 * self._memo)

    def _tokens(self, word: str) -> bytes:
        if not word.isascii():
            # Latin-1 characters stand for the bytes here, so that one translate() spells the whole word.
            word = word.encode().decode("latin-1").translate(self._letters)
        elif word[0] == " ":
            word = self._letters[32] + word[1:]
        return b"".join([self._bytes[t.id] for t in self._model.tokenize(word)])

    def _whole(self, text: str) -> bytes:
        return _raw(self._library.encode(text, add_special_tokens=False).ids)

    def _ids(self, piece: str) -> bytes:
        # A piece without a space in front of it carries a mark.
        first = piece[:1] == FIRST
        word = piece[1:] if first else piece
        if not word:
            return b""
        if self._spaced and word.isalpha() and max(word) <= "\xff":
            return self._tokens(word if first else " " + word)
        if not _LATIN(word):
            return self._whole(word if first or self._lowered or word[0] == "\n" else " " + word)
        # Latin letters, digits and ASCII signs need no normalizer but lower case. Parts are looked up by themselves.
        if self._lowered:
            word = word.lower()
            parts = self._parts(word)
            return self._tokens(word) if parts == [piece] else b"".join([self[x] for x in parts])
        parts = self._parts(word if first else " " + word)
        if len(parts) == 1:
            return self._tokens(parts[0])
        return b"".join([self[x[1:] if x[0] == " " else FIRST + x] for x in parts])

    def __missing__(self, piece: str) -> bytes:
        ids = self._before.get(piece)
        if ids is None:
            ids = self._ids(piece)
        if len(self) >= self._memo:
            self._before = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def _apart(self, text: str) -> str | None:
        """The text with one space between its pieces; nothing where only the library knows its pieces."""
        if not (self._spaced or self._lowered) or _OTHER_SPACE.search(text) or "<|" in text or FIRST in text:
            return None
        if self._lowered:
            return text.replace("\n", " ")
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return None
        text = FIRST + text.replace("\n", f" \n {FIRST}")
        return _STOP(f" {FIRST}.", _COMMA(f" {FIRST},", text))

    def encode(self, text: str | None) -> bytes:
        """The ids of the text, without special tokens; none for a null or empty text."""
        if not text:
            return b""
        apart = self._apart(text)
        return self._whole(text) if apart is None else b"".join(map(self.__getitem__, apart.split(None if self._lowered else " ")))

    def encode_all(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text, like ``encode``. A piece is looked up once, however often the texts have it."""
        texts = [t or "" for t in texts]
        apart = [t and self._apart(t) for t in texts]
        cut = pc.split_pattern(pa.array([t or "" for t in apart], pa.large_string()), " ")
        pieces = cut.values.dictionary_encode()
        places = self._batches.places(pieces.dictionary, self._ids)[pieces.indices.to_numpy()]
        out = []
        for i in range(0, len(texts), BATCH_ROWS):
            bounds = cut.offsets.to_numpy()[i : i + BATCH_ROWS + 1]
            ids, ends = self._batches.ids(places[bounds[0] : bounds[-1]])
            ends = ends[bounds - bounds[0]]
            out += [ids[x:y] if a is not None else np.frombuffer(self._whole(t), "<u4") for t, a, x, y in zip(texts[i:], apart[i:], ends, ends[1:])]
        return out


class PieceTable:
    """A memo for batches of texts: pieces and their ids in Arrow and NumPy arrays. Beyond ``memo`` pieces, only those
    used last stay, half as many."""

    def __init__(self, memo: int) -> None:
        self._memo, self._round = memo, 0
        self._pieces, self._used = pa.array([], pa.large_string()), np.zeros(0, np.int64)
        self._flat, self._starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at these places, one after the other, and where those of each place begin and end."""
        first = self._starts[places]
        counts = self._starts[1:][places] - first
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(first - ends[:-1], counts)
        at += np.arange(len(at))
        return self._flat[at], ends

    def places(self, pieces: pa.Array, ids_of: Callable[[str], bytes]) -> np.ndarray:
        """The places of some distinct pieces, good until the next call; ``ids_of`` is asked for new ones."""
        if len(self._pieces) > self._memo:
            keep = np.sort(np.argsort(self._used, kind="stable")[-(self._memo // 2) :])
            self._flat, self._starts = self.ids(keep)
            self._pieces, self._used = self._pieces.take(pa.array(keep)), self._used[keep]
        found = pc.index_in(pieces, value_set=self._pieces)
        places, missed = found.fill_null(0).to_numpy().astype(np.int64), found.is_null()
        new = pieces.filter(missed)
        ids = [ids_of(piece) for piece in new.to_numpy(zero_copy_only=False)]
        places[missed.to_numpy(zero_copy_only=False)] = len(self._pieces) + np.arange(len(ids))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self._pieces = pa.concat_arrays([self._pieces, new])
        self._flat = np.concatenate([self._flat, np.frombuffer(b"".join(ids), "<u4")])
        self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(sizes)])
        self._round += 1
        self._used = np.concatenate([self._used, np.zeros(len(ids), np.int64)])
        self._used[places] = self._round
        return places
