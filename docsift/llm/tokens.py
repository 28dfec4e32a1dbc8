"""Encoding with the files of public tokenizers, each chunk of text that a worker meets again only once.

A text is cut where no match of the tokenizer's pattern can cross, so that its ids are those of its chunks in a row. A
chunk of plain characters is divided further, into the pattern's matches, which the tokenizer's model turns into ids;
chunks with any other character go through the whole tokenizer.
"""

from __future__ import annotations

import gc
import os
import re
from abc import ABC, abstractmethod
from collections import defaultdict
from functools import cache
from itertools import chain, islice

import numpy as np
from tokenizers import Tokenizer

from docsift.llm.common import keep_for_tasks, ragged_positions

# A worker forgets its chunks when it knows more than this, so that its memory stays bounded.
MAX_CHUNKS = 700_000
# Texts are encoded in groups of about so many characters.
GROUP_CHARS = 1 << 20


# Letters beyond ASCII that are their own composed form, with a lower case of one letter.
_LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"


def _byte_level_alphabet() -> dict[int, str]:
    """Bytes that byte-level models write as another character: all but the visible ones, from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {byte: chr(0x100 + place) for place, byte in enumerate(b for b in range(256) if b not in visible)}


_ALPHABET = _byte_level_alphabet()


def _written(piece: str) -> str:
    """A piece in the characters of byte-level models."""
    if piece.isascii():
        if piece.isprintable() and " " not in piece:
            return piece
        if piece[0] == " " and piece[1:].isalnum():
            return _ALPHABET[0x20] + piece[1:]
    return piece.encode().decode("latin-1").translate(_ALPHABET)


class ChunkEncoder(ABC):
    """Ids of texts by a ``tokenizers`` file, without special tokens added."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.most_chunks = MAX_CHUNKS
        self._forget()
        keep_for_tasks(self._forget)

    # Chunks of plain characters, and the pattern's matches in them.
    plain: re.Pattern
    matches: re.Pattern
    # Plain signs that are a match of their own behind a word, if nothing comes after them.
    MARKS = frozenset("!\"#$%&'()*+,-./:;=?@[\\]^_`{|}~0123456789")

    def _forget(self) -> None:
        if hasattr(self, "codes"):
            self.codes.default_factory = None  # or it would stay until a search for cycles finds it
        self.codes: defaultdict = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.pieces: dict[str, list[int]] = {}
        self.ids = np.zeros(0, dtype=np.uint32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)

    @abstractmethod
    def chunks(self, text: str) -> list | None:
        """The text's chunks, as keys; None if it must be encoded as a whole."""

    @abstractmethod
    def chunk_text(self, key) -> str:
        """What a key stands for."""

    def prepared(self, text: str) -> str:
        """A plain chunk as the tokenizer's normaliser leaves it."""
        return text

    def _plain_ids(self, texts: list[str]) -> list[list[int] | None]:
        """The ids of each chunk of plain characters; None for others."""
        pieces, prepared, learned = self.pieces, self.prepared, self._piece_ids
        fullmatch, findall, marks = self.plain.fullmatch, self.matches.findall, self.MARKS
        found: list[list[int] | None] = []
        for text in texts:
            if text.isascii():
                letters = text[1:] if text[:1] == " " else text
                if letters.isalpha():  # all of it is one match
                    piece = prepared(text)
                    found.append(pieces.get(piece) or learned(piece))
                    continue
                if text[-1:] in marks and letters[:-1].isalpha():  # a word and a sign behind it: two matches
                    word, mark = prepared(text[:-1]), text[-1]
                    found.append((pieces.get(word) or learned(word)) + (pieces.get(mark) or learned(mark)))
                    continue
            if not fullmatch(text):
                found.append(None)
                continue
            ids: list[int] = []
            for piece in findall(prepared(text)):
                ids += pieces.get(piece) or learned(piece)
            found.append(ids)
        return found

    def _piece_ids(self, piece: str) -> list[int]:
        known = self.pieces[piece] = [token.id for token in self.model.tokenize(_written(piece))]
        return known

    def _learn(self, keys: list) -> None:
        texts = list(map(self.chunk_text, keys))
        found = self._plain_ids(texts)
        others = [place for place, ids in enumerate(found) if ids is None]
        encodings = self.tokenizer.encode_batch_fast([texts[place] for place in others], add_special_tokens=False)
        for place, encoding in zip(others, encodings, strict=True):
            found[place] = encoding.ids
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(lengths.sum()))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, flat])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def group(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.codes) > self.most_chunks:
            self._forget()
        codes, known, coded = self.codes, len(self.codes), []
        for text in texts:
            keys = self.chunks(text)
            coded.append(
                None if keys is None
                else np.fromiter(map(codes.__getitem__, keys), dtype=np.int64, count=len(keys))
            )
        if len(codes) > known:
            self._learn(list(islice(codes, known, None)))
        return [
            self.whole(text) if places is None
            else self.ids[ragged_positions(self.starts[places], self.lengths[places])]
            for text, places in zip(texts, coded, strict=True)
        ]

    def encode(self, texts: list[str]):
        """The ids of each text, in order."""
        start = 0
        # The many small lists kept here hold no cycles; looking for some would take a large part of the time.
        collecting = gc.isenabled()
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size < GROUP_CHARS):
                size += len(texts[end])
                end += 1
            gc.disable()
            try:
                found = self.group(texts[start:end])
            finally:
                if collecting:
                    gc.enable()
            yield from found
            start = end


class WordEndEncoder(ChunkEncoder):
    """For tokenizers that lower-case and whose pattern drops white space: cut at ASCII white space."""

    # Angle brackets could be part of a special token.
    plain = re.compile(f"[!-;=?-~{_LETTERS}]*")
    matches = re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9]|[^a-z0-9{_LETTERS}]+"
    )

    def prepared(self, text: str) -> str:
        return text.lower()

    def chunks(self, text: str) -> list[bytes]:
        return text.encode().split()

    def chunk_text(self, key: bytes) -> str:
        return key.decode()


class ByteLevelEncoder(ChunkEncoder):
    """For the byte-level pattern: cut before single spaces, which begin a match of their own.

    A space after other white space belongs to a run that the pattern divides by what follows it, so texts that hold
    one are encoded as a whole.
    """

    plain = re.compile(f"[\n -;=?-~{_LETTERS}]*")
    matches = re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{_LETTERS}]+| ?[0-9]+| ?[^\n A-Za-z0-9{_LETTERS}]+"
        r"|[\n ]+(?![^\n ])|[\n ]+"
    )
    FIRST = "\ud800"  # marks a text's first chunk, which has no space before it; no text holds this
    RUN = re.compile(r"\s ")

    def chunks(self, text: str) -> list[str] | None:
        if self.RUN.search(text):
            return None
        parts = text.split(" ")
        parts[0] = self.FIRST + parts[0]
        return parts

    def chunk_text(self, key: str) -> str:
        return key[1:] if key[:1] == self.FIRST else " " + key


@cache
def word_end_encoder(path: str) -> WordEndEncoder:
    return WordEndEncoder(path)


@cache
def byte_level_encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)
