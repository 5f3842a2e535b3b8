"""Encoding whole texts, each distinct chunk of text once.

A byte-level tokenizer with the usual splitting pattern never joins characters over
certain places: where a blank follows a non-blank, and where ASCII letters and other
ASCII marks than the apostrophe meet. Texts are cut there, and only distinct chunks are
encoded. Texts with blanks or separators beyond ASCII, for which the
first rule does not hold, are one chunk each; so are texts that contain an added
token, where these are not read as plain text.
"""

from __future__ import annotations

import os

import numpy as np

from tallyship.llm.blocks import prefix, strings, worker_keeps

_BLANK, _MARK, _LETTER = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = _MARK
_KIND[[c for c in range(128) if chr(c).isalpha()]] = _LETTER

#: Chunks of more bytes are not remembered, and a worker remembers this many of the others at most.
CHUNK_BYTES, CHUNKS = 48, 600_000

#: Bytes of text that are encoded together: more find more chunks that they share.
ENCODED_BYTES = 4 << 20


def _odd_blanks(data: np.ndarray) -> np.ndarray:
    """Places of blanks and separators beyond ASCII white space."""
    if not len(data):
        return np.zeros(0, np.int64)
    at = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
    pad = np.concatenate([data, np.zeros(2, np.uint8)])
    for lead, seconds in ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A, 0xA0)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        first = np.flatnonzero(data == lead)
        first = first[np.isin(pad[first + 1], seconds)]
        if lead == 0xE2:
            third = pad[first + 2]
            first = first[(third <= 0x8A) | np.isin(third, (0xA8, 0xA9, 0xAF, 0x9F))]
        at.append(first)
    return np.concatenate(at)


def _places(data: np.ndarray, strings: tuple[bytes, ...]) -> np.ndarray:
    """Where any of the strings begins."""
    raw, at = data.tobytes() if strings else b"", []
    for s in strings:
        found = raw.find(s)
        while found >= 0:
            at.append(found)
            found = raw.find(s, found + 1)
    return np.array(at, np.int64)


def cuts(data: np.ndarray, offsets: np.ndarray, added: tuple[bytes, ...] = ()) -> np.ndarray:
    """Offsets of chunks that can be split into tokens one by one; every text's edges are among them, and one with a string of ``added`` is not cut."""
    kind = _KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    before, after = kind[:-1], kind[1:]
    cut[1:-1] = ((after == _BLANK) & (before != _BLANK)) | (before + after == _MARK + _LETTER) & (before != after)
    for text in np.unique(np.searchsorted(offsets, np.concatenate([_odd_blanks(data), _places(data, added)]), "right") - 1):
        cut[offsets[text] : offsets[text + 1]] = False
    cut[offsets] = True
    return np.flatnonzero(cut)


class ChunkEncoder:
    """Ids of texts from the ids of their distinct chunks; ``new_chunks`` encodes those not yet known."""

    added: tuple[bytes, ...] = ()

    def __init__(self):
        self._forget()

    def new_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after another, and how many each has."""
        raise NotImplementedError

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.stops = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.n_ids = self.n_chunks = 0

    def _append(self, texts: list[str]) -> np.ndarray:
        """Encodes texts and returns their numbers in the store."""
        ids, lengths = self.new_chunks(texts)
        total, chunks = self.n_ids + len(ids), self.n_chunks + len(texts)
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.zeros(max(total, len(self.ids)), np.uint32)])
        if chunks + 1 > len(self.stops):
            self.stops = np.concatenate([self.stops[: self.n_chunks + 1], np.zeros(max(chunks, len(self.stops)), np.int64)])
        self.ids[self.n_ids : total] = ids
        self.stops[self.n_chunks + 1 : chunks + 1] = self.n_ids + np.cumsum(lengths)
        numbers = np.arange(self.n_chunks, chunks)
        self.n_ids, self.n_chunks = total, chunks
        return numbers

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts as one array, and its offsets by text."""
        if self.n_chunks > CHUNKS:
            self._forget()
        bounds = cuts(data, offsets, self.added)
        if len(bounds) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        coded = strings(data, bounds).dictionary_encode()
        chunks = coded.dictionary.cast("large_string").to_pylist()
        numbers = np.fromiter((self.known.get(c, -1) for c in chunks), np.int64, len(chunks))
        kept_ids, kept_chunks = self.n_ids, self.n_chunks
        fresh = np.flatnonzero(numbers < 0)
        short = np.array([len(chunks[i]) <= CHUNK_BYTES for i in fresh], bool)
        if len(fresh):
            remember = fresh[short]
            numbers[remember] = self._append([chunks[i] for i in remember])
            self.known.update((chunks[i], n) for i, n in zip(remember, numbers[remember].tolist(), strict=True))
            kept_ids, kept_chunks = self.n_ids, self.n_chunks
            numbers[fresh[~short]] = self._append([chunks[i] for i in fresh[~short]])
        each = numbers[coded.indices.to_numpy(zero_copy_only=False)]
        begin = self.stops[each]
        length = self.stops[each + 1] - begin
        at = prefix(length)
        ids = self.ids[np.repeat(begin - at[:-1], length) + np.arange(at[-1])]
        self.n_ids, self.n_chunks = kept_ids, kept_chunks  # long chunks go again
        return ids, at[np.searchsorted(bounds, offsets)]


class TextEncoder(ChunkEncoder):
    """Equal to the tokenizers library's ``encode`` with ``add_special_tokens=False``.

    Special strings are plain text, or the library's default for ``added``: then a
    text's added tokens get their own ids.
    """

    def __init__(self, path: str, added: bool = False):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        if added:
            self.added = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content)

    def new_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter((i for ids in encoded for i in ids), np.uint32, int(lengths.sum())), lengths


def text_encoder(path: str, added: bool = False) -> TextEncoder:
    """A worker's encoder for a tokenizer file; it stays for the worker's next tasks of this kind."""
    return worker_keeps(("text encoder", path, added), lambda: TextEncoder(path, added))


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` after each text."""
    return np.insert(ids, offsets[1:], np.uint32(end)), offsets + np.arange(len(offsets))
