"""Byte-level BPE by merge replay over a corpus of words.

The words of a block of texts are laid out as one chain of symbols. An inverted index
goes from the rank of a pair (that of the token which its bytes make together) to the
places where such a pair stands. Ranks are replayed in order: all places of a rank are
merged at once, and only the pairs with the merged symbols' neighbours are looked up
and indexed anew. Distinct words are replayed once, and workers remember them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyship.llm.blocks import blocks, prefix, worker_keeps
from tallyship.llm.tokens import ChunkEncoder

#: Bytes of text whose words are replayed together.
REPLAY_BYTES = 24 << 20


class Vocabulary:
    """Ranks of byte strings, as in a file of base64 tokens and ranks; a token's id is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in file if line.strip())}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = prefix(self.lengths)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.made = np.array([*(pairs[k] for k in keys.tolist()), -1], np.int64)
        self.decimal = np.array([f"{i} " for i in range(size)], f"S{len(str(size)) + 1}")

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's joined bytes, -1 where they are no token."""
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids' tokens, joined."""
        length = self.lengths[ids]
        at = prefix(length)
        return self.bytes[np.repeat(self.starts[ids] - at[:-1], length) + np.arange(at[-1])]

    def merge_one(self, word: bytes) -> list[int]:
        """A single word, merging its lowest pair, leftmost first, until there is none."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]


def replay(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and how many each has."""
    offsets = prefix(np.fromiter(map(len, words), np.int64, len(words)))
    n = int(offsets[-1])
    if not n:
        return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
    symbol = vocabulary.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    following, preceding = np.arange(1, n + 1), np.arange(-1, n - 1)
    filled = offsets[:-1][np.diff(offsets) > 0]
    preceding[filled] = -1
    following[np.append(filled[1:], n) - 1] = -1
    alive = np.ones(n, bool)
    rank = np.full(n, -1, np.int64)  # of the pair that begins at each place
    paired = np.flatnonzero(following >= 0)
    rank[paired] = vocabulary.pair_ranks(symbol[paired], symbol[paired + 1])

    index: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def enter(places: np.ndarray, ranks: np.ndarray) -> None:
        if len(places) == 1:
            groups = [(int(ranks[0]), places)]
        else:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            edges = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            groups = zip(ranks[np.append(0, edges)].tolist(), np.split(places, edges), strict=True)
        for r, at in groups:
            if (held := index.get(r)) is None:
                index[r] = [at]
                heapq.heappush(waiting, r)
            else:
                held.append(at)

    there = np.flatnonzero(rank >= 0)
    if len(there):
        enter(there, rank[there])
    inverted: list[np.ndarray] = []
    while waiting:
        r = heapq.heappop(waiting)
        held = index.pop(r)
        at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
        at = at[rank[at] == r]  # others have been merged away meanwhile
        if not len(at):
            continue
        if len(at) > 1 and (linked := following[at[:-1]] == at[1:]).any():  # overlapping pairs: every other one, from the left
            step = np.arange(len(at))
            begin = np.maximum.accumulate(np.where(np.append(True, ~linked), step, 0))
            at = at[(step - begin) % 2 == 0]
        gone = following[at]
        after = following[gone]
        beside = np.flatnonzero(after[:-1] == at[1:])  # pairs next to each other: the left one, merged alone, has a symbol of the right one beside it
        if len(beside):
            between = vocabulary.pair_ranks(np.full(len(beside), r), symbol[at[beside + 1]])
            if ((between >= 0) & (between < r)).any():
                inverted.append(at[beside[(between >= 0) & (between < r)]])
        symbol[at] = r
        following[at] = after
        alive[gone] = False
        rank[gone] = -1
        preceding[after[after >= 0]] = at[after >= 0]
        before = preceding[at]
        touched = np.concatenate([at, before[before >= 0]])
        right = following[touched]
        made = np.where(right >= 0, vocabulary.pair_ranks(symbol[touched], symbol[right]), -1)
        rank[touched] = made
        new = made >= 0
        if new.any():
            touched, made = touched[new], made[new]
            if (made < r).any():
                inverted.append(touched[made < r])
            enter(touched, made)

    kept = prefix(alive)
    ids, lengths = symbol[alive].astype(np.uint32), kept[offsets[1:]] - kept[offsets[:-1]]
    if inverted:  # a merge made a pair of lower rank, so the order inside these words is settled word by word
        redo = np.unique(np.searchsorted(offsets, np.concatenate(inverted), "right") - 1)
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        for w in redo.tolist():
            parts[w] = np.array(vocabulary.merge_one(words[w]), np.uint32)
            lengths[w] = len(parts[w])
        ids = np.concatenate(parts)
    return ids, lengths


class ReplayEncoder(ChunkEncoder):
    """Ids of texts by merge replay over the distinct words of their new chunks."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.vocabulary, self.pattern = Vocabulary(path), regex.compile(pattern)

    def new_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        words, counts = [], []
        for chunk in chunks:
            if chunk.isalpha() or (chunk[:1] == " " and chunk[1:].isalpha()):  # one word of letters
                words.append(number.setdefault(chunk, len(number)))
                counts.append(1)
                continue
            found = self.pattern.findall(chunk)
            words += [number.setdefault(w, len(number)) for w in found]
            counts.append(len(found))
        ids, lengths = replay(self.vocabulary, [w.encode() for w in number])
        each = np.array(words, np.int64)
        begin, n = prefix(lengths)[each], lengths[each]
        at = prefix(n)
        out = ids[np.repeat(begin - at[:-1], n) + np.arange(at[-1])]
        edges = prefix(np.array(counts, np.int64))
        return out, at[edges[1:]] - at[edges[:-1]]


def replay_encoder(path: str, pattern: str) -> ReplayEncoder:
    """A worker's encoder for a rank file; it stays for the worker's next tasks of this kind."""
    return worker_keeps(("replay encoder", path, pattern), lambda: ReplayEncoder(path, pattern))


_Map = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _encoding(path: str, pattern: str) -> _Map:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = replay_encoder(path, pattern)
        for block in blocks(batches, limit=REPLAY_BYTES):
            ids, offsets = encoder.encode(block.data, block.offsets)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([block.rows.column("doc_id"), lists], names=["doc_id", "ids"])

    return encode


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, an array of ints, of every whole text.

    Each match of ``pattern`` is encoded by itself, without special tokens. A null
    text counts as empty and has no ids. Repeated rows are each encoded; no rows give
    no rows. Only the two columns are read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_encoding(path, pattern), "doc_id bigint, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of ``bpe_encode``'s rows; null ids count as none."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = replay_encoder(path, pattern).vocabulary
        for batch in batches:
            texts = [vocabulary.decode(np.array(ids or [], np.int64)).tobytes() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, decoded binary")


def _digesting(path: str, pattern: str) -> _Map:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = replay_encoder(path, pattern)
        vocabulary = encoder.vocabulary
        for block in blocks(batches, limit=REPLAY_BYTES):
            ids, offsets = encoder.encode(block.data, block.offsets)
            said, read = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = ids[a:b]
                octets = vocabulary.decimal[own].view(np.uint8)
                said.append(hashlib.sha256(octets[octets != 0].tobytes()[:-1]).hexdigest())
                read.append(hashlib.sha256(vocabulary.decode(own)).hexdigest())
            columns = [block.rows.column("doc_id"), pa.array(np.diff(offsets)), pa.array(said), pa.array(read)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, decodes its ids again, and gives doc_id, n_tokens, ids_sha256 and decoded_sha256, in one pass."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_digesting(path, pattern), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
