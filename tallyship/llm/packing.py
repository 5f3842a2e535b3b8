"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Only lengths matter for where a document goes, so the plan is made from the number of
pieces of each length, a table with one row per length at most. A bin is filled
greedily with the longest pieces that fit; then its smallest piece is replaced with
two unpacked ones if these fill the expanded gap more tightly. The bin is repeated as
often as the counts allow. Pieces get their places by their rank among those of equal
length, which is counted over the cluster, so no task needs all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyship.llm.blocks import blocks
from tallyship.llm.shared import stored
from tallyship.llm.tokens import ENCODED_BYTES, text_encoder, with_end

#: Tokens of a sequence.
CAPACITY = 2048

#: Groups into which pieces are dealt for ranking, and the fewest and most pieces that a group is to have.
GROUPS, LEAST_GROUP, MOST_GROUP = 4096, 256, 1 << 17

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _cutting(tokenizer: str, end: int, capacity: int, with_ids: bool, added: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer, added)
        for block in blocks(batches, limit=ENCODED_BYTES):
            ids, offsets = with_end(*encoder.encode(block.data, block.offsets), end)
            total = np.diff(offsets)
            pieces = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            short = total - (pieces - 1) * capacity  # the first piece takes what is over
            start = np.where(number == 0, 0, short[row] + (number - 1) * capacity)
            length = np.where(number == 0, short[row], capacity)
            at = offsets[row] + start
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [block.rows.column("doc_id").take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, offsets[-1]), pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut


def cut_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, added: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, and ids if asked for; ``added`` as in ``TextEncoder``.

    A document is its text's ids and then ``end``; a null text counts as empty. Only
    one of more than ``capacity`` ids is cut, into whole sequences after a first piece
    that may be shorter.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_cutting(tokenizer, end, capacity, with_ids, added), PIECES + ", ids array<int>" * with_ids)


def plan_bins(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins for ``counts[n]`` pieces of length n; the capacity is the last index.

    Returns (pieces, times): pieces are (length, number of them), longest first.
    """
    capacity, left, bins = len(counts) - 1, counts.astype(np.int64).copy(), []

    def longest(limit: int) -> int:
        """The greatest length up to ``limit`` of which a piece is left, or 0."""
        there = np.flatnonzero(left[1 : limit + 1])
        return int(there[-1]) + 1 if len(there) else 0

    while (n := longest(capacity)) > 0:
        used: dict[int, int] = {}
        gap = capacity
        while gap and (n := longest(gap)):
            take = int(min(left[n], gap // n))
            used[n] = take
            left[n] -= take
            gap -= take * n
        while gap and used:
            smallest = min(used)
            room = gap + smallest
            there = np.flatnonzero(left[1:room]) + 1
            partner = room - there  # the most that fits beside each
            best_at = np.searchsorted(there, partner, "right") - 1
            fits = best_at >= 0
            second = np.where(fits, there[np.maximum(best_at, 0)], 0)
            alone = fits & (second == there) & (left[there] < 2)  # two of a length of which one is left
            second = np.where(alone, np.where(best_at > 0, there[np.maximum(best_at - 1, 0)], 0), second)
            both = np.where(second > 0, there + second, 0)
            if not len(both) or (pick := int(np.argmax(both)), int(both[pick]))[1] <= smallest:
                break
            used[smallest] -= 1
            left[smallest] += 1
            if not used[smallest]:
                del used[smallest]
            for n in (int(there[pick]), int(second[pick])):
                used[n] = used.get(n, 0) + 1
                left[n] -= 1
            gap = room - int(both[pick])
        times = 1 + min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * (times - 1)
        bins.append((sorted(used.items(), reverse=True), times))
    return bins


def slots(bins: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """The bins as intervals of ranks: pieces of ``length`` from rank ``rank`` on go to sequences from ``sequence`` on, at ``offset``."""
    rows, taken, first = [], {}, 0
    for pieces, times in bins:
        offset = 0
        for n, k in pieces:
            for _ in range(k):
                rows.append((n, taken.get(n, 0), first, offset))
                taken[n] = taken.get(n, 0) + times
                offset += n
        first += times
    rows.sort()
    return {c: np.array(x, np.int64) for c, x in zip(("length", "rank", "sequence", "offset"), zip(*rows, strict=True) if rows else [()] * 4, strict=True)}


def _placing(plan: dict[str, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan["length"] * 2**48 + plan["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length * 2**48 + rank, "right") - 1
            rest = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            more = [pa.array(plan["sequence"][at] + rank - plan["rank"][at]), pa.array(plan["offset"][at])]
            yield pa.RecordBatch.from_arrays(rest + more, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def _salts(counts: np.ndarray) -> list[int]:
    """For each length, over how many groups its pieces are spread: as many as their number asks for, so that no group grows with the input."""
    group = min(max(int(counts.sum()) // GROUPS, LEAST_GROUP), MOST_GROUP)
    return [max(1, -(-int(n) // group)) for n in counts]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places pieces (as ``cut_pieces`` gives them) in sequences: adds sequence_id and offset.

    Offsets leave no gaps from 0 on, and no sequence holds more than ``capacity``.
    Every piece is placed, repeated rows each for themselves; pieces that are equal in
    every column may change places. No pieces give no rows.

    The driver holds the number of pieces of each length (``capacity`` numbers) and
    the plan made from them; its size depends on the capacity alone. A length of many
    pieces is ranked in as many groups as it needs, by a hash of the piece.
    """
    held = stored(pieces, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row.length] = row.n
    spread = F.element_at(F.lit(_salts(counts)).cast("array<bigint>"), (F.col("length") + 1).cast("int"))
    salted = held.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), spread))
    shares = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))  # a row for each group
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = shares.select("length", "salt", before.alias("base"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("local", local).join(bases, ["length", "salt"]).withColumn("rank", (F.col("base") + F.col("local")).cast("bigint"))
    schema = PIECES + ", sequence_id bigint, offset bigint"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placing(slots(plan_bins(counts))), schema)


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Where every piece of every document goes; see ``cut_pieces`` and ``pack``.

    A null or empty text is one piece, the end id alone. Repeated rows are each placed;
    a text of any length is cut whole; no rows give no rows. Only the two columns are
    read, so other columns may have any names.
    """
    return pack(cut_pieces(docs, tokenizer, end, capacity, id_col, text_col, added=added), capacity)


def sequences(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids. ``pieces`` has ids (``cut_pieces`` with ``with_ids``)."""
    full = placed.join(pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "start", "length", "ids_crc32"]), ["doc_id", "piece", "start", "length", "ids_crc32"])
    ordered = full.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return ordered.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
