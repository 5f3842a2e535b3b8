"""Token ids in binary files: fixed-size blocks in byte or bit planes, each compressed.

A file holds, one after another: a magic word; the planes of each chunk, compressed
with zstandard; the chunk index and the documents' ids and lengths, as Arrow IPC;
eight bytes with the index's length; and the magic word again. A chunk has a fixed
number of ids but for the last. Its ids are transposed, so that plane p has byte (or
bit) p of every id: high planes are nearly constant and cost almost nothing. A reader
takes the index from the file's end and reads only the chunks that it needs.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyship.llm.blocks import blocks
from tallyship.llm.shared import shared_dir, stored
from tallyship.llm.tokens import ENCODED_BYTES, text_encoder, with_end

#: Fixed values of the format.
MAGIC, CHUNK_IDS = b"TSPLANE1", 1 << 16
_INDEX = pa.schema([("first_id", pa.int64()), ("n_ids", pa.int64()), ("at", pa.list_(pa.int64())), ("size", pa.list_(pa.int64()))])
_DOCS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Planes of unsigned 32-bit ids, lowest first: 4 of bytes or 32 of bits."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [octets[:, p].tobytes() for p in range(4)]
    single = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(single[:, p], bitorder="little").tobytes() for p in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The inverse of ``to_planes`` for n ids; the number of planes tells their kind."""
    if len(planes) == 4:
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        single = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        octets = np.packbits(single, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").ravel()


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class PlaneWriter:
    """Writes one file; ids are given document by document and leave memory chunk by chunk."""

    def __init__(self, file, bits: bool = False, chunk_ids: int = CHUNK_IDS, level: int = 3):
        self.file, self.bits, self.chunk_ids = file, bits, chunk_ids
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.chunks: list[tuple[int, int, list[int], list[int]]] = []
        self.docs: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.at = self._put(MAGIC)

    def _put(self, data: bytes, at: int = 0) -> int:
        self.file.write(data)
        return at + len(data)

    def add(self, ids: np.ndarray, doc_ids: pa.Array, lengths: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.lengths.append(lengths)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.chunk_ids:
            joined = np.concatenate(self.waiting)
            whole = len(joined) - len(joined) % self.chunk_ids
            for i in range(0, whole, self.chunk_ids):
                self._chunk(joined[i : i + self.chunk_ids])
            self.waiting, self.n_waiting = [joined[whole:]], len(joined) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        places, sizes = [], []
        for plane in to_planes(ids, self.bits):
            packed = self.pack(plane)
            places.append(self.at)
            sizes.append(len(packed))
            self.at = self._put(packed, self.at)
        self.chunks.append((self.n_ids, len(ids), places, sizes))
        self.n_ids += len(ids)

    def close(self) -> tuple[int, int]:
        """Writes the rest and the index; returns the numbers of documents and ids."""
        if self.n_waiting:
            self._chunk(np.concatenate(self.waiting))
        columns = [pa.array(list(c), t.type) for c, t in zip(zip(*self.chunks, strict=True), _INDEX, strict=True)] if self.chunks else [pa.array([], t.type) for t in _INDEX]
        docs = pa.concat_arrays(self.docs) if self.docs else pa.array([], pa.int64())
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0, np.int64)
        parts = [_ipc(pa.RecordBatch.from_arrays(columns, schema=_INDEX)), _ipc(pa.RecordBatch.from_arrays([docs, pa.array(lengths, pa.int64())], schema=_DOCS))]
        for part in parts:
            self._put(part)
        self._put(np.array([len(p) for p in parts], "<u8").tobytes() + MAGIC)
        return len(docs), self.n_ids


class PlaneReader:
    """Reads one file: its index at once, ids as they are asked for."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = file.read_at(16 + len(MAGIC), size - 16 - len(MAGIC))
        if tail[16:] != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a file of id planes")
        n_index, n_docs = np.frombuffer(tail[:16], "<u8").tolist()
        read = file.read_at(n_index + n_docs, size - 16 - len(MAGIC) - n_index - n_docs)
        self.chunks = pa.ipc.open_stream(read[:n_index]).read_all().to_pylist()
        self.docs = pa.ipc.open_stream(read[n_index:]).read_all()
        self.unpack = zstandard.ZstdDecompressor().decompress

    def chunk(self, number: int) -> np.ndarray:
        c = self.chunks[number]
        return from_planes([self.unpack(self.file.read_at(n, at)) for at, n in zip(c["at"], c["size"], strict=True)], c["n_ids"])

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids first to first + n - 1, from the chunks that have them only."""
        if not n:
            return np.zeros(0, np.uint32)
        starts = [c["first_id"] for c in self.chunks]
        low, high = (int(np.searchsorted(starts, x, "right")) - 1 for x in (first, first + n - 1))
        joined = np.concatenate([self.chunk(i) for i in range(low, high + 1)])
        return joined[first - starts[low] :][:n]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """doc_id and ids of every document in turn, holding a chunk and a document at most."""
        number, rest = 0, np.zeros(0, np.uint32)
        for batch in self.docs.to_batches(4096):
            for doc, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts, have = [rest], len(rest)
                while have < n:
                    parts.append(self.chunk(number))
                    number, have = number + 1, have + len(parts[-1])
                joined = parts[0] if len(parts) == 1 else np.concatenate(parts)
                yield doc, joined[:n]
                rest = joined[n:]


def _open(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def _writing(tokenizer: str, end: int, folder: str, bits: bool, added: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = text_encoder(tokenizer, added), TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}.planes"
        fs, name = _open(path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        draft = f"{name}.{uuid.uuid4().hex}.draft"  # a task that is run again writes its own, and the whole file takes the name
        with fs.open_output_stream(draft) as file:
            writer = PlaneWriter(file, bits)
            for block in blocks(batches, limit=ENCODED_BYTES):
                ids, offsets = with_end(*encoder.encode(block.data, block.offsets), end)
                writer.add(ids, block.rows.column("doc_id"), np.diff(offsets))
            n_docs, n_ids = writer.close()
        if n_docs:
            fs.move(draft, name)
            yield pa.RecordBatch.from_pydict({"file": [path], "part": pa.array([part], pa.int32()), "n_docs": [n_docs], "n_ids": [n_ids]})
        else:
            fs.delete_file(draft)

    return write


def write_planes(docs: DataFrame, folder: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", bits: bool = False, added: bool = False) -> DataFrame:
    """Encodes documents and writes their ids in ascending order of document id.

    Every text gets the id ``end`` after its own; a null text counts as empty, so it
    has that id alone. Documents with equal ids stay next to each other, in order of
    their texts; a null id comes first (and is stored as null). Texts of any length
    are encoded whole. No rows give no files. Other columns are not read.

    Sorts texts by id over the cluster, so a file is one range of ids. Documents of one
    id are dealt by their texts' first characters, so very many of them have several files. Returns the
    manifest: file, part (files' order), n_docs, n_ids, first_id (ids in files before).
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    dealt = rows.withColumn("tie", F.substring("text", 1, 32)).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "text").drop("tie")
    written = stored(dealt.mapInArrow(_writing(tokenizer, end, folder, bits, added), "file string, part int, n_docs bigint, n_ids bigint"), "plane-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return written.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("bigint")))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("file").to_pylist(), batch.column("first_id").to_pylist(), strict=True):
            fs, name = _open(path)
            with fs.open_input_file(name) as file:
                rows: list[tuple] = []
                for doc, ids in PlaneReader(file).documents():
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 8192:
                        yield _report(rows)
                        rows = []
                if rows:
                    yield _report(rows)


def _report(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_planes(manifest: DataFrame, files: int | None = None) -> DataFrame:
    """Per document, read from the files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers)."""
    n = files or max(1, manifest.count())
    spread = manifest.select("file", "first_id").repartition(min(n, 10_000))
    return spread.mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str, end: int, bits: bool = False, added: bool = False) -> DataFrame:
    """Writes files of ids to the shared folder and reports on every document from them."""
    return read_planes(stored(write_planes(docs, shared_dir(spark, "planes"), tokenizer, end, bits=bits, added=added), "plane-manifest"))
