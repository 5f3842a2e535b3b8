"""Token counts from flat files of ids that have no index.

A file is nothing but fixed-width unsigned little-endian ids, one document after
another, each ended by a separator id. Files are read in blocks, by any number of
tasks; a block finds its separators in one vectorised comparison and reports the
lengths between them. What a document has in earlier blocks is added afterwards by a
prefix scan over the blocks' ends, so documents may span any number of blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyship.llm.blocks import blocks
from tallyship.llm.shared import shared_dir, stored
from tallyship.llm.tokens import ENCODED_BYTES, text_encoder, with_end

BLOCK_BYTES = 4 << 20


def _open(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def _scanning(width: int, separator: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = _open(row["file"])
                with fs.open_input_file(name) as file:
                    ids = np.frombuffer(file.read_at(row["size"], row["at"]), f"<u{width}")
                ends = np.flatnonzero(ids == separator)
                lengths = np.diff(ends, prepend=-1) - 1
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                yield pa.RecordBatch.from_pydict({"file": [row["file"]], "block": [row["block"]], "lengths": pa.array([lengths.tolist()], pa.list_(pa.int64())), "tail": [tail]})

    return scan


def count_tokens(spark: SparkSession, path: str, width: int, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document of the files at ``path``: file, ordinal (from 0 in its file), n_tokens, ended.

    n_tokens leaves out the separator. Ids after the last separator are a document
    that has not ended; a file's bytes after its last whole id are ignored. Empty
    documents count, empty files have none.
    """
    if block_bytes % width:
        raise ValueError("a block has to hold whole ids")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    whole = (F.col("length") - F.col("length") % width).alias("length")
    parts = files.where(F.col("length") >= width).select(F.col("path").alias("file"), whole).select("file", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / block_bytes))).alias("block"))
    at = F.col("block") * block_bytes
    plan = parts.select("file", "block", at.alias("at"), F.least(F.lit(block_bytes).cast("bigint"), F.col("length") - at).alias("size"))
    tasks = spark.sparkContext.defaultParallelism * 4
    scanned = stored(plan.repartition(tasks, "file", "block").mapInArrow(_scanning(width, separator), "file string, block bigint, lengths array<bigint>, tail bigint"), "separators")

    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("lengths").cast("bigint")
    ends = scanned.select("file", "block", n.alias("n"), "tail").withColumn("run", F.sum((F.col("n") > 0).cast("bigint")).over(order))
    # a run is a block with separators and those without that follow it; what it leaves over goes to the next run's first document
    open_ids = F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block"))
    carried = ends.withColumn("open", open_ids).select("file", "block", F.coalesce(F.lag("open").over(order), F.lit(0)).alias("carry"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.lead("block").over(order).isNull().alias("last"), "open")
    joined = scanned.join(carried, ["file", "block"])
    closed = joined.select("file", "carry", "first", F.posexplode("lengths").alias("i", "own")).select(
        "file", (F.col("first") + F.col("i")).alias("ordinal"), (F.col("own") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("ended")
    )
    rest = joined.where(F.col("last") & (F.col("open") > 0)).select("file", (F.col("first") + F.size("lengths")).alias("ordinal"), F.col("open").alias("n_tokens"), F.lit(False).alias("ended"))
    return closed.unionByName(rest)


def _writing(tokenizer: str, separator: int, width: int, folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, path = text_encoder(tokenizer), f"{folder}/part-{TaskContext.get().partitionId():06d}.ids"
        fs, name = _open(path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        draft, done = f"{folder}/.draft-{uuid.uuid4().hex}", 0
        _, draft = _open(draft)
        with fs.open_output_stream(draft) as file:
            for block in blocks(batches, limit=ENCODED_BYTES):
                ids, offsets = with_end(*encoder.encode(block.data, block.offsets), separator)
                if len(ids) and int(ids.max()) >= 1 << 8 * width:
                    raise ValueError(f"an id needs more than {width} bytes")
                file.write(ids.astype(f"<u{width}").tobytes())
                n = block.rows.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(done, done + n)), block.rows.column("doc_id")], names=["file", "ordinal", "doc_id"])
                done += n
        if done:
            fs.move(draft, name)
        else:
            fs.delete_file(draft)

    return write


def write_flat(docs: DataFrame, folder: str, tokenizer: str, separator: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes documents' ids as flat files, in the order in which they come, and returns file, ordinal and doc_id of each.

    A null text counts as empty and has its separator alone. Only the two columns are read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return stored(rows.mapInArrow(_writing(tokenizer, separator, width, folder), "file string, ordinal bigint, doc_id bigint"), "flat-names")


def count_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and n_tokens of every document, counted from flat files that are written first."""
    folder = shared_dir(spark, "flat")
    names = write_flat(docs, folder, tokenizer, separator)
    if names.isEmpty():
        return names.select("doc_id", F.lit(0).cast("bigint").alias("n_tokens"))
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1).alias("file")  # noqa: E731  file systems spell a path's front in several ways
    counts = count_tokens(spark, folder, 2, separator, block_bytes)
    return names.select(name("file"), "ordinal", "doc_id").join(counts.select(name("file"), "ordinal", "n_tokens"), ["file", "ordinal"]).select("doc_id", "n_tokens")
