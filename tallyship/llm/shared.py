"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session
    may go without the setting; it then gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyship-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """``df`` written once as a table in the shared folder (at ``path``, if given) and read back.

    Later steps then start from the files, so a lost executor costs a read and
    not the work before it.
    """
    path = path or shared_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of steps whose results have been stored.

    Spark drops them once nothing refers to the steps any more, but finds that out only
    when the driver collects its garbage, which an idle driver rarely does. The last
    execution is still referred to until another has followed it.
    """
    for _ in range(2):
        spark.range(1).count()
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path of any of Spark's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def matching_rows(docs: DataFrame, key: dict[str, Column], chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is in ``chosen`` (the key's columns, each key once, and ``n``, how many rows have it), one for each key.

    Rows go through one semi-join; only those of keys with several rows are then
    grouped, so whole rows are shuffled once and no more.
    """
    names = free_names(docs, *(f"_key_{k}" for k in key))
    marked = docs.withColumns(dict(zip(names, key.values(), strict=True)))

    def same(keys: DataFrame) -> Column:
        on = F.lit(True)
        for name, k in zip(names, key, strict=True):
            on = on & marked[name].eqNullSafe(keys[k])
        return on

    once = chosen.where("n = 1")
    rows = marked.join(once, same(once), "left_semi")
    several = chosen.where("n > 1")
    if not several.isEmpty():
        rows = rows.unionByName(marked.join(several, same(several), "left_semi").dropDuplicates(names))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def text_or_empty(name: str) -> Column:
    """The named column as a string, null read as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def sha256_hex(text: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, zero: Column, fold: Callable[[Column, Column], Column], block: int) -> Column:
    """For every element of an ``array<bigint>`` the fold of those before it, from ``zero`` on.

    The array is folded in blocks, since appending one element at a time to a
    long array would copy it each time.
    """

    def within(part: Column) -> Column:
        start = F.struct(zero.alias("total"), F.array().cast("array<bigint>").alias("before"))
        return F.aggregate(part, start, lambda s, x: F.struct(fold(s["total"], x).alias("total"), F.concat(s["before"], F.array(s["total"])).alias("before")))

    def whole(values: Column) -> Column:
        # the last block begins at or before the last element, so an empty array has the block at 0 alone
        begins = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(block))
        blocks = F.transform(begins, lambda i: within(F.slice(values, i + 1, F.lit(block))))
        start = F.struct(zero.alias("total"), F.array().cast("array<array<bigint>>").alias("parts"))
        joined = F.aggregate(
            blocks,
            start,
            lambda s, b: F.struct(
                fold(s["total"], b["total"]).alias("total"),
                F.concat(s["parts"], F.array(F.transform(b["before"], lambda x: fold(s["total"], x)))).alias("parts"),
            ),
        )
        return F.flatten(joined["parts"])

    return bound(values, whole)


def running_totals(sizes: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of an ``array<bigint>``, as an array of its length."""
    return _running(sizes, F.lit(0).cast("bigint"), lambda a, b: a + b, block)


def running_greatest(values: Column, least: int = -1, block: int = 256) -> Column:
    """The greatest of the elements before each of an ``array<bigint>``, ``least`` if none is greater."""
    return _running(values, F.lit(least).cast("bigint"), lambda a, b: F.greatest(a, b), block)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores after those that a column of ``docs`` has already."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
