"""Scans of an object store's keys, and parallel ranges over them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyship.functions import grammar as G
from tallyship.functions import keys as K

#: First characters at which a scan is split, in byte order: 63 bounds give 64 ranges.
BOUNDS = "".join(sorted("-_" + "0123456789" + "abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))[1:]


def files(spark: SparkSession, root: str) -> DataFrame:
    """A folder of any file system that Spark reads, as objects: key, size, modified time; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    bare = re.sub(r"^[a-z0-9]+:/+(?=/)", "", root.rstrip("/"))  # file systems spell the front of a path in several ways
    inside = F.regexp_replace("path", r"^.*?" + re.escape(bare) + "/", "")
    return found.select(inside.alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def contents(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Objects with their bodies."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")


def range_of(key: Column, prefix: str, bounds: str = BOUNDS) -> Column:
    """The number of the range (lower, upper] that a key falls in, by what follows the prefix."""
    rest = F.substring(key, len(prefix) + 1, 2**31 - 1)
    n = F.lit(0)
    for b in bounds:
        n = n + (rest > b).cast("int")
    return n


def parallel_scan(objects: DataFrame, partitions: int, key: str = "key") -> DataFrame:
    """Keys dealt to disjoint ranges of nearly equal size, in order within each; the ranges follow the keys, not the alphabet."""
    return objects.repartitionByRange(partitions, key).sortWithinPartitions(key)


def namespaces_with(objects: DataFrame, marker: str, key: str = "key") -> DataFrame:
    """Every path that has a child ``marker``, skipping any with a segment that begins with an underscore."""
    path = F.regexp_extract(F.col(key), rf"^(.+?)/{marker}(/|$)", 1)
    return objects.select(path.alias("ns")).where((F.col("ns") != "") & ~F.col("ns").rlike("(^|/)_")).distinct()


def parsed_keys(objects: DataFrame, key: str = "key") -> DataFrame:
    """Keys with their category, namespace and digest as columns."""
    return objects.select("*", K.category(F.col(key)).alias("category"), K.key_namespace(F.col(key)).alias("ns"), K.key_digest(F.col(key)).alias("digest"))


def quarantine(parsed: DataFrame, now_ms: int, grace_ms: int) -> DataFrame:
    """Keys that no writer makes and that are past grace, with the place they move to; a missing time keeps a key."""
    old = F.coalesce(F.lit(now_ms) - F.col("ms") >= grace_ms, F.lit(False))
    return parsed.where(old & (F.col("category") == "unknown")).withColumn("target", F.concat(F.lit(f"{K.LOST}/"), F.col("key")))


def blob_digests(objects: DataFrame, key: str = "key") -> DataFrame:
    """Digests of stored blobs with their shard of two hex digits."""
    data = objects.where(K.category(F.col(key)) == "blob_data")
    return data.select(K.key_digest(F.col(key)).alias("digest")).withColumn("shard", G.shard_of(F.col("digest")))
