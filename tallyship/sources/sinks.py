"""Sinks: tables that take puts, deletes, appends and plans of mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def put(current: DataFrame, writes: DataFrame, key: str = "key") -> DataFrame:
    """The objects after puts: a written key replaces what is there."""
    return current.join(writes.select(key), key, "left_anti").unionByName(writes)


def put_if_absent(current: DataFrame, writes: DataFrame, order: Column, key: str = "key") -> DataFrame:
    """Writes that take effect where the first writer of a key wins: the key is not there, and of several the first in order."""
    first = writes.groupBy(key).agg(F.min_by(F.struct(*writes.columns), order).alias("_one")).select("_one.*")
    return first.join(current.select(key), key, "left_anti").select(writes.columns)


def delete(current: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The objects without some keys; keys that are not there do no harm."""
    return current.join(keys.select(key), key, "left_anti")


def delete_prefix(current: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """The objects without a directory: ``tags/v1`` never takes ``tags/v1-rc``, and an empty prefix nothing."""
    if not prefix.strip("/"):
        return current
    return current.where(~F.startswith(F.col(key), F.lit(prefix.rstrip("/") + "/")))


def copy(current: DataFrame, pairs: DataFrame, key: str = "key") -> DataFrame:
    """The objects after copies (key, target): a target gets its source's content, whatever it had; a source that is not there copies nothing."""
    made = current.join(pairs, key).withColumn(key, F.col("target")).select(*current.columns)
    return put(current, made, key)


def move(current: DataFrame, pairs: DataFrame, key: str = "key") -> DataFrame:
    """As ``copy``, and the sources go; one that is moved onto itself stays."""
    away = pairs.where(F.col(key) != F.col("target"))
    made = current.join(pairs, key).withColumn(key, F.col("target")).select(*current.columns)
    return put(delete(current, away, key), made, key)


def assembled(parts: DataFrame, session: str = "session") -> DataFrame:
    """Uploads from their parts (session, at, body as bytes): the body, the parts joined in order, and its size."""
    joined = parts.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("_parts"))
    body = F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(p["body"])), ""))
    return joined.select(session, body.alias("body")).withColumn("size", F.octet_length("body").cast("bigint"))


def completed(requests: DataFrame, sessions: DataFrame, uploads: DataFrame) -> DataFrame:
    """Requests to complete uploads (session, digest, hashed_size) with their outcome: unknown, digest_invalid or completed.

    A session that is not there (any more) is unknown. What was staged must be as long
    as what was hashed, else it is not promoted, and its parts go.
    """
    known = requests.join(sessions.select("session", F.lit(True).alias("_open")), "session", "left").join(uploads.select("session", "size"), "session", "left")
    outcome = F.when(F.col("_open").isNull(), "unknown").when(F.coalesce("size", F.lit(0)) != F.col("hashed_size"), "digest_invalid").otherwise("completed")
    return known.withColumn("outcome", outcome).drop("_open")


def append_error(committed: Column, at: Column, size: Column, declared: Column) -> Column:
    """Why an append to an upload is refused: gap, rewind or size; null if it is not."""
    return F.when(at > committed, "gap").when(at < committed, "rewind").when(declared.isNotNull() & (declared != size), "size")


def mutation_waves(plan: DataFrame) -> DataFrame:
    """Operations with the wave in which they are written: references, then records, then what makes them visible.

    A reader that comes between waves sees content that is held but not yet named,
    never a name without its content.
    """
    kind = F.col("kind")
    wave = F.when(kind.isin("layer", "config", "manifest", "own"), 0).when(kind.isin("revision", "referrer"), 1).otherwise(2)
    return plan.withColumn("wave", wave)


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "append") -> None:
    """Writes Parquet by partition columns, each value's rows dealt to the same tasks, so that files stay few and large."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)


def exposition(counts: DataFrame, name: str, labels: list[str], value: str = "value") -> DataFrame:
    """Metric rows in text form: name{label="value",...} value"""
    shown = [F.concat(F.lit(f'{x}="'), F.regexp_replace(F.coalesce(F.col(x).cast("string"), F.lit("")), r'(["\\])', r"\\$1"), F.lit('"')) for x in labels]
    return counts.select(F.concat(F.lit(f"{name}{{"), F.concat_ws(",", *shown), F.lit("} "), F.col(value).cast("string")).alias("line"))
