"""Last-writer-wins resolution of tags and links.

Every change is an appended event, so the present state is a fold. Windows over
(namespace, tag) with a rank filter are planned as group limits on both sides of one
exchange: each task keeps its best row per key before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("ns", "tag")


def winner_order(ms: str = "ms", digest: str = "digest", is_del: str = "is_del") -> list[Column]:
    """Newest first, a missing time last; of one time the highest digest, then a set before a delete of it."""
    return [F.col(ms).desc_nulls_last(), F.col(digest).desc_nulls_last(), F.col(is_del).asc()]


def winners(events: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The event that decides each tag, tombstones included."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*winner_order()))
    return events.withColumn("_place", place).where("_place = 1").drop("_place")


def live_tags(events: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Tags that resolve: those whose deciding event is no delete."""
    return winners(events, key).where(~F.col("is_del"))


def shadowed_union(events: DataFrame, legacy: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Live tags, and legacy tags that no event speaks of; a tombstone hides the legacy tag too."""
    columns = [c for c in events.columns if c in legacy.columns]
    old = legacy.join(events.select(*key).distinct(), list(key), "left_anti")
    return live_tags(events, key).select(*columns).unionByName(old.select(*columns))


def first_by_priority(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of several sources, for each key from the first source that has it."""
    tagged = [s.withColumn("_priority", F.lit(i)) for i, s in enumerate(sources)]
    joined = tagged[0]
    for t in tagged[1:]:
        joined = joined.unionByName(t)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_priority"))
    return joined.withColumn("_place", place).where("_place = 1").drop("_place", "_priority")


def supersedes(stored_ms: Column, stored_digest: Column, ms: Column, digest: Column) -> Column:
    """Whether what is stored stands against a write: it is newer, or as new with a higher digest. A delete has no digest; a missing time never stands."""
    tie = (stored_ms == ms) & F.coalesce(stored_digest > digest, F.lit(False))
    return F.coalesce((stored_ms > ms) | tie, F.lit(False))


def gate_writes(writes: DataFrame, state: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Writes with ``outcome``: superseded by the state, unchanged, or applied."""
    held = state.select(*key, F.col("ms").alias("stored_ms"), F.col("digest").alias("stored_digest"))
    outcome = (
        F.when(supersedes(F.col("stored_ms"), F.col("stored_digest"), F.col("ms"), F.col("digest")), "superseded")
        .when(F.col("stored_digest") == F.col("digest"), "unchanged")
        .otherwise("applied")
    )
    return writes.join(held, list(key), "left").withColumn("outcome", outcome)


def changes(events: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Events with ``changed``: whether the digest differs from that of the key's event before; the first has changed."""
    order = Window.partitionBy(*key).orderBy(F.col("ms").asc_nulls_first(), "digest")
    before = F.lag("digest").over(order)
    return events.withColumn("changed", ~before.eqNullSafe(F.col("digest")))


def last_ops(ops: DataFrame, key: list[str], op: str = "op", seq: str = "seq") -> DataFrame:
    """The last operation of every key."""
    return ops.groupBy(*key).agg(F.max_by(op, seq).alias(op))


def retired_entries(entries: DataFrame, key: list[str], now_ms: int, window_ms: int) -> DataFrame:
    """Access entries to retire: all but the newest of each key, once they are ``window_ms`` old or older."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("ms").desc_nulls_last(), "entry"))
    old = F.lit(now_ms) - F.col("ms") >= window_ms
    return entries.withColumn("_place", place).where((F.col("_place") > 1) & old).drop("_place")


def demoted_entries(events: DataFrame, now_ms: int, grace_ms: int, key: tuple[str, ...] = KEY) -> DataFrame:
    """Tag events to move to history: strictly older than the deciding time's group, and past grace."""
    place = F.rank().over(Window.partitionBy(*key).orderBy(F.col("ms").desc_nulls_last()))
    past = F.coalesce(F.lit(now_ms) - F.col("ms") >= grace_ms, F.lit(False))
    return events.withColumn("_place", place).where((F.col("_place") > 1) & past).drop("_place")


def newest_per_key(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every key, with their place from 1 on."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def tags_of(digest: str, live: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """Tags that point at a digest: deciding events, and legacy links of tags without any."""
    found = live.where(F.col("digest") == digest).select("ns", "tag")
    if legacy is None:
        return found
    old = legacy.where(F.col("digest") == digest).join(live.select("ns", "tag"), ["ns", "tag"], "left_anti")
    return found.unionByName(old.select("ns", "tag"))
