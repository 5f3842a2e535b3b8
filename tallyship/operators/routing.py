"""Which policy, repository, endpoint or downstream a row belongs to."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def any_match(value: Column, patterns: Column) -> Column:
    """Whether a value matches one of an array of patterns, in any part."""
    return F.exists(patterns, lambda p: F.regexp_like(value, p))


def with_repository(rows: DataFrame, repositories: DataFrame, ns: str = "ns") -> DataFrame:
    """Rows with the repository whose name is their namespace or a whole-segment prefix of it; null for none.

    A namespace's own prefixes are looked up by equality, so the join needs no loop over
    all repositories; names do not overlap, hence one is found at most.
    """
    parts = F.split(F.col(ns), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    names = repositories.select(F.col("name").alias("repository"))
    found = rows.select(ns).distinct().select(ns, F.explode(prefixes).alias("repository")).join(names, "repository")
    return rows.join(found, ns, "left")


def overlapping(repositories: DataFrame) -> DataFrame:
    """Pairs of repositories of which one lies below the other; there must be none."""
    parts = F.split("name", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    deep = repositories.where(F.size(parts) > 1).select(F.col("name").alias("inner"), F.explode(above).alias("outer"))
    return deep.join(repositories.select(F.col("name").alias("outer")), "outer")


def immutable(tag: Column, global_flag: Column, repo_flag: Column, global_exclusions: Column, repo_exclusions: Column) -> Column:
    """Whether a tag may not move: either flag, unless an exclusion matches; the repository's exclusions take the global ones' place if there are any."""
    exclusions = F.when(F.size(repo_exclusions) > 0, repo_exclusions).otherwise(global_exclusions)
    return (F.coalesce(global_flag, F.lit(False)) | F.coalesce(repo_flag, F.lit(False))) & ~F.coalesce(any_match(tag, exclusions), F.lit(False))


def matches_artifact(filter_type: Column, own_type: Column, config_type: Column) -> Column:
    """An artifact-type filter against a manifest's own type, else its config's; no filter passes all."""
    return filter_type.isNull() | F.coalesce(F.coalesce(own_type, config_type) == filter_type, F.lit(False))


def wants_event(kind: Column, repository: Column, kinds: Column, filters: Column) -> Column:
    """Whether an endpoint takes an event: its kind is listed, and a filter matches or there is none."""
    return F.array_contains(kinds, kind) & ((F.size(filters) == 0) | any_match(repository, filters))


def deliveries(events: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Events with every endpoint that takes them; endpoints are exploded by kind, so the join is by equality."""
    by_kind = endpoints.withColumn("kind", F.explode(F.array_distinct("kinds")))
    joined = events.join(by_kind, "kind")
    return joined.where((F.size("filters") == 0) | any_match(F.col("repository"), F.col("filters"))).drop("kinds", "filters")


def replicates(ns: Column, mode: Column, wanted: list[str], filters: Column) -> Column:
    """Whether a downstream of some mode takes a namespace."""
    return mode.isin(wanted) & ((F.size(filters) == 0) | any_match(ns, filters))


def request_allowed(global_allows: Column, repo_allows: Column, has_repo: Column, is_push: Column, pull_through: Column) -> Column:
    """The global policy has to allow, then the repository's; nothing is pushed to a pull-through repository."""
    denied_push = F.coalesce(is_push & pull_through, F.lit(False))
    return global_allows & F.when(has_repo, F.coalesce(repo_allows, F.lit(True))).otherwise(True) & ~denied_push


def first_authorized(candidates: DataFrame, key: list[str], ns: str, authorized: Column) -> DataFrame:
    """Of each key's candidate namespaces, in order of their names, the first that is authorized."""
    return candidates.where(authorized).groupBy(*key).agg(F.min(ns).alias(ns))


def own_annotations(annotations: Column, reserved: str) -> Column:
    """Annotations under a reserved prefix, null if there are none."""
    kept = F.map_filter(annotations, lambda k, v: F.startswith(k, F.lit(reserved)))
    return F.when(F.size(kept) > 0, kept)




