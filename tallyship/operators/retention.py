"""Retention: ranks of tags by time, rules over them, and what is to be deleted."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyship.functions import rules as R
from tallyship.functions.scalars import rule_seconds


def ranked(tags: DataFrame, time: str, name: str, group: str = "ns", tag: str = "tag") -> DataFrame:
    """Tags with their rank by time, most recent first, ties by tag; null where the time is."""
    order = Window.partitionBy(group).orderBy(F.col(time).desc_nulls_last(), F.col(tag))
    return tags.withColumn(name, F.when(F.col(time).isNotNull(), F.row_number().over(order)))


def ranked_to(tags: DataFrame, time: str, name: str, most: int, group: str = "ns", tag: str = "tag") -> DataFrame:
    """As ``ranked``, with null for ranks above ``most``: only so many rows of a group come together, whatever its size."""
    if most < 1:
        return tags.withColumn(name, F.lit(None).cast("int"))
    order = Window.partitionBy(group).orderBy(F.col(time).desc(), F.col(tag))
    top = tags.where(F.col(time).isNotNull() & F.col(tag).isNotNull()).select(group, tag, time).withColumn(name, F.row_number().over(order)).where(F.col(name) <= most)
    return tags.join(top.select(group, tag, name), [group, tag], "left")


def highest_rank(rules: list[str], function: str) -> int | None:
    """The greatest rank that rules ask for by ``function``, 0 if they do not; null if an argument is no plain number."""
    asked = [a.strip() for rule in rules for a in re.findall(rf"\b{function}\s*\(([^()]*)\)", rule)]
    if len(asked) < sum(len(re.findall(rf"\b{function}\b", rule)) for rule in rules) or not all(re.fullmatch(r"-?\d{1,9}", a) for a in asked):
        return None
    return max([0, *map(int, asked)])


def with_last_pull(tags: DataFrame, pulls: DataFrame, inline: str | None = None) -> DataFrame:
    """Tags with ``pulled_ms``: the newest pull of each, or the inline time if that is newer; null if neither is known."""
    newest = pulls.groupBy("ns", "tag").agg(F.max("ms").alias("_pull"))
    time = F.greatest("_pull", inline) if inline else F.col("_pull")
    return tags.join(newest, ["ns", "tag"], "left").withColumn("pulled_ms", time).drop("_pull")


def image_scope(now: int, tag: str = "tag", pushed_rank: str = "pushed_rank", pulled_rank: str = "pulled_rank") -> R.Scope:
    """Rule names over columns tag, pushed_ms, pulled_ms, pushed_rank and pulled_rank."""
    seconds = lambda c: F.floor(F.col(c) / 1000).cast("bigint")
    return R.retention_scope(
        F.col(tag), rule_seconds(seconds("pushed_ms"), now), rule_seconds(seconds("pulled_ms"), 0), F.col(pushed_rank), F.col(pulled_rank), now
    )


def verdicts(tags: DataFrame, rules: list[str], now: int, global_rules: list[str] | None = None) -> DataFrame:
    """Tags (ns, tag, digest, pushed_ms, pulled_ms), each once, with ranks, retain, outcome and matched_rule.

    Rules look at ranks as far as they ask for, so that a verdict brings few rows of a
    group together; the full ranks are planned only where they are read.
    """
    both = tags
    for time, name, function in (("pushed_ms", "pushed_rank", "top_pushed"), ("pulled_ms", "pulled_rank", "top_pulled")):
        most = highest_rank([*rules, *(global_rules or [])], function)
        both = ranked(both, time, f"_{name}") if most is None else ranked_to(both, time, f"_{name}", most)
        both = ranked(both, time, name)
    scope = image_scope(now, pushed_rank="_pushed_rank", pulled_rank="_pulled_rank")
    verdict = R.evaluate(rules, scope)
    retain = R.either_retains(global_rules or [], rules, scope)
    return both.withColumn("_verdict", verdict).select(*tags.columns, "pushed_rank", "pulled_rank", retain.alias("retain"), F.col("_verdict.outcome").alias("outcome"), F.col("_verdict.index").alias("matched_rule"))


def check_pull_times(rules: list[str], recorded: bool) -> None:
    """Refuses rules over pull times where these are not recorded."""
    if R.uses_pull_time(rules) and not recorded:
        raise R.RuleError("rules look at pull times, which are not recorded")


def young(age: Column, grace: int) -> Column:
    """Under the grace period; a missing time counts as young."""
    return F.coalesce(age < grace, F.lit(True))


def upload_verdict(age: Column, window: int, state: Column) -> Column:
    """delete or keep an upload session by its age (over the window) and state (ok, corrupt, missing, error)."""
    return F.when(state == "error", "keep").when(state.isin("corrupt", "missing"), "delete").when(age > window, "delete").otherwise("keep")


def abandoned(age: Column, timeout: int) -> Column:
    """Whether a multipart upload is given up: at the timeout or after it."""
    return age >= timeout
