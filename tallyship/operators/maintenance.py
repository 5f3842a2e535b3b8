"""Maintenance plans: one table of actions, which a dry run shows and an executor applies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("action", "ns", "digest", "tag", "key", "reason")


def actions(rows: DataFrame, action: str, reason: str = "") -> DataFrame:
    """Rows as actions of one kind; columns that they lack are null."""
    have = set(rows.columns)
    fixed = {"action": F.lit(action), "reason": F.lit(reason)}
    return rows.select(*(fixed[c].alias(c) if c in fixed else (F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in COLUMNS))


def sorted_actions(rows: DataFrame, kinds: list[tuple[str, str, str]]) -> DataFrame:
    """Rows as actions of several kinds (action, reason, condition), a row once for each condition that it meets; rows are made once for all kinds."""
    met = F.array_compact(F.array(*(F.when(F.expr(c), F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))) for action, reason, c in kinds)))
    have = set(rows.columns) - {"action", "reason"}
    each = rows.withColumn("_kind", F.explode(met))
    return each.select(*((F.col(f"_kind.{c}") if c in ("action", "reason") else F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in COLUMNS))


def plan(*parts: DataFrame) -> DataFrame:
    """All parts of a plan."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def report(planned: DataFrame) -> DataFrame:
    """Actions by kind and reason."""
    return planned.groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n"))


def apply_tag_deletes(live: DataFrame, planned: DataFrame) -> DataFrame:
    """Live tags after a plan's deletes."""
    gone = planned.where("action = 'DeleteTag'").select("ns", "tag")
    return live.join(gone, ["ns", "tag"], "left_anti")


def tallies(rows: DataFrame, **outcomes) -> DataFrame:
    """One row with the number of rows for which each outcome holds."""
    return rows.agg(*(F.count_if(c).alias(n) for n, c in outcomes.items()))
