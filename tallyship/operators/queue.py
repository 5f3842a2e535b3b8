"""A job queue's transitions, as batch folds over its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyship.functions.scalars import backoff_ms

#: Attempts before a job is set aside, unless the job says otherwise.
ATTEMPTS = 5


def enqueue(arrivals: DataFrame, pending: DataFrame) -> DataFrame:
    """Arrivals (id, queue, lock_key, seq) with ``outcome``: a hit joins the job of its lock that waits (or came first), a miss is a new job."""
    waiting = pending.groupBy("queue", "lock_key").agg(F.min("id").alias("_waiting"))
    first = F.first("id").over(Window.partitionBy("queue", "lock_key").orderBy("seq", "id"))
    joined = arrivals.withColumn("_first", first).join(waiting, ["queue", "lock_key"], "left")
    job = F.coalesce("_waiting", "_first")
    return joined.withColumn("job", job).withColumn("outcome", F.when(job == F.col("id"), "miss").otherwise("hit")).drop("_first", "_waiting")


def ready(jobs: DataFrame, now_ms: int) -> DataFrame:
    """Jobs whose time has come."""
    return jobs.where(F.col("not_before_ms") <= now_ms)


def claimable(jobs: DataFrame, claims: DataFrame, now_ms: int) -> DataFrame:
    """The job that may start for each lock: the earliest one ready and readable, unless a claim on the lock is valid."""
    held = claims.where(F.col("expires_ms") >= now_ms).select("queue", "lock_key")
    order = Window.partitionBy("queue", "lock_key").orderBy("not_before_ms", "id")
    fit = ready(jobs, now_ms).where(~F.coalesce(F.col("poison"), F.lit(False)))
    return fit.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place").join(held, ["queue", "lock_key"], "left_anti")


def stale(expires_ms: Column, modified_ms: Column, now_ms: int, ttl_ms: int) -> Column:
    """Whether a claim has lapsed: past its end, or, if that cannot be read, twice the lease after it was written."""
    return F.coalesce(expires_ms < now_ms, modified_ms + 2 * ttl_ms < now_ms)


def fail(jobs: DataFrame, now_ms: int, terminal: Column | None = None) -> DataFrame:
    """Failed jobs after one more attempt: pending again with backoff, or set aside at the limit (or at once if terminal)."""
    attempts = F.col("attempts") + 1
    spent = (attempts >= F.coalesce("max_attempts", F.lit(ATTEMPTS))) | (terminal if terminal is not None else F.lit(False))
    return (
        jobs.withColumn("state", F.when(spent, "failed").otherwise("pending"))
        .withColumn("not_before_ms", F.when(spent, F.col("not_before_ms")).otherwise(F.lit(now_ms) + backoff_ms(F.col("attempts"))))
        .withColumn("attempts", attempts)
    )


def retry(jobs: DataFrame, now_ms: int, chosen: Column) -> DataFrame:
    """Chosen jobs of those set aside become pending again, with no attempts and due at once."""
    again = chosen & (F.col("state") == "failed")
    return (
        jobs.withColumn("attempts", F.when(again, 0).otherwise(F.col("attempts")))
        .withColumn("not_before_ms", F.when(again, F.lit(now_ms)).otherwise(F.col("not_before_ms")))
        .withColumn("state", F.when(again, "pending").otherwise(F.col("state")))
    )


def depth(jobs: DataFrame, horizon_ms: int, most: int = 10_000) -> DataFrame:
    """Jobs of each queue and state that are due within the horizon, counted up to ``most``."""
    due = jobs.where((F.col("state") != "pending") | (F.col("not_before_ms") <= horizon_ms))
    return due.groupBy("queue", "state").agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("jobs"))


def orphan_index(index: DataFrame, pending: DataFrame) -> DataFrame:
    """Entries of the lock index whose job is not pending any more."""
    return index.join(pending.select("queue", F.col("id").alias("job")), ["queue", "job"], "left_anti")


def breaker_states(calls: DataFrame, key: str, threshold: int, cooldown_ms: int) -> DataFrame:
    """Calls (key, ms, ok) with the streak of failures before each and whether the breaker lets it pass.

    A streak of ``threshold`` failures opens the breaker; after the cooldown since the
    last failure a probe passes. A success closes it.
    """
    order = Window.partitionBy(key).orderBy("ms")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    runs = F.coalesce(F.sum(F.col("ok").cast("int")).over(before), F.lit(0))
    marked = calls.withColumn("_run", runs)
    same = Window.partitionBy(key, "_run").orderBy("ms").rowsBetween(Window.unboundedPreceding, -1)
    streak = F.coalesce(F.sum((~F.col("ok")).cast("int")).over(same), F.lit(0))
    last = F.max(F.when(~F.col("ok"), F.col("ms"))).over(same)
    state = F.when(streak < threshold, "closed").when(F.col("ms") - last >= cooldown_ms, "half_open").otherwise("open")
    return marked.withColumn("failures", streak).withColumn("state", state).drop("_run")


def cached_decisions(calls: DataFrame, headers: list[str], ttl_ms: int) -> DataFrame:
    """Authorization calls (ms, status, header columns) with the key of their forwarded headers and whether an earlier answer serves.

    Only an allow (200), a 401 and a 403 are kept, for ``ttl_ms`` after the call.
    """
    text = F.concat_ws("\n", *(F.concat(F.lit(f"{h}="), F.coalesce(F.col(h).cast("string"), F.lit(""))) for h in sorted(headers)))
    keyed = calls.withColumn("cache_key", F.sha2(text.cast("binary"), 256))
    order = Window.partitionBy("cache_key").orderBy("ms").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.max(F.when(F.col("status").isin(200, 401, 403), F.col("ms"))).over(order)
    return keyed.withColumn("served", F.coalesce(F.col("ms") - kept < ttl_ms, F.lit(False)))
