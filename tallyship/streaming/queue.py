"""A job queue fed by a stream: arrivals of a lock that waits join the job that is there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "id string, queue string, lock_key string, job string, outcome string"
STATE = "job string"
LOCKS = "queue string, lock_key string, waiting string, first string, ends boolean"
FOLDED = f"{OUTPUT}, last boolean"


def _joined(job: str | None, ids: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, str | None]:
    """The jobs that rows of one lock, in order, join or take, and the one that waits after them; between two done rows all join the same."""
    jobs, begin = np.full(len(ids), None, object), 0
    for stop in [*np.flatnonzero(done).tolist(), len(ids)]:
        if begin < stop:
            job = job or ids[begin]
            jobs[begin:stop] = job
        if stop < len(ids) and ids[stop] == job:
            job = None
        begin = stop + 1
    return jobs, job


def _fold(key: tuple[str, str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Arrivals in order of seq: the first of an idle lock is a miss and takes it, a done one frees it, others are hits.

    A trigger's rows of a lock come in several frames if they are many, so they are
    put in order together.
    """
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["seq", "id"], ignore_index=True)
    ids, done = rows["id"].to_numpy(), rows["done"].to_numpy(bool)
    jobs, job = _joined(state.get[0] if state.exists else None, ids, done)
    out = pd.DataFrame({"id": ids, "queue": key[0], "lock_key": key[1], "job": jobs, "outcome": np.where(jobs == ids, "miss", "hit")})
    yield out[~done]
    if job is None:
        state.remove()
    else:
        state.update((job,))


def enqueued(arrivals: DataFrame) -> DataFrame:
    """A stream of (id, queue, lock_key, seq, done) with each arrival's job and outcome.

    ``done`` rows say that a job has ended, which frees its lock. The state holds one
    job id for each lock that waits, and goes when the job does. A trigger's arrivals
    of one lock are in the memory of one task, and every lock costs a call: for large
    triggers take ``enqueue_batches``.
    """
    return arrivals.groupBy("queue", "lock_key").applyInPandasWithState(_fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def _fold_sorted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arrivals with their jobs, of rows sorted by lock, then order; after each lock a row ``last`` with the job that waits. Holds one frame at a time."""
    lock, job = None, None
    for rows in frames:
        ids, done, waiting = rows["id"].to_numpy(), rows["done"].to_numpy(bool), rows["waiting"].to_numpy()
        names = list(zip(rows["queue"], rows["lock_key"], strict=True))
        starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
        jobs, ended = np.full(len(ids), None, object), []
        for begin, end in zip(starts, [*starts[1:], len(ids)], strict=True):
            if names[begin] != lock:
                ended += [(*lock, job)] if lock else []
                lock, job = names[begin], waiting[begin]
            jobs[begin:end], job = _joined(job, ids[begin:end], done[begin:end])
        out = pd.DataFrame({"id": ids, "queue": rows["queue"], "lock_key": rows["lock_key"], "job": jobs, "outcome": np.where(jobs == ids, "miss", "hit"), "last": False})[~done]
        yield pd.concat([out, _ended(ended)]) if ended else out
    if lock:
        yield _ended([(*lock, job)])


def _ended(locks: list[tuple]) -> pd.DataFrame:
    queue, lock_key, job = zip(*locks, strict=True)
    return pd.DataFrame({"id": None, "queue": queue, "lock_key": lock_key, "job": job, "outcome": None, "last": True})


def _of_lock(rows: DataFrame, locks: DataFrame, how: str) -> DataFrame:
    """Rows with their lock's columns; a null is a queue or lock as any other."""
    named = locks.withColumnsRenamed({"queue": "_queue", "lock_key": "_lock_key"})
    return rows.join(named, F.col("lock_key").eqNullSafe(F.col("_lock_key")) & F.col("queue").eqNullSafe(F.col("_queue")), how)


def enqueue_batches(arrivals: DataFrame, folder: str, take: Callable[[DataFrame, int], None]):
    """Enqueues a stream of (id, queue, lock_key, seq, done) trigger by trigger, and hands each arrival's job and outcome to ``take`` with the trigger's number.

    The results are those of ``enqueued``. A trigger first finds the first arrival of
    every lock by a partial aggregate and writes it beside the job that waits; arrivals
    join that, however many one lock has. Only locks of which a job ends are folded row
    by row, sorted by Spark, so that a task holds one frame. ``folder`` is one that all
    executors share; what waits is kept there for the last two triggers, so that one
    may be run again.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark, now, before = rows.sparkSession, number % 2, (number - 1) % 2
        table = lambda name, schema, n: spark.read.schema(schema).parquet(f"{folder}/{name}/{n}")
        rows = rows.withColumn("done", F.coalesce("done", F.lit(False)))
        order: list[Column] = [F.col("seq").isNull(), F.col("seq"), F.col("id").isNull(), F.col("id")]
        first = F.min_by("id", F.when(~F.col("done"), F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)))))
        came = rows.groupBy("lock_key", "queue").agg(first.alias("first"), F.bool_or("done").alias("ends"))
        if number:
            kept = table("locks", LOCKS, before).where("NOT ends").select("queue", "lock_key", F.coalesce("waiting", "first").alias("waiting"))
            waits = kept.unionByName(table("folded", FOLDED, before).where("last").select("queue", "lock_key", F.col("job").alias("waiting"))).where("waiting IS NOT NULL")
            known = _of_lock(came, waits, "full").select(F.when(F.col("ends").isNull(), F.col("_queue")).otherwise(F.col("queue")).alias("queue"), F.when(F.col("ends").isNull(), F.col("_lock_key")).otherwise(F.col("lock_key")).alias("lock_key"), "waiting", "first", F.coalesce("ends", F.lit(False)).alias("ends"))
        else:
            known = came.select("queue", "lock_key", F.lit(None).cast("string").alias("waiting"), "first", "ends")
        known.write.mode("overwrite").parquet(f"{folder}/locks/{now}")
        locks = table("locks", LOCKS, now)
        ending = locks.where("ends").select("queue", "lock_key", "waiting")
        if ending.isEmpty():
            folded = spark.createDataFrame([], FOLDED).coalesce(1)
        else:
            dealt = _of_lock(rows, ending, "inner").select("id", "queue", "lock_key", "done", "waiting", "seq").repartition("lock_key", "queue")
            folded = dealt.sortWithinPartitions("lock_key", "queue", *order).drop("seq").mapInPandas(_fold_sorted, FOLDED)
        folded.write.mode("overwrite").parquet(f"{folder}/folded/{now}")
        job = F.coalesce("waiting", "first")
        settled = _of_lock(rows, locks.where("NOT ends"), "inner").select("id", "queue", "lock_key", job.alias("job"), F.when(job == F.col("id"), "miss").otherwise("hit").alias("outcome"))
        take(settled.unionByName(table("folded", FOLDED, now).where("NOT last").drop("last")), number)

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/state")
