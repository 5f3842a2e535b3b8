"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyship.plans.registry import query
from tallyship.sources.adapters import NOW_MS, Tables, event_endpoints, with_sql
from tallyship.sources.shared import ensure_checkpoints
from tallyship.streaming.events import deliver, live_tag_states, queue_depths, recorded_pulls
from tallyship.streaming.queue import OUTPUT, enqueue_batches


class Streams(Tables):
    """The tables read as streams of files."""

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        # as a pattern, since a stream's plain path has to be a folder, and a table may be one file
        return self.spark.readStream.schema(self.spark.read.parquet(path).schema).parquet(f"{self.folder}/{name}.parque[t]")


def _folder(t: Tables) -> str:
    ensure_checkpoints(t.spark)
    root = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_to_end(t: Tables, stream: DataFrame) -> DataFrame:
    """All rows that an append stream writes for the files there are."""
    folder = _folder(t)
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _enqueued_to_end(t: Tables, arrivals: DataFrame) -> DataFrame:
    """What the triggers of a queue's stream hand on for the arrivals there are."""
    folder = _folder(t)
    keep = lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/out/trigger={n}")
    enqueue_batches(arrivals, folder, keep).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(OUTPUT).parquet(f"{folder}/out/*")


@query(with_sql("jobs", "SELECT id, queue, lock_key, first_value(id) OVER w AS job, CASE WHEN first_value(id) OVER w = id THEN 'miss' ELSE 'hit' END AS outcome FROM jobs WINDOW w AS (PARTITION BY queue, lock_key ORDER BY seq, id)"))
def t3_stream_enqueue(t: Tables) -> DataFrame:
    jobs = Streams(t.spark, t.folder).jobs()
    return _enqueued_to_end(t, jobs.select("id", "queue", "lock_key", "seq", F.lit(False).alias("done")))


@query(with_sql("jobs", "SELECT id, queue, first_value(id) OVER w AS job, CASE WHEN first_value(id) OVER w = id THEN 'miss' ELSE 'hit' END AS outcome FROM jobs WINDOW w AS (PARTITION BY queue ORDER BY seq, id)"))
def t3_stream_hot_lock(t: Tables) -> DataFrame:
    """All jobs of a queue want the same lock, in one trigger."""
    jobs = Streams(t.spark, t.folder).jobs()
    return _enqueued_to_end(t, jobs.select("id", "queue", F.lit("one").alias("lock_key"), "seq", F.lit(False).alias("done"))).drop("lock_key")


@query(with_sql("jobs", f"SELECT queue, state, least(count(*), 10000) AS jobs FROM jobs WHERE state <> 'pending' OR not_before_ms <= {NOW_MS} GROUP BY queue, state"))
def t14_stream_queue_depth(t: Tables) -> DataFrame:
    """The counts that a trigger of the depth stream reports."""
    folder = _folder(t)
    report = lambda counts: counts.write.mode("overwrite").parquet(f"{folder}/depths")
    queue_depths(Streams(t.spark, t.folder).region, t.jobs, lambda: NOW_MS, report, f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/depths")


_DELIVERIES = """deliveries AS (SELECT event_id, endpoint, policy, CASE WHEN endpoint = 'audit' THEN event_id % 4 WHEN endpoint = 'alerts' THEN 9 ELSE 0 END AS fails FROM (SELECT event_id, 'audit' AS endpoint, 'optional' AS policy FROM tag_events WHERE tag IN ('view', 'click')
UNION ALL SELECT event_id, 'builds', 'async' FROM tag_events WHERE tag = 'purchase' AND regexp_matches(ns, '^org[12]/') UNION ALL SELECT event_id, 'alerts', 'optional' FROM tag_events WHERE tag = 'error' AND contains(ns, 'u1')))"""


@query(with_sql("tag_events", "SELECT event_id, endpoint, policy, 'gave up after 3' AS error FROM deliveries WHERE fails >= 3", _DELIVERIES))
def k8_stream_deliveries(t: Tables) -> DataFrame:
    """Deliveries that fail for good after three attempts; a receiver fails as often as the event's number says."""
    folder = _folder(t)
    events = Streams(t.spark, t.folder).tag_events().select("event_id", F.col("tag").alias("kind"), F.col("ns").alias("repository"))
    fails = F.when(F.col("endpoint") == "audit", F.col("event_id") % 4).when(F.col("endpoint") == "alerts", 9).otherwise(0)
    send = lambda rows, attempt: rows.withColumn("error", F.when(fails > attempt, f"gave up after {attempt + 1}"))
    endpoints = event_endpoints(t).withColumn("policy", F.when(F.col("policy") == "async", "async").otherwise("optional"))
    deliver(events, endpoints, send, f"{folder}/state", f"{folder}/failures").trigger(availableNow=True).start().awaitTermination()
    failed = t.spark.read.parquet(f"{folder}/failures")
    return failed.select("event_id", "endpoint", "policy", "error")


@query(with_sql("pulls", "SELECT DISTINCT ns, tag, client, ms FROM pulls"))
def t13_stream_pulls(t: Tables) -> DataFrame:
    pulls = Streams(t.spark, t.folder).pulls()
    return run_to_end(t, recorded_pulls(pulls.withColumn("at", F.timestamp_millis("ms")).drop("ms"))).select("ns", "tag", "client", "ms")


@query(with_sql("tag_events winners", "SELECT ns, tag, ms, digest, is_del FROM winners"))
def w1_stream_tag_states(t: Tables) -> DataFrame:
    """The last state that an updating stream hands to its sink."""
    folder = _folder(t)
    stream = live_tag_states(Streams(t.spark, t.folder).tag_events())
    upsert = lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out")
    stream.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    seen = t.spark.read.parquet(f"{folder}/out")
    return seen.groupBy("ns", "tag").agg(F.max_by(F.struct("ms", "digest", "is_del"), "batch").alias("s")).select("ns", "tag", "s.ms", "s.digest", "s.is_del")
