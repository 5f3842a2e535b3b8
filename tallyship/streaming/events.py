"""Streams of store events: recorded pulls, deliveries, live tags and queue depth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyship.operators import queue as Q
from tallyship.operators.routing import deliveries

REQUIRED, OPTIONAL, ASYNC = "required", "optional", "async"


def recorded_pulls(pulls: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Pulls (ns, tag, client, at), each client once per tag and millisecond; state is dropped behind the watermark."""
    keyed = pulls.withColumn("ms", F.unix_millis("at")).withWatermark("at", lateness)
    return keyed.dropDuplicatesWithinWatermark(["ns", "tag", "client", "ms"])


def live_tag_states(events: DataFrame) -> DataFrame:
    """The deciding event of every tag so far, for update or complete mode; the state is a row per tag.

    Of tied times the highest digest counts, then a set before a delete of it.
    """
    rank = F.struct(F.col("ms"), F.col("digest"), (~F.col("is_del")).alias("is_set"))
    best = events.groupBy("ns", "tag").agg(F.max(rank).alias("best"))
    return best.select("ns", "tag", "best.ms", "best.digest", (~F.col("best.is_set")).alias("is_del"))


def deliver(events: DataFrame, endpoints: DataFrame, send: Callable[[DataFrame, int], DataFrame], checkpoint: str, failures: str, attempts: int = 3):
    """Delivers every event to all endpoints that take it, batch by batch.

    ``send`` posts a batch's rows (from the executors) and returns them with ``error``,
    null where it went well. Failed rows are sent again, ``attempts`` times in all. What
    fails for good goes to the table ``failures``, in the batch's own folder, which a
    batch that is run again writes anew; if an endpoint of it is required, the batch
    fails once all others have been served, and will be run again.
    """

    def batch(rows: DataFrame, number: int) -> None:
        left = deliveries(rows, endpoints)
        for attempt in range(attempts):
            done = send(left, attempt).checkpoint()
            left = done.where("error IS NOT NULL").drop("error") if attempt + 1 < attempts else done.where("error IS NOT NULL")
            if left.isEmpty():
                return
        left.write.mode("overwrite").parquet(f"{failures}/batch={number}")
        bad = left.where(F.col("policy") == REQUIRED).limit(1).collect()
        if bad:
            raise RuntimeError(f"delivery to required endpoint {bad[0].endpoint} failed: {bad[0].error}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def queue_depths(trigger_rows: DataFrame, jobs: Callable[[], DataFrame], now_ms: Callable[[], int], report: Callable[[DataFrame], None], checkpoint: str):
    """At every trigger, counts due jobs of each queue and state and hands the counts on."""

    def batch(_: DataFrame, __: int) -> None:
        report(Q.depth(jobs(), now_ms()))

    return trigger_rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
