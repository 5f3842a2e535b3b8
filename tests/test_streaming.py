"""Streams over several batches."""

import random

import pytest
from pyspark.sql import functions as F

from tallyship.sources.shared import ensure_checkpoints
from tallyship.streaming.events import deliver, queue_depths, recorded_pulls
from tallyship.streaming.queue import enqueue_batches, enqueued


def _feed(spark, tmp_path, schema, batches, build):
    """Runs a stream over batches that come one after another, and returns all its rows."""
    source = tmp_path / "in"
    source.mkdir()
    out = []
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream.writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return out


def test_enqueue_keeps_locks_between_batches(spark, tmp_path):
    schema = "id string, queue string, lock_key string, seq int, done boolean"
    batches = [[("a", "q", "l", 1, False), ("b", "q", "l", 2, False)], [("c", "q", "l", 3, False), ("d", "q", "m", 3, False)], [("a", "q", "l", 4, True), ("e", "q", "l", 5, False)]]
    got = _feed(spark, tmp_path, schema, batches, enqueued)
    assert sorted((r[0], r[3], r[4]) for r in got) == [("a", "a", "miss"), ("b", "a", "hit"), ("c", "a", "hit"), ("d", "d", "miss"), ("e", "e", "miss")]


def test_a_hot_lock_is_folded_in_order(spark, tmp_path):
    """More rows of one lock in a trigger than an Arrow batch has, out of order, some of them ends of jobs."""
    schema = "id string, queue string, lock_key string, seq int, done boolean"
    rng, rows, want, job = random.Random(6), [], {}, None
    for seq in range(25_000):
        if job and rng.random() < 0.01:
            rows.append((job, "q", "l", seq, True))
            job = None
            continue
        if rng.random() < 0.01:
            rows.append(("never there", "q", "l", seq, True))
            continue
        i = f"j{seq}"
        job = job or i
        want[i] = (job, "miss" if job == i else "hit")
        rows.append((i, "q", "l", seq, False))
    rng.shuffle(rows)
    got = _feed(spark, tmp_path, schema, [rows], enqueued)
    assert {r[0]: (r[3], r[4]) for r in got} == want and len(got) == len(want)


def test_depths_are_reported_at_every_trigger(spark, tmp_path):
    jobs = spark.createDataFrame([("a", "q", "pending", 5), ("b", "q", "pending", 50), ("c", "q", "failed", 90)], "id string, queue string, state string, not_before_ms long")
    seen, now = [], iter([10, 60])
    build = lambda stream: queue_depths(stream, lambda: jobs, lambda: next(now), lambda counts: seen.append(sorted(map(tuple, counts.collect()))), str(tmp_path / "state"))
    for n in (1, 2):
        spark.createDataFrame([(n,)], "n int").write.mode("append").parquet(str(tmp_path / "in"))
        build(spark.readStream.schema("n int").parquet(str(tmp_path / "in"))).trigger(availableNow=True).start().awaitTermination()
    assert seen == [[("q", "failed", 1), ("q", "pending", 1)], [("q", "failed", 1), ("q", "pending", 2)]]


def test_pulls_are_recorded_once(spark, tmp_path):
    import datetime

    at = datetime.datetime(2024, 1, 1, 12)
    row = ("n", "t", "c", at)
    got = _feed(spark, tmp_path, "ns string, tag string, client string, at timestamp", [[row, row], [row, ("n", "t", "d", at)]], recorded_pulls)
    assert sorted(r[2] for r in got) == ["c", "d"]


def test_deliveries_retry_and_fail(spark, tmp_path):
    ensure_checkpoints(spark)
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "push", "a/b"), (2, "pull", "a/b")], "event_id long, kind string, repository string").write.parquet(source)
    endpoints = spark.createDataFrame([("good", "optional", ["push", "pull"], []), ("flaky", "optional", ["push"], []), ("bad", "required", ["pull"], ["^a/"]), ("other", "required", ["pull"], ["^z/"])], "endpoint string, policy string, kinds array<string>, filters array<string>")
    sent = []

    def send(rows, attempt):
        sent.append((attempt, sorted((r.event_id, r.endpoint) for r in rows.collect())))
        error = F.when((F.col("endpoint") == "bad") | ((F.col("endpoint") == "flaky") & F.lit(attempt == 0)), "500")
        return rows.withColumn("error", error)

    stream = spark.readStream.schema("event_id long, kind string, repository string").parquet(source)
    run = deliver(stream, endpoints, send, str(tmp_path / "state"), str(tmp_path / "failures")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="required endpoint bad failed"):
        run.awaitTermination()
    assert sent == [(0, [(1, "flaky"), (1, "good"), (2, "bad"), (2, "good")]), (1, [(1, "flaky"), (2, "bad")]), (2, [(2, "bad")])]
    assert [r.endpoint for r in spark.read.parquet(str(tmp_path / "failures")).collect()] == ["bad"]
    again = deliver(stream, endpoints, send, str(tmp_path / "state"), str(tmp_path / "failures")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="required endpoint bad failed"):
        again.awaitTermination()  # the batch is run again, and its failures are written anew, not twice
    assert [r.endpoint for r in spark.read.parquet(str(tmp_path / "failures")).collect()] == ["bad"]


def _enqueue_in_batches(spark, tmp_path, batches, check=lambda df: None):
    schema = "id string, queue string, lock_key string, seq int, done boolean"
    source, out = tmp_path / "in", []
    source.mkdir()

    def take(df, _):
        check(df)
        out.extend(map(tuple, df.collect()))

    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        enqueue_batches(stream, str(tmp_path / "queue"), take).trigger(availableNow=True).start().awaitTermination()
    return out


def test_batches_of_a_queue_follow_its_order(spark, tmp_path):
    """Five triggers over many locks and a hot one, out of order, with ends of jobs, of others' jobs and of none, and nulls as names."""
    rng, waits, want, batches, seq = random.Random(8), {}, {}, [], 0
    for batch in range(5):
        rows = []
        for _ in range(1 if batch == 2 else 12_000):
            seq += 1
            lock = rng.choice([("q", "hot"), ("q", f"l{rng.randrange(300)}"), ("p", f"l{rng.randrange(300)}"), ("q", None), ("only", f"{batch}")])
            job = waits.get(lock)
            if rng.random() < 0.2 and lock[0] != "only" and batch != 3:
                if job and rng.random() < 0.7:
                    rows.append((job, *lock, seq, True))
                    waits.pop(lock)
                else:
                    rows.append((rng.choice(["never there", *waits.values()][:3]) if not job else "never there", *lock, seq, True))
                continue
            i = f"j{seq}"
            job = waits.setdefault(lock, i)
            want[i] = (*lock, job, "miss" if job == i else "hit")
            rows.append((i, *lock, seq, None if rng.random() < 0.1 else False))
        rng.shuffle(rows)
        batches.append(rows)
    got = _enqueue_in_batches(spark, tmp_path, batches)
    assert {r[0]: r[1:] for r in got} == want and len(got) == len(want)


def test_arrivals_of_a_hot_lock_are_not_folded_in_python(spark, tmp_path):
    def check(df):
        assert "InPandas" not in df._jdf.queryExecution().executedPlan().toString()

    got = _enqueue_in_batches(spark, tmp_path, [[(f"j{n:05d}", "q", "l", n, False) for n in range(k, k + 100)] for k in (100, 0)], check)
    assert {r[3] for r in got} == {"j00100"} and len(got) == 200 and sum(r[4] == "miss" for r in got) == 1
