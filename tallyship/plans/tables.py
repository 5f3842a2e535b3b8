"""Queries over listings, counts, set operations and the job queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyship.operators import listing as L
from tallyship.operators import liveness as V
from tallyship.operators import maintenance as M
from tallyship.operators import queue as Q
from tallyship.operators import resolve as R
from tallyship.operators import routing as T
from tallyship.plans.registry import query
from tallyship.sources.adapters import Tables, with_sql


@query("SELECT o_orderkey, (SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM orders WHERE o_orderkey > 101 ORDER BY 1 LIMIT 100)) AS token FROM orders WHERE o_orderkey > 101 ORDER BY o_orderkey LIMIT 100")
def l1_keyset_page(t: Tables) -> DataFrame:
    return L.page(t.orders.select("o_orderkey"), "o_orderkey", 100, 101)


@query("SELECT r_name, NULL AS token FROM region WHERE r_name > 'A'")
def l1_last_page(t: Tables) -> DataFrame:
    return L.page(t.region.select("r_name"), "r_name", 5, "A")


@query("SELECT n_name, NULL AS token FROM nation WHERE false")
def l1_page_of_none(t: Tables) -> DataFrame:
    return L.page(t.nation.select("n_name"), "n_name", 0)


@query(with_sql("jobs", "SELECT id, queue, (SELECT max(id) FROM (SELECT id FROM jobs WHERE state = 'failed' ORDER BY id LIMIT 25)) AS token FROM jobs WHERE state = 'failed' ORDER BY id LIMIT 25"))
def l2_failed_job_page(t: Tables) -> DataFrame:
    return L.page(t.jobs().where("state = 'failed'").select("id", "queue"), "id", 25)


@query(with_sql("tag_events winners live", "SELECT name, (SELECT max(name) FROM (SELECT DISTINCT ns || ':' || tag AS name FROM live ORDER BY 1 LIMIT 40)) AS token FROM (SELECT DISTINCT ns || ':' || tag AS name FROM live ORDER BY 1 LIMIT 40)"))
def l3_tag_list_page(t: Tables) -> DataFrame:
    return L.page(R.live_tags(t.tag_events()).select(F.concat_ws(":", "ns", "tag").alias("name")), "name", 40)


@query("SELECT p_partkey AS digest, p_type AS artifact_type FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 50) WHERE p_type = 'ECONOMY'")
def l4_referrers_page(t: Tables) -> DataFrame:
    candidates = t.part.select(F.col("p_partkey").alias("digest"), F.col("p_type").alias("artifact_type"))
    return L.referrers_page(candidates, 50, "ECONOMY").select("digest", "artifact_type")


@query(with_sql("tag_events", "SELECT ns, bool_or(event_id % 50 = 0 OR event_id % 70 = 1) AS known FROM tag_events GROUP BY ns"))
def l5_known_namespaces(t: Tables) -> DataFrame:
    e = t.tag_events()
    return L.known_empty(e.where("event_id % 50 = 0"), e.where("event_id % 70 = 1"), e.select("ns").distinct())


@query(with_sql("tag_events winners live", "SELECT n.ns, coalesce(tags, 0) AS tags, coalesce(revisions, 0) AS revisions, coalesce(uploads, 0) AS uploads FROM (SELECT DISTINCT ns FROM tag_events) n LEFT JOIN (SELECT ns, count(*) AS tags FROM live GROUP BY ns) USING (ns) LEFT JOIN (SELECT ns, count(*) AS revisions FROM tag_events WHERE NOT is_del GROUP BY ns) USING (ns) LEFT JOIN (SELECT ns, count(*) AS uploads FROM tag_events WHERE event_id % 200 = 7 GROUP BY ns) USING (ns)"))
def a1_namespace_counts(t: Tables) -> DataFrame:
    e = t.tag_events()
    return L.counted(e.select("ns").distinct(), "ns", tags=R.live_tags(e), revisions=e.where("NOT is_del"), uploads=e.where("event_id % 200 = 7"))


@query(with_sql("tag_events repositories", "SELECT r.name AS repository, count(DISTINCT e.ns) AS namespaces FROM (SELECT name FROM repositories UNION ALL SELECT 'unused') r LEFT JOIN tag_events e ON starts_with(e.ns, r.name || '/') GROUP BY r.name"))
def a2_repository_counts(t: Tables) -> DataFrame:
    repos = t.repositories().select("name").union(t.spark.createDataFrame([("unused",)], "name string"))
    names = T.with_repository(t.tag_events().select("ns").distinct(), repos).where("repository IS NOT NULL")
    return L.counted(repos.withColumnRenamed("name", "repository"), "repository", namespaces=names)


@query(with_sql("jobs", "SELECT queue, state, least(count(*), 2000) AS jobs FROM jobs WHERE state <> 'pending' OR not_before_ms <= 900000000000 GROUP BY ALL"))
def a3_queue_depth(t: Tables) -> DataFrame:
    return Q.depth(t.jobs(), 900_000_000_000, 2000)


@query(with_sql("pulls", "SELECT ns, tag, coalesce(max(ms) FILTER (client <> 'client3'), max(ms) FILTER (client = 'client3')) AS ms FROM pulls GROUP BY ns, tag"))
def a4_latest_pull(t: Tables) -> DataFrame:
    current = F.col("client") != "client3"
    return t.pulls().groupBy("ns", "tag").agg(F.coalesce(F.max(F.when(current, F.col("ms"))), F.max(F.when(~current, F.col("ms")))).alias("ms"))


@query("SELECT o_custkey AS digest, greatest(max(o_orderkey), max(l_orderkey)) AS last FROM orders LEFT JOIN (SELECT l_orderkey, l_orderkey AS k FROM lineitem) ON k = o_orderkey GROUP BY o_custkey")
def a5_manifest_last_pull(t: Tables) -> DataFrame:
    tags = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_orderkey").alias("tag_pull"))
    joined = t.orders.join(tags, "o_orderkey", "left")
    return joined.groupBy(F.col("o_custkey").alias("digest")).agg(F.greatest(F.max("o_orderkey"), F.max("tag_pull")).alias("last"))


@query("SELECT l_partkey AS digest, concat('org', l_orderkey % 5) AS ns, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS entries FROM lineitem GROUP BY 1, 2")
def a6_reference_sets(t: Tables) -> DataFrame:
    refs = t.lineitem.select(F.col("l_partkey").alias("digest"), F.concat(F.lit("org"), (F.col("l_orderkey") % 5).cast("string")).alias("ns"), F.col("l_returnflag").alias("entry"))
    return V.reference_sets(refs).select("digest", "ns", F.array_join("entries", ",").alias("entries"))


@query("SELECT l_partkey AS digest, min(concat('org', l_orderkey % 5)) AS ns FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1")
def a7_smallest_other_namespace(t: Tables) -> DataFrame:
    refs = t.lineitem.select(F.col("l_partkey").alias("digest"), F.concat(F.lit("org"), (F.col("l_orderkey") % 5).cast("string")).alias("ns"))
    return V.smallest_other_namespace(refs, "org0")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_content FROM customer")
def a9_existence(t: Tables) -> DataFrame:
    has = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    return t.customer.select("c_custkey").join(has, "c_custkey", "left").select("c_custkey", F.col("has").isNotNull().alias("has_content"))


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus = 'O') AS converted, count(*) FILTER (o_totalprice < 0) AS refused FROM orders")
def a10_tallies(t: Tables) -> DataFrame:
    return M.tallies(t.orders, failed=F.col("o_orderstatus") == "F", converted=F.col("o_orderstatus") == "O", refused=F.col("o_totalprice") < 0)


@query("SELECT event_type AS kind, count(*) AS requests, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 50) AS le_50, count(*) FILTER (value <= 100) AS le_100, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def a11_histograms(t: Tables) -> DataFrame:
    buckets = [F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in (10, 50, 100)]
    return t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("requests"), *buckets, F.min("value").alias("least"), F.max("value").alias("most"))


@query("SELECT l_orderkey AS digest, sum(l_quantity::BIGINT)::BIGINT AS size FROM lineitem GROUP BY 1")
def a14_layer_sizes(t: Tables) -> DataFrame:
    layers = t.lineitem.groupBy(F.col("l_orderkey").alias("digest")).agg(F.collect_list(F.col("l_quantity").cast("bigint")).alias("sizes"))
    return layers.select("digest", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("size"))


@query("SELECT l_orderkey AS digest FROM lineitem WHERE l_returnflag = 'R' UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def u2_union_of_revisions(t: Tables) -> DataFrame:
    return t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("digest")).union(t.orders.where("o_orderstatus = 'O'").select("o_orderkey")).distinct()


@query("SELECT l_partkey AS referrer FROM lineitem WHERE l_linestatus = 'F' UNION SELECT p_partkey FROM part WHERE p_size > 40")
def u3_union_of_referrers(t: Tables) -> DataFrame:
    return t.lineitem.where("l_linestatus = 'F'").select(F.col("l_partkey").alias("referrer")).union(t.part.where("p_size > 40").select("p_partkey")).distinct()


@query(with_sql("tag_events", "SELECT ns FROM tag_events WHERE event_id % 2 = 0 UNION SELECT 'upload/' || user_id FROM tag_events WHERE event_id % 2 = 1"))
def u5_namespaces_of_stores(t: Tables) -> DataFrame:
    e = t.tag_events()
    return e.where("event_id % 2 = 0").select("ns").union(e.where("event_id % 2 = 1").select(F.concat(F.lit("upload/"), F.col("user_id").cast("string")))).distinct()


@query(with_sql("tag_events winners live", "SELECT ns FROM live UNION SELECT ns FROM tag_events WHERE is_del AND value > 90 UNION SELECT ns FROM tag_events WHERE starts_with(ns, 'org0/')"))
def u6_scoped_namespaces(t: Tables) -> DataFrame:
    e = t.tag_events()
    return R.live_tags(e).select("ns").union(e.where("is_del AND value > 90").select("ns")).union(e.where(F.startswith("ns", F.lit("org0/"))).select("ns")).distinct()


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'cache' WHEN o_orderkey % 3 = 1 THEN 'cache,replication' ELSE 'replication,cache' END AS queues FROM orders")
def u8_repeated_options(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 3
    a = lambda *x: F.array(*(F.lit(v) for v in x))
    given = F.when(k == 0, a("cache", "cache")).when(k == 1, a("cache", "replication", "cache")).otherwise(a("replication", "cache", "replication"))
    return t.orders.select("o_orderkey", F.array_join(F.array_distinct(given), ",").alias("queues"))


@query(
    with_sql(
        "jobs",
        "SELECT id, coalesce(w, f) AS job, CASE WHEN coalesce(w, f) = id THEN 'miss' ELSE 'hit' END AS outcome FROM a LEFT JOIN waiting USING (queue, lock_key)",
        """waiting AS (SELECT queue, lock_key, min(id) AS w FROM jobs WHERE state = 'pending' AND seq % 2 = 0 GROUP BY ALL),
a AS (SELECT *, first_value(id) OVER (PARTITION BY queue, lock_key ORDER BY seq, id) AS f FROM jobs WHERE NOT (state = 'pending' AND seq % 2 = 0))""",
    )
)
def t3_enqueue_dedup(t: Tables) -> DataFrame:
    j = t.jobs()
    waits = "state = 'pending' AND seq % 2 = 0"
    return Q.enqueue(j.where(f"NOT ({waits})"), j.where(waits)).select("id", "job", "outcome")


@query(with_sql("jobs", "SELECT queue, lock_key, id FROM jobs WHERE state = 'pending' AND not_before_ms <= 900000000000 AND NOT poison AND lock_key NOT IN ('lock1', 'lock4') QUALIFY row_number() OVER (PARTITION BY queue, lock_key ORDER BY not_before_ms, id) = 1"))
def t4_claimable_jobs(t: Tables) -> DataFrame:
    claims = t.spark.createDataFrame([(q, k, e) for q in ("cache", "replication") for k, e in (("lock1", 10**12), ("lock4", 9 * 10**11), ("lock7", 10))], "queue string, lock_key string, expires_ms bigint")
    return Q.claimable(t.jobs().where("state = 'pending'"), claims, 900_000_000_000).select("queue", "lock_key", "id")


@query(with_sql("jobs", "SELECT id, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= 3 OR poison THEN 'failed' ELSE 'pending' END AS state, CASE WHEN attempts + 1 >= 3 OR poison THEN not_before_ms ELSE 900000000000 + least(100 * pow(2, attempts), 10000)::BIGINT END AS not_before_ms FROM jobs WHERE state = 'pending'"))
def t5_retry_or_set_aside(t: Tables) -> DataFrame:
    j = t.jobs().where("state = 'pending'").withColumn("max_attempts", F.lit(3))
    return Q.fail(j, 900_000_000_000, F.col("poison")).select("id", "attempts", "state", "not_before_ms")


@query(with_sql("jobs", "SELECT id, CASE WHEN again THEN 'pending' ELSE state END AS state, CASE WHEN again THEN 0 ELSE attempts END AS attempts, CASE WHEN again THEN 5 ELSE not_before_ms END AS not_before_ms FROM (SELECT *, state = 'failed' AND seq % 2 = 0 AS again FROM jobs)"))
def t6_retry_failed(t: Tables) -> DataFrame:
    return Q.retry(t.jobs(), 5, F.col("seq") % 2 == 0).select("id", "state", "attempts", "not_before_ms")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 120 < 1000 ELSE o_orderkey < 1000 END AS stale FROM orders")
def t7_stale_claims(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", Q.stale(F.when(k % 3 > 0, k), k, 1000, 60).alias("stale"))


@query(with_sql("tag_events", """SELECT event_id, CASE WHEN failures < 2 THEN 'closed' WHEN ms - last >= 3600000 THEN 'half_open' ELSE 'open' END AS state FROM (
  SELECT event_id, ms, coalesce(sum((NOT ok)::INT) OVER w, 0) AS failures, max(CASE WHEN NOT ok THEN ms END) OVER w AS last FROM (
    SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY ns ORDER BY ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM (SELECT *, tag <> 'error' AND tag <> 'view' AS ok FROM tag_events))
  WINDOW w AS (PARTITION BY ns, run ORDER BY ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""))
def t10_circuit_breaker(t: Tables) -> DataFrame:
    calls = t.tag_events().withColumn("ok", ~F.col("tag").isin("error", "view"))
    return Q.breaker_states(calls, "ns", 2, 3_600_000).select("event_id", "state")


@query(with_sql("tag_events winners live", "SELECT w.event_id, l.digest FROM tag_events w LEFT JOIN live l USING (ns, tag)"))
def t11_resolve_at_run_time(t: Tables) -> DataFrame:
    e = t.tag_events()
    now = R.live_tags(e).select("ns", "tag", "digest")
    return e.select("event_id", "ns", "tag").join(now, ["ns", "tag"], "left").select("event_id", "digest")


@query(with_sql("pulls", "SELECT DISTINCT ns, tag, ms - ms % 86400000 AS day, client FROM pulls"))
def t13_recorded_pulls(t: Tables) -> DataFrame:
    return t.pulls().select("ns", "tag", (F.col("ms") - F.col("ms") % 86_400_000).alias("day"), "client").dropDuplicates(["ns", "tag", "day", "client"])


@query(with_sql("tag_events winners live", "SELECT ns, digest, row_number() OVER (PARTITION BY ns ORDER BY CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN event_id % 2 = 0 THEN tag END, digest) AS position FROM live"))
def l6_display_order(t: Tables) -> DataFrame:
    live = R.live_tags(t.tag_events())
    roots = live.select("ns", "digest", F.when(F.col("event_id") % 2 == 0, F.array("tag")).otherwise(F.array().cast("array<string>")).alias("tags"))
    return L.display_order(roots).select("ns", "digest", "position")


@query(with_sql("tag_events", "SELECT event_id FROM tag_events WHERE digest BETWEEN concat('sha256:', repeat('3', 64)) AND concat('sha256:', repeat('5', 64)) OR digest BETWEEN concat('sha256:', repeat('a', 64)) AND concat('sha256:', repeat('b', 64))"))
def p16_collection_ranges(t: Tables) -> DataFrame:
    full = lambda d: f"sha256:{d * 64}"
    rows = [(full("3"), full("5"), 10), (full("a"), full("b"), 11), (full("c"), full("d"), 9)]
    markers = t.spark.createDataFrame(rows, "first string, last string, expires_ms bigint")
    return V.blocked_by_collection(t.tag_events().select("event_id", "digest"), markers, 10).select("event_id")


@query(with_sql("tag_events", """SELECT event_id, coalesce(ms - kept < 7200000, false) AS served FROM (SELECT event_id, ms, max(CASE WHEN tag IN ('view', 'click', 'error') THEN ms END) OVER (PARTITION BY user_id % 50 ORDER BY ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM tag_events)"""))
def t9_decision_cache(t: Tables) -> DataFrame:
    status = F.when(F.col("tag") == "view", 200).when(F.col("tag") == "click", 401).when(F.col("tag") == "error", 403).otherwise(500)
    calls = t.tag_events().select("event_id", "ms", status.alias("status"), (F.col("user_id") % 50).alias("authorization"), F.lit(None).cast("string").alias("cookie"))
    return Q.cached_decisions(calls, ["cookie", "authorization"], 7_200_000).select("event_id", "served")


@query("SELECT 'l' || conv_id % 10 || '/' || conv_id AS listing, turn AS position, i.place, CASE i.place WHEN 0 THEN role ELSE 'same' END AS item FROM conversations, (VALUES (0), (2), (3)) i(place)")
def s22_remote_listing(t: Tables) -> DataFrame:
    """Every conversation is a listing whose last page links back to its first; one of the four items has no valid name."""
    from tallyship.functions.grammar import is_tag
    from tallyship.sources.shared import ensure_checkpoints

    ensure_checkpoints(t.spark)
    listing = F.concat(F.lit("l"), (F.col("conv_id") % 10).cast("string"), F.lit("/"), F.col("conv_id").cast("string"))
    last = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last"))
    turn = F.col("turn")
    items = F.array(F.col("role"), F.lit("no name!"), F.lit("same"), F.lit("same"))
    pages = t.conversations.join(last, "conv_id").select(listing.alias("listing"), turn.alias("location"), F.when(turn < F.col("last"), turn + 1).otherwise(F.lit(0)).alias("next"), (turn == 0).alias("first"), items.alias("items"))
    return L.remote_items(pages, is_tag(F.col("item")))
