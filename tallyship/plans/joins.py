"""Queries over liveness, reconciliation and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyship.functions.scalars import epoch_millis
from tallyship.operators import diff as D
from tallyship.operators import graph as G
from tallyship.operators import liveness as L
from tallyship.operators import resolve as R
from tallyship.operators import retention as P
from tallyship.operators import routing as T
from tallyship.plans.registry import query
from tallyship.sources import sinks as N
from tallyship.sources.adapters import DAY_MS, NOW_MS, Tables, with_sql


@query(with_sql("tag_events winners live pulls", "SELECT l.ns, l.tag, greatest(max(p.ms), any_value(l.ms)) AS pulled_ms FROM live l LEFT JOIN pulls p USING (ns, tag) GROUP BY l.ns, l.tag"))
def j1_last_pull(t: Tables) -> DataFrame:
    live = R.live_tags(t.tag_events())
    return P.with_last_pull(live, t.pulls(), "ms").select("ns", "tag", "pulled_ms")


@query("SELECT o_custkey AS digest, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS tags, c_mktsegment AS kind FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY o_custkey, c_mktsegment UNION ALL SELECT c_custkey, '', c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j2_tags_of_revisions(t: Tables) -> DataFrame:
    tags = t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("tags"))
    return t.customer.join(tags, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("digest"), F.coalesce("tags", F.lit("")).alias("tags"), F.col("c_mktsegment").alias("kind"))


@query(with_sql("edges", "SELECT target, count(*) AS parents, min(digest) AS first_parent FROM edges GROUP BY target"))
def j3_parents_of_children(t: Tables) -> DataFrame:
    return t.edges().groupBy("target").agg(F.count(F.lit(1)).alias("parents"), F.min("digest").alias("first_parent"))


@query("""SELECT subject, string_agg(referrer::VARCHAR, ',' ORDER BY referrer) AS referrers, count(predicate) AS with_predicate FROM (
  SELECT l_partkey AS subject, l_orderkey AS referrer, CASE WHEN min(l_linenumber) FILTER (l_returnflag = 'R') IS NOT NULL THEN 1 END AS predicate FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2) GROUP BY subject""")
def j4_annotated_referrers(t: Tables) -> DataFrame:
    found = t.lineitem.where("l_linestatus = 'F'").groupBy(F.col("l_partkey").alias("subject"), F.col("l_orderkey").alias("referrer")).agg(F.min(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("predicate"))
    return found.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_list("referrer")), ",").alias("referrers"), F.count("predicate").alias("with_predicate"))


@query(with_sql("tag_events repositories", "SELECT DISTINCT e.ns, r.name AS repository FROM tag_events e LEFT JOIN repositories r ON e.ns = r.name OR starts_with(e.ns, r.name || '/')"))
def j5_repository_of_namespace(t: Tables) -> DataFrame:
    return T.with_repository(t.tag_events().select("ns").distinct(), t.repositories())


def _live_orders(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("digest"))


_REFS = """refs AS (SELECT DISTINCT concat('org', l_orderkey % 5) AS ns, l_partkey AS digest, CASE l_orderkey % 4 WHEN 0 THEN 'referenced_by' WHEN 1 THEN 'layer' WHEN 2 THEN 'tag' ELSE 'referrer' END AS kind, l_orderkey AS other, 'o' || l_orderkey AS name, l_orderkey AS entry FROM lineitem),
rev AS (SELECT concat('org', o_orderkey % 5) AS ns, o_orderkey AS digest FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'),
backed AS (SELECT r.* FROM refs r JOIN rev v ON r.ns = v.ns AND r.other = v.digest WHERE r.kind = 'referenced_by' UNION ALL
  SELECT r.* FROM refs r WHERE r.kind = 'layer' AND EXISTS (SELECT 1 FROM refs x JOIN rev v ON x.ns = v.ns AND x.other = v.digest WHERE x.ns = r.ns AND x.digest = r.digest AND x.kind = 'layer') UNION ALL
  SELECT r.* FROM refs r WHERE r.kind = 'tag' AND r.other % 3 = 0 UNION ALL SELECT r.* FROM refs r WHERE r.kind = 'referrer' AND r.other % 7 = 0)"""


def _references(t: Tables) -> tuple[DataFrame, DataFrame]:
    """References of parts by orders, of four kinds by order, and those that are backed."""
    k = F.col("l_orderkey")
    kind = F.when(k % 4 == 0, "referenced_by").when(k % 4 == 1, "layer").when(k % 4 == 2, "tag").otherwise("referrer")
    ns = F.concat(F.lit("org"), (k % 5).cast("string"))
    refs = t.order_parts().select(ns.alias("ns"), F.col("l_partkey").alias("digest"), kind.alias("kind"), k.alias("other"), F.concat(F.lit("o"), k.cast("string")).alias("name"), k.alias("entry"))
    rev = _live_orders(t).withColumn("ns", F.concat(F.lit("org"), (F.col("digest") % 5).cast("string")))
    tags = refs.where("kind = 'tag' AND other % 3 = 0").select("ns", F.col("name").alias("tag"), "digest")
    records = refs.where("kind = 'referrer' AND other % 7 = 0").select("ns", F.col("other").alias("subject"), F.col("digest").alias("referrer"))
    tracked = refs.where("kind = 'layer'").groupBy("ns", "kind", F.col("digest").alias("target")).agg(F.collect_set("other").alias("referenced_by"))
    return refs, L.backed_references(refs, tags, rev, records, tracked)


@query(f"WITH {_REFS} SELECT ns, digest, kind, other FROM backed")
def j6_backed_references(t: Tables) -> DataFrame:
    return _references(t)[1].select("ns", "digest", "kind", "other")


@query("""SELECT p_partkey AS digest FROM part WHERE p_partkey % 10 > 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')
AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 1000 = 1 OR l_orderkey % 1000 = 2)""")
def j7_orphan_blobs(t: Tables) -> DataFrame:
    """Young parts stay (every tenth), young references and unreadable ones pin."""
    blobs = t.part.select(F.col("p_partkey").alias("digest"), F.when(F.col("p_partkey") % 10 > 0, F.lit(NOW_MS - DAY_MS)).alias("modified_ms"))
    k = F.col("l_orderkey")
    refs = t.lineitem.select(F.col("l_partkey").alias("digest"), k.alias("order"), F.when(k % 1000 == 1, F.lit(NOW_MS)).otherwise(F.lit(0)).alias("modified_ms"), (k % 1000 == 2).alias("unreadable"))
    backed = refs.join(_live_orders(t).select(F.col("digest").alias("order")), "order", "left_semi")
    return L.orphan_blobs(blobs, refs, backed, NOW_MS, 300_000).select("digest")


@query(f"WITH {_REFS} SELECT ns, digest, entry FROM refs r WHERE entry % 9 > 0 AND digest % 6 > 0 AND (ns, digest, entry) NOT IN (SELECT (ns, digest, entry) FROM backed)")
def j8_dangling_references(t: Tables) -> DataFrame:
    refs, backed = _references(t)
    aged = refs.withColumn("modified_ms", F.when(F.col("entry") % 9 > 0, F.lit(0)))
    blobs = t.part.where("p_partkey % 6 > 0").select(F.col("p_partkey").alias("digest"))
    return L.dangling_references(aged, backed, blobs, NOW_MS, 300_000).select("ns", "digest", "entry")


@query(f"WITH {_REFS} SELECT ns, digest, entry FROM refs WHERE entry % 9 > 0 AND digest % 6 = 0")
def j9_byteless_references(t: Tables) -> DataFrame:
    refs = _references(t)[0].withColumn("modified_ms", F.when(F.col("entry") % 9 > 0, F.lit(0)))
    blobs = t.part.where("p_partkey % 6 > 0").select(F.col("p_partkey").alias("digest"))
    return L.byteless_references(refs, blobs, NOW_MS, 300_000).select("ns", "digest", "entry")


@query(f"""SELECT concat('org', o_orderkey % 5) AS ns, o_orderkey AS digest FROM orders WHERE {NOW_MS} - epoch_us(o_orderdate) // 1000 >= 800000000000 // 4 AND o_orderkey % 4 > 0 AND (o_orderkey % 5 = 4
  OR (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderpriority <> '1-URGENT'))""")
def j10_orphan_grants(t: Tables) -> DataFrame:
    r = t.revisions().withColumn("repository", F.when(F.col("ns") != "org4", F.col("ns")))
    grants = r.withColumn("modified_ms", F.when(F.col("digest") % 4 > 0, F.col("ms")))
    tracked = t.edges().select("ns", F.col("digest").alias("target")).distinct()
    retained = r.where("priority = '1-URGENT'")
    return L.orphan_grants(grants, tracked, retained, True, NOW_MS, 200_000_000_000).select("ns", "digest")


@query(with_sql("tag_events", "SELECT DISTINCT ns FROM tag_events WHERE starts_with(ns, 'org4/')"))
def j11_orphan_namespaces(t: Tables) -> DataFrame:
    names = t.tag_events().select("ns").distinct()
    return L.orphan_namespaces(names, t.repositories(), T.with_repository(names, t.repositories()))


@query("SELECT 1 AS x WHERE false")
def j11_no_repositories_no_sweep(t: Tables) -> DataFrame:
    names, none = t.tag_events().select("ns").distinct(), t.repositories().limit(0)
    return L.orphan_namespaces(names, none, T.with_repository(names, none)).select(F.lit(1).alias("x"))


@query(with_sql("jobs", "SELECT id FROM jobs WHERE seq % 5 > 0 AND seq % 4 = 3"))
def j12_orphan_jobs(t: Tables) -> DataFrame:
    jobs = t.jobs().withColumn("downstream", F.when(F.col("seq") % 5 > 0, F.concat(F.lit("d"), (F.col("seq") % 4).cast("string"))))
    return L.orphan_jobs(jobs, t.spark.createDataFrame([("d0",), ("d1",), ("d2",)], "name string")).select("id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 > 0 AND o_orderkey % 3 > 0 AND o_orderkey % 7 > 0")
def j13_orphan_multiparts(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.lit("a/b").alias("ns"), F.col("o_orderkey").cast("string").alias("session"), (F.col("o_orderkey") % 10 == 0).alias("probe_failed"))
    return L.orphan_multiparts(o, o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 7 = 0")).select("o_orderkey")


_DIFF = """SELECT coalesce(l.tag, r.tag) AS tag, l.digest AS local, r.digest AS remote, CASE WHEN r.failed THEN 'skipped' WHEN l.tag IS NULL THEN '{}' WHEN l.digest IS NOT DISTINCT FROM r.digest THEN 'converged' ELSE 'push' END AS action FROM local l FULL JOIN remote r ON l.tag = r.tag"""


@query(with_sql("local remote", _DIFF.format("delete")))
def j14_reconcile(t: Tables) -> DataFrame:
    return D.reconcile(*t.mirrors(), ["tag"], prune=True)


@query(with_sql("local remote", _DIFF.format("keep")))
def j14_reconcile_without_prune(t: Tables) -> DataFrame:
    return D.reconcile(*t.mirrors(), ["tag"], prune=False)


@query(with_sql("tag_events winners live", "SELECT ns, tag, digest FROM live WHERE user_id % 2 = 0"))
def j16_resolvable_tags(t: Tables) -> DataFrame:
    live = R.live_tags(t.tag_events())
    revisions = t.tag_events().where("user_id % 2 = 0").select("ns", "digest")
    return live.join(revisions, ["ns", "digest"], "left_semi").select("ns", "tag", "digest")


@query("""SELECT ns, digest, policy, CASE WHEN digest % 3 > 0 THEN 'keep' WHEN policy = 'strict' THEN 'fail' WHEN policy = 'permissive' THEN 'drop' WHEN digest % 2 = 0 THEN 'grant' ELSE 'fail' END AS action
FROM (SELECT DISTINCT concat('org', l_orderkey % 5) AS ns, l_partkey AS digest FROM lineitem), (VALUES ('strict'), ('permissive'), ('trusted')) p(policy)""")
def j17_missing_references(t: Tables) -> DataFrame:
    wanted = t.lineitem.select(F.concat(F.lit("org"), (F.col("l_orderkey") % 5).cast("string")).alias("ns"), F.col("l_partkey").alias("digest")).distinct()
    granted, blobs = wanted.where("digest % 3 > 0"), wanted.where("digest % 2 = 0")
    parts = [L.check_references(wanted, granted, blobs, p).withColumn("policy", F.lit(p)) for p in ("strict", "permissive", "trusted")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("ns", "digest", "policy", "action")


@query(f"WITH {_REFS} SELECT DISTINCT digest, ns FROM refs QUALIFY dense_rank() OVER (PARTITION BY digest ORDER BY ns) <= 2")
def j18_mount_candidates(t: Tables) -> DataFrame:
    names = _references(t)[0].select("digest", "ns").distinct()
    return R.newest_per_key(names, ["digest"], [F.col("ns")], 2).select("digest", "ns")


@query(f"WITH {_REFS} SELECT DISTINCT ns, digest FROM backed UNION SELECT DISTINCT ns, digest FROM refs WHERE digest % 50 = 0")
def j19_readable_blobs(t: Tables) -> DataFrame:
    refs, backed = _references(t)
    return refs.where("digest % 50 = 0").select("ns", "digest").union(backed.select("ns", "digest")).distinct()


@query(with_sql("jobs", "SELECT queue, id AS job FROM jobs WHERE state = 'failed'"))
def j20_orphan_lock_index(t: Tables) -> DataFrame:
    from tallyship.operators.queue import orphan_index

    jobs = t.jobs()
    return orphan_index(jobs.select("queue", F.col("id").alias("job")), jobs.where("state = 'pending'")).select("queue", "job")


@query(f"WITH {_REFS} SELECT p_partkey AS digest FROM part WHERE p_partkey NOT IN (SELECT digest FROM backed WHERE ns <> 'org1')")
def j21_deletable_blobs(t: Tables) -> DataFrame:
    backed = _references(t)[1].where("ns <> 'org1'")
    return t.part.select(F.col("p_partkey").alias("digest")).join(backed.select("digest"), "digest", "left_anti")


@query("SELECT DISTINCT l_partkey AS digest FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F')")
def j22_transfer_set(t: Tables) -> DataFrame:
    i = t.lineitem.select(F.col("l_partkey").alias("digest"), "l_returnflag", "l_linestatus")
    return L.transfer_set(i.where("l_returnflag = 'R'"), i.where("l_returnflag = 'A' AND l_linestatus = 'F'"))


@query(with_sql("tag_events winners live", f"SELECT ns, tag, CASE WHEN event_id % 3 = 0 THEN 'delete_manifest' WHEN event_id % 4 = 0 THEN 'recreate_link' ELSE 'ok' END AS action FROM live WHERE {NOW_MS} - ms >= {2 * DAY_MS}"))
def j23_tag_targets(t: Tables) -> DataFrame:
    e = t.tag_events()
    out = L.tag_targets(R.live_tags(e), e.where("event_id % 3 > 0"), e.where("event_id % 4 > 0"), NOW_MS, 2 * DAY_MS)
    return out.select("ns", "tag", "action")


@query(with_sql("edges", """SELECT ns, digest AS name, target, action FROM edges, (VALUES ('recreate_link'), ('grant')) a(action) WHERE (target % 5 = 0 OR target % 5 = 1) AND (action = 'recreate_link' OR target % 2 = 0)"""))
def j24_missing_links(t: Tables) -> DataFrame:
    expected = t.edges().select("ns", "kind", F.concat_ws("-", "digest", "target").alias("name"), "target", "digest")
    actual = expected.where("target % 5 <> 0").withColumn("target", F.when(F.col("target") % 5 == 1, F.lit(-1)).otherwise(F.col("target")))
    blobs = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("digest"))
    return L.missing_links(expected, actual, blobs).select("ns", F.col("digest").alias("name"), "target", "action")


@query(with_sql("revisions", f"SELECT ns, digest AS referrer FROM revisions WHERE {NOW_MS} - ms >= 800000000000 AND status = 'F'"))
def j25_dead_referrers(t: Tables) -> DataFrame:
    r = t.revisions()
    records = r.select("ns", F.col("digest").alias("referrer"), F.col("ms").alias("modified_ms"))
    return L.dead_referrers(records, r.where("status <> 'F'"), NOW_MS, 800_000_000_000).select("ns", "referrer")


@query("""SELECT l_partkey AS digest, bool_and(o_orderstatus IS NOT NULL AND o_orderstatus <> 'F') AS all_live, count(*) AS members FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def j26_back_reference_sets(t: Tables) -> DataFrame:
    sets = t.lineitem.groupBy(F.lit("a").alias("ns"), F.col("l_partkey").alias("digest")).agg(F.collect_set("l_orderkey").alias("referenced_by"))
    live = t.orders.where("o_orderstatus <> 'F'").select(F.lit("a").alias("ns"), F.col("o_orderkey").alias("digest"))
    return L.rehomed_back_references(sets, live)[1].select("digest", "all_live", "members")


@query(with_sql("tag_events", "SELECT DISTINCT ns FROM tag_events WHERE user_id % 3 > 0"))
def j27_uncatalogued_namespaces(t: Tables) -> DataFrame:
    e = t.tag_events()
    return e.select("ns").distinct().join(e.where("user_id % 3 = 0").select("ns"), "ns", "left_anti")


@query("SELECT l_orderkey AS digest, count(DISTINCT l_partkey) AS layers, count(DISTINCT l_partkey) + 1 + (l_orderkey % 2 = 0)::INT AS steps FROM lineitem GROUP BY l_orderkey")
def g1_edges_and_push_plan(t: Tables) -> DataFrame:
    part = F.struct(F.col("l_partkey").cast("string").alias("digest"))
    m = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("digest"), F.col("l_orderkey").alias("n")).agg(F.collect_set(part).alias("layers"))
    no = F.lit(None).cast("struct<digest:string>")
    body = F.struct(no.alias("config"), F.col("layers"), F.lit(None).cast("array<struct<digest:string>>").alias("manifests"), no.alias("subject"))
    rows = m.select(F.lit("a").alias("ns"), "digest", "n", body.alias("m"))
    steps = G.push_plan(rows, F.when(F.col("n") % 2 == 0, F.array(F.lit("latest")))).groupBy("digest").agg(F.count(F.lit(1)).alias("steps"))
    return G.edges(rows).groupBy("digest").agg(F.count(F.lit(1)).alias("layers")).join(steps, "digest").select(F.col("digest").cast("bigint").alias("digest"), "layers", "steps")


@query("""SELECT o_orderkey AS digest, 'revision' AS kind, o_orderkey::VARCHAR AS name FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'tag', 't' || o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 3 = 0
UNION ALL SELECT DISTINCT l_orderkey, 'layer', l_partkey::VARCHAR FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'""")
def g3_delete_plan(t: Tables) -> DataFrame:
    o = t.orders.select(F.lit("a").alias("ns"), F.col("o_orderkey").alias("digest"), "o_orderstatus", F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("tag"))
    return G.delete_plan(o.where("o_orderstatus = 'P'").select("ns", "digest"), o.where("digest % 3 = 0"), t.edges().withColumn("ns", F.lit("a"))).select("digest", "kind", F.col("name").cast("string").alias("name"))


@query("""SELECT 'chat' || conv_id % 3 AS ns, format('c{:05d}-{:03d}', conv_id, turn) AS digest, (last - turn)::INT AS round FROM (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last, max(CASE WHEN conv_id % 4 = 1 AND turn = 1 THEN turn WHEN conv_id % 7 = 0 THEN turn END) OVER (PARTITION BY conv_id) AS held FROM conversations) WHERE held IS NULL OR turn > held""")
def g4_orphan_cascade(t: Tables) -> DataFrame:
    """Every turn refers to the one before; a pinned turn keeps itself and all below it."""
    from tallyship.sources.shared import ensure_checkpoints

    ensure_checkpoints(t.spark)
    turns = t.turns()
    pins = turns.where("conv_id % 4 = 1 AND turn = 1")
    edges = turns.where("target IS NOT NULL").select("ns", "digest", "target")
    return G.orphan_cascade(turns.select("ns", "digest"), pins, edges, turns.where("conv_id % 7 <> 0"))


@query(with_sql("turns", "SELECT ns, format('c{:05d}-{:03d}', conv_id, last) AS root, digest, (last - turn)::INT AS depth, last - turn > 4 AS too_deep FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM turns) WHERE last - turn <= 5"))
def g5_push_order(t: Tables) -> DataFrame:
    turns = t.turns()
    roots = turns.groupBy("ns", "conv_id").agg(F.max("digest").alias("digest"))
    return G.push_order(turns.where("target IS NOT NULL"), roots, 4)


@query(with_sql("turns", "SELECT r.ns, r.digest, coalesce(r.target, '') AS children FROM (SELECT * FROM turns QUALIFY turn = max(turn) OVER (PARTITION BY conv_id)) r"))
def g6_manifest_tree(t: Tables) -> DataFrame:
    turns = t.turns()
    own = turns.select("ns", "digest", F.col("digest").alias("target"))  # references to oneself, which do not count
    edges = turns.where("target IS NOT NULL").select("ns", "digest", "target").unionByName(own)
    return G.tree(edges, turns.select("ns", "digest")).select("ns", "digest", F.array_join("children", ",").alias("children"))


@query(with_sql("edges", "SELECT DISTINCT ns, target AS digest FROM edges WHERE target % 4 = 0 AND target % 3 > 0"))
def g7_rebuilt_index(t: Tables) -> DataFrame:
    e = t.edges()
    named = e.select("ns", F.col("target").alias("digest"), "kind").distinct()
    return G.rebuilt_index(e, named.where("digest % 4 = 0"), named.where("digest % 3 = 0")).select("ns", "digest")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN 2 ELSE 1 END AS kept FROM customer")
def u7_index_descriptors(t: Tables) -> DataFrame:
    d = lambda k: F.struct(F.lit(k).alias("digest"), F.col("c_custkey").alias("size"))
    k = F.col("c_custkey") % 3
    index = F.when(k == 0, F.array(d("a"))).when(k == 1, F.array(d("a"), d("b"), d("c"))).otherwise(F.array(d("a"), d("b")))
    return t.customer.select("c_custkey", F.coalesce(F.size(G.without_descriptor(G.with_descriptor(index, d("b")), F.lit("b"))), F.lit(0)).alias("_b"), F.coalesce(F.size(G.without_descriptor(index, F.lit("a"))), F.lit(0)).alias("kept")).drop("_b")


@query(with_sql("edges", "SELECT digest, 0 AS wave, count(*) AS n FROM edges GROUP BY digest UNION ALL SELECT o_orderkey, 1, 1 FROM orders UNION ALL SELECT o_orderkey, 2, 1 FROM orders WHERE o_orderkey % 2 = 0"))
def k6_write_waves(t: Tables) -> DataFrame:
    o = t.revisions().select("digest", F.lit("revision").alias("kind"))
    ops = t.edges().select("digest", "kind").unionByName(o).unionByName(o.where("digest % 2 = 0").withColumn("kind", F.lit("tag")))
    return N.mutation_waves(ops).groupBy("digest", "wave").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'converged' WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 = 2 THEN 'superseded' ELSE 'pushed' END AS outcome FROM orders")
def t12_push_outcomes(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    ms = epoch_millis(F.col("o_orderdate"))
    remote = F.when(k % 4 == 0, "d5").when(k % 4 == 1, F.concat(F.lit("d"), (k % 3 + 4).cast("string"))).otherwise(F.lit(None))
    outcome = D.push_outcome(F.when(k % 4 < 2, ms), F.when((k % 4 == 1) & (k % 3 == 1), "d4").otherwise(remote), ms, F.lit("d5"))
    return t.orders.select("o_orderkey", outcome.alias("outcome"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'grant' WHEN doc_id % 3 = 1 THEN 'store' ELSE 'reject' END AS action FROM documents WHERE text IS NOT NULL AND text <> ''")
def t15_cache_fill(t: Tables) -> DataFrame:
    """Bytes that are there get a grant; fetched ones are stored if their digest is the one asked for."""
    from tallyship.functions.grammar import digest_of

    d = t.documents.where("text IS NOT NULL AND text <> ''").select("doc_id", digest_of(F.col("text")).alias("wanted"), digest_of(F.when(F.col("doc_id") % 3 == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("fetched"))
    there = d.where("doc_id % 3 = 0").select("doc_id", F.lit(True).alias("has"))
    return d.join(there, "doc_id", "left").select("doc_id", F.when(F.col("has"), "grant").when(F.col("wanted") == F.col("fetched"), "store").otherwise("reject").alias("action"))
