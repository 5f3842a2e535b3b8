"""Queries over scans, keys, records and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyship.functions import grammar as G
from tallyship.functions import keys as K
from tallyship.functions import scalars as C
from tallyship.operators import listing as L
from tallyship.operators.resolve import first_by_priority
from tallyship.plans.registry import query
from tallyship.sources import objects as O
from tallyship.sources import records as J
from tallyship.sources import sinks as N
from tallyship.sources.adapters import NOW_MS, Tables, with_sql


@query(with_sql("objects", "SELECT key, size FROM objects WHERE key LIKE 'v2/ns/org1/%' ORDER BY key LIMIT 50"))
def s1_ordered_listing(t: Tables) -> DataFrame:
    return L.listed(t.objects(), "v2/ns/org1/", 50).select("key", "size")


@query(with_sql("objects", "SELECT key FROM objects WHERE key LIKE 'v2/ns/%' AND key > 'v2/ns/org3/u' ORDER BY key LIMIT 20"))
def s2_list_after(t: Tables) -> DataFrame:
    return L.listed(t.objects(), "v2/ns/", 20, after="v2/ns/org1", token="v2/ns/org3/u").select("key")


@query(with_sql("objects", "SELECT DISTINCT split_part(substr(key, 12), '/', 1) AS name, contains(substr(key, 12), '/') AS is_dir FROM objects WHERE key LIKE 'v2/ns/org2/%'"))
def s3_children(t: Tables) -> DataFrame:
    return L.children(t.objects(), "v2/ns/org2/")


@query(with_sql("objects", "SELECT count(*) AS keys, sum(size)::BIGINT AS bytes, min(key) AS first_key, max(key) AS last_key FROM objects"))
def s4_whole_scan(t: Tables) -> DataFrame:
    return t.objects().agg(F.count(F.lit(1)).alias("keys"), F.sum("size").alias("bytes"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@query("SELECT (p_name > 'b')::INT + (p_name > 'g')::INT + (p_name > 'm')::INT + (p_name > 's')::INT AS part, count(*) AS keys FROM part GROUP BY 1")
def s5_range_scan(t: Tables) -> DataFrame:
    return t.part.groupBy(O.range_of(F.col("p_name"), "", "bgms").alias("part")).agg(F.count(F.lit(1)).alias("keys"))


@query(with_sql("objects", "SELECT key, size FROM objects WHERE key > 'v2/ns/org2' AND key <= 'v2/ns/org3' "))
def s6_disjoint_ranges(t: Tables) -> DataFrame:
    dealt = O.parallel_scan(t.objects(), 8)
    return dealt.where("key > 'v2/ns/org2' AND key <= 'v2/ns/org3'").select("key", "size")


@query(with_sql("tag_events", "SELECT DISTINCT ns FROM tag_events"))
def s8_namespace_discovery(t: Tables) -> DataFrame:
    e = t.tag_events()
    paths = e.select(F.concat("ns", F.lit("/_manifests/tags/"), "tag").alias("key")).union(e.select(F.concat(F.lit("_hidden/"), "ns", F.lit("/_manifests/x")).alias("key")))
    return O.namespaces_with(paths, "_manifests")


@query(with_sql("tag_events", "SELECT DISTINCT ns FROM tag_events WHERE ns >= 'org3/' AND ns < 'org30'"))
def s9_catalog_range(t: Tables) -> DataFrame:
    return t.tag_events().select("ns").distinct().where("ns >= 'org3/' AND ns < 'org30'")


_KEYS = {
    "blob_data": "concat('v2/blobs/sha256/', left(h, 2), '/', h, '/data')",
    "blob_index_shard": "concat('v2/blobs/sha256/', left(h, 2), '/', h, '/refs/org%2Fx.json')",
    "blob_ref": "concat('v2/ref/sha256/', left(h, 2), '/', h, '/org/x!r/tag.v1')",
    "tag_entry": "concat('v2/ns/org/x!tag/v1!/00000000000000ff.set.sha256.', h)",
    "tag_history": "concat('v2/ns/org/x!hist/v1!/00000000000000ff.del.sha256.', h)",
    "tag_access_entry": "concat('v2/ns/org/x!atime/tag/v1!/00000000000000ff.', left(h, 8))",
    "revision_access_entry": "concat('v2/ns/org/x!atime/rev/sha256/', h, '!/00000000000000ff.', left(h, 8))",
    "access_time": "concat('v2/ns/org/x!atime/rev/sha256/', h)",
    "revision_record": "concat('v2/ns/org/x!rev/sha256/', left(h, 2), '/', h)",
    "referrer_record": "concat('v2/ns/org/x!sub/sha256/', left(h, 2), '/', h, '/sha256.', h)",
    "catalog_index": "'v2/cat/org/x!'",
    "upload_artifact": "'v2/repositories/org/x/_uploads/0f0e0d0c-0000-4000-8000-00000000000a/staged/12'",
    "link_tag": "'v2/repositories/org/x/_manifests/tags/v1/current/link'",
    "link_revision": "concat('v2/repositories/org/x/_manifests/revisions/sha256/', h, '/link')",
    "link_layer": "concat('v2/repositories/org/x/_layers/sha256/', h, '/link')",
    "job_pending": "concat('_jobs/pending/cache/', h, '.json')",
    "job_failed": "concat('_jobs/failed/replication/', h, '.json')",
    "job_index": "concat('_jobs/index/cache/', h, '.json')",
    "job_claim": "concat('_jobs/claims/', h)",
    "gc_marker": "concat('v2/gc/', h)",
    "tx_leftover": "concat('.tx-log/', h)",
    "lost_and_found": "concat('lost+found/', h)",
    "unknown": "concat('v2/blobs/sha256/00/../', h)",
}


@query(
    "WITH d AS (SELECT event_id, sha256(event_id::VARCHAR) AS h FROM events), k AS (SELECT event_id, CASE event_id % 23 "
    + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(_KEYS.values()))
    + " END AS key, CASE event_id % 23 "
    + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_KEYS))
    + " END AS category FROM d) SELECT *, CASE WHEN regexp_matches(key, '^v2/(ns|cat|repositories)/org/x') OR contains(key, '/org/x!') THEN 'org/x' END AS ns FROM k"
)
def s10_key_categories(t: Tables) -> DataFrame:
    hashed = t.events.select("event_id", F.sha2(F.col("event_id").cast("string").cast("binary"), 256).alias("h"))
    key = F.expr("CASE event_id % 23 " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(_KEYS.values())) + " END")
    return O.parsed_keys(hashed.select("event_id", key.alias("key"))).select("event_id", "key", "category", "ns")


def _bodies(t: Tables) -> DataFrame:
    """Manifests as JSON: an order's line items are layers; some orders are made faulty."""
    layer = F.struct(F.lit("application/layer").alias("mediaType"), F.concat(F.lit("sha256:"), F.col("l_partkey").cast("string")).alias("digest"), F.col("l_quantity").cast("bigint").alias("size"))
    grouped = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(layer)).alias("layers"))
    k = F.col("l_orderkey")
    body = F.struct(
        F.when(k % 7 == 0, 1).otherwise(2).alias("schemaVersion"),
        F.when(k % 3 == 0, F.lit(J.IMAGE_TYPE)).alias("mediaType"),
        F.when(k % 4 == 0, F.lit("type/own")).alias("artifactType"),
        F.struct(F.lit("type/config").alias("mediaType"), F.lit("sha256:c").alias("digest"), F.lit(7).alias("size")).alias("config"),
        "layers",
        F.when(k % 11 == 0, F.array(F.struct(F.lit("sha256:m").alias("digest")))).alias("manifests"),
        F.lit("ignored").alias("unknownField"),
    )
    text = F.when(k % 13 == 0, "{not json").otherwise(F.to_json(body))
    return grouped.select(k.alias("digest"), text.alias("body"))


@query(f"""SELECT l_orderkey AS digest, CASE WHEN l_orderkey % 3 = 0 THEN '{J.IMAGE_TYPE}' WHEN l_orderkey % 11 = 0 THEN '{J.INDEX_TYPE}' ELSE '{J.IMAGE_TYPE}' END AS media_type,
  CASE WHEN l_orderkey % 4 = 0 THEN 'type/own' ELSE 'type/config' END AS artifact_type, count(*) AS layers, sum(l_quantity::BIGINT)::BIGINT AS size FROM lineitem WHERE l_orderkey % 13 <> 0 GROUP BY l_orderkey""")
def s11_manifest_decode(t: Tables) -> DataFrame:
    m = _bodies(t).select("digest", J.manifest(F.col("body")).alias("m")).where("m.schemaVersion IS NOT NULL")
    d = J.descriptor(F.col("m"), F.col("digest"), F.lit(0))
    return m.withColumn("d", d).select("digest", "d.media_type", "d.artifact_type", F.size("m.layers").cast("bigint").alias("layers"), J.layers_size(F.col("m")).alias("size"))


@query(f"""SELECT l_orderkey AS digest, CASE WHEN l_orderkey % 13 = 0 THEN 'unreadable' WHEN l_orderkey % 11 = 0 THEN 'both_shapes' WHEN l_orderkey % 7 = 0 THEN 'schema_version'
  WHEN l_orderkey % 3 = 0 AND l_orderkey % 2 = 0 THEN 'media_type' END AS error FROM (SELECT DISTINCT l_orderkey FROM lineitem)""")
def s12_strict_decode(t: Tables) -> DataFrame:
    declared = F.when(F.col("digest") % 2 == 0, J.INDEX_TYPE).otherwise(J.IMAGE_TYPE)
    return _bodies(t).select("digest", J.push_error(F.col("body"), declared).alias("error"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'bare' ELSE 'unrecognized' END AS form, CASE WHEN event_id % 3 < 2 THEN concat('sha256:', sha256(event_id::VARCHAR)) END AS target FROM events")
def s14_link_forms(t: Tables) -> DataFrame:
    digest = G.digest_of(F.col("event_id").cast("string"))
    body = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(digest.alias("target")))).when(F.col("event_id") % 3 == 1, F.concat(digest, F.lit("\n"))).otherwise("what is this")
    return t.events.select("event_id", J.link_form(body).alias("form"), J.link_target(body).alias("target"))


@query(with_sql("objects", "SELECT key, size FROM objects WHERE key = (SELECT min(key) FROM objects)"))
def s15_point_get(t: Tables) -> DataFrame:
    o = t.objects()
    return o.join(F.broadcast(o.agg(F.min("key").alias("key"))), "key", "left_semi").select("key", "size")  # one row


@query("""SELECT doc_id, kind, outcome, CASE WHEN outcome = 'partial' THEN CASE WHEN kind = 'suffix' THEN n - least(100, n) ELSE 50 END END AS first, CASE WHEN outcome = 'partial' THEN CASE WHEN kind = 'from_to' THEN least(2000, n - 1) ELSE n - 1 END END AS last
FROM (SELECT doc_id, n_chars AS n, CASE doc_id % 6 WHEN 0 THEN 'from_to' WHEN 1 THEN 'suffix' WHEN 2 THEN 'whole' WHEN 3 THEN 'malformed' WHEN 4 THEN 'suffix' ELSE 'malformed' END AS kind,
  CASE doc_id % 6 WHEN 0 THEN CASE WHEN n_chars = 0 THEN 'whole' WHEN n_chars <= 50 THEN 'unsatisfiable' ELSE 'partial' END WHEN 1 THEN CASE WHEN n_chars = 0 THEN 'whole' ELSE 'partial' END WHEN 2 THEN 'whole' WHEN 4 THEN CASE WHEN n_chars = 0 THEN 'whole' ELSE 'unsatisfiable' END ELSE 'malformed' END AS outcome FROM documents)""")
def s16_byte_ranges(t: Tables) -> DataFrame:
    header = F.element_at(F.array(*(F.lit(h) for h in ("bytes=50-2000", "bytes=-100", "bytes=0-1,5-6", "bytes=9-3", "Bytes=-0", "items=0-5"))), (F.col("doc_id") % 6 + 1).cast("int"))
    parsed = t.documents.select("doc_id", C.parse_range(header).alias("r"), F.col("n_chars").alias("n"))
    return parsed.withColumn("w", C.resolve_range(F.col("r"), F.col("n"))).select("doc_id", "r.kind", "w.outcome", "w.first", "w.last")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' WHEN doc_id % 3 = 0 THEN 'b' ELSE 'c' END AS upstream FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0")
def s17_first_upstream(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id")
    return first_by_priority([d.where(f"doc_id % {k} = 0").withColumn("upstream", F.lit(u)) for k, u in ((2, "a"), (3, "b"), (5, "c"))], ["doc_id"])


@query("SELECT left(sha256(doc_id::VARCHAR), 2) AS shard, count(*) AS blobs FROM documents GROUP BY 1")
def s21_blob_shards(t: Tables) -> DataFrame:
    h = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    keys = t.documents.select(F.concat(F.lit("v2/blobs/sha256/"), F.substring(h, 1, 2), F.lit("/"), h, F.lit("/data")).alias("key"))
    return O.blob_digests(keys).groupBy("shard").agg(F.count(F.lit(1)).alias("blobs"))


@query(with_sql("tag_events", """SELECT event_id, lower(to_hex(18446744073709551614::UBIGINT - ms::UBIGINT)) AS ordinal, ms, is_del AS deletion, digest,
  concat(lower(to_hex(18446744073709551614::UBIGINT - ms::UBIGINT)), '.', left(sha256(concat('client', event_id % 9)), 8)) AS access_entry, concat(lpad(lower(to_hex(ms)), 16, '0'), '-j', event_id) AS job_key,
  concat('sha256-', split_part(digest, ':', 2)) AS fallback FROM tag_events"""))
def f6_entry_names(t: Tables) -> DataFrame:
    e = t.tag_events()
    named = e.withColumn("name", K.tag_entry_name(F.col("ms"), F.col("is_del"), F.col("digest"))).withColumn("p", K.parse_tag_entry(F.col("name")))
    return named.select(
        "event_id", F.substring("name", 1, 16).alias("ordinal"), "p.ms", "p.deletion", "p.digest",
        K.access_entry_name(F.col("ms"), F.concat(F.lit("client"), (F.col("event_id") % 9).cast("string"))).alias("access_entry"),
        K.job_storage_key(F.col("ms"), F.concat(F.lit("j"), F.col("event_id").cast("string"))).alias("job_key"), G.fallback_tag(F.col("digest")).alias("fallback"),
    )


_KINDS = ["own", "r/rev", "r/layer", "r/config", "r/tag.v1", "r/sub.sha256.{h}", "r/idx.sha256.{h}", "r/sha256.{h}", "r/what"]


@query("""SELECT event_id, ['blob', 'digest', 'layer', 'config', 'tag', 'referrer', 'manifest', 'referenced_by', NULL][(event_id % 9 + 1)::INT] AS kind, CASE WHEN event_id % 9 = 4 THEN 'v1' END AS name,
  CASE WHEN event_id % 9 IN (5, 6, 7) THEN concat('sha256:', sha256(event_id::VARCHAR)) END AS other, event_id % 9 <> 8 AS same FROM events""")
def f17_reference_entries(t: Tables) -> DataFrame:
    entry = F.element_at(F.array(*(F.lit(k) for k in _KINDS)), (F.col("event_id") % 9 + 1).cast("int"))
    e = t.events.select("event_id", F.replace(entry, F.lit("{h}"), F.sha2(F.col("event_id").cast("string").cast("binary"), 256)).alias("entry"))
    p = e.withColumn("p", K.parse_ref_entry(F.col("entry")))
    back = K.ref_entry(F.col("p.kind"), F.col("p.name"), F.col("p.other"))
    return p.select("event_id", "p.kind", "p.name", "p.other", F.coalesce(back == F.col("entry"), F.lit(False)).alias("same"))


@query(with_sql("tag_events", """SELECT DISTINCT ns, CASE WHEN ns LIKE 'org1/%' THEN substr(ns, 6) END AS below, concat('mirror/', ns) AS nested, CASE WHEN ns LIKE 'org1/%' THEN concat('mirror/', substr(ns, 6)) END AS remote FROM tag_events"""))
def f12_namespace_mapping(t: Tables) -> DataFrame:
    ns = F.col("ns")
    return t.tag_events().select("ns").distinct().select("ns", G.below(ns, F.lit("org1")).alias("below"), G.nested(ns, F.lit("mirror")).alias("nested"), G.remote_name(ns, F.lit("org1"), F.lit("mirror")).alias("remote"))


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS sha256, concat('sha256:', sha256(coalesce(text, ''))) AS digest, left(sha256(coalesce(text, '')), 2) AS shard FROM documents""")
def a12_content_digests(t: Tables) -> DataFrame:
    d = G.digest_of(F.coalesce("text", F.lit("")))
    return t.documents.select("doc_id", d.alias("digest")).select("doc_id", G.hash_of(F.col("digest")).alias("sha256"), "digest", G.shard_of(F.col("digest")).alias("shard"))


@query("""SELECT event_id, regexp_matches(s, '^[a-z0-9]+((__|[._]|-+)[a-z0-9]+)*(/[a-z0-9]+((__|[._]|-+)[a-z0-9]+)*)*$') AS is_ns, regexp_matches(s, '^[a-zA-Z0-9_][a-zA-Z0-9._-]{0,127}$') AS is_tag, regexp_matches(s, '^(sha256:[0-9a-f]{64})$') AS is_digest
FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('a__b/c-', event_id) WHEN 1 THEN concat('a___b', event_id) WHEN 2 THEN concat('sha256:', sha256(event_id::VARCHAR)) WHEN 3 THEN concat('_Tag.', event_id) WHEN 4 THEN concat('/x', event_id) ELSE '' END AS s FROM events)""")
def p12_grammars(t: Tables) -> DataFrame:
    n = F.col("event_id").cast("string")
    made = [F.concat(F.lit("a__b/c-"), n), F.concat(F.lit("a___b"), n), G.digest_of(n), F.concat(F.lit("_Tag."), n), F.concat(F.lit("/x"), n), F.lit("")]
    s = F.element_at(F.array(*made), (F.col("event_id") % 6 + 1).cast("int"))
    return t.events.select("event_id", s.alias("s")).select("event_id", G.is_namespace(F.col("s")).alias("is_ns"), G.is_tag(F.col("s")).alias("is_tag"), G.is_digest(F.col("s")).alias("is_digest"))


@query("""SELECT o_orderkey, least(100 * pow(2, o_orderkey % 12), 10000)::BIGINT AS delay, CASE WHEN o_orderkey % 2 = 0 THEN 9223372036854775807 ELSE (o_orderkey % 100) * 86400 END AS span, greatest(o_orderkey - 500, 0) AS seconds FROM orders""")
def f13_backoff_and_durations(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", C.backoff_ms((k % 12).cast("int")).alias("delay"), C.days(F.when(k % 2 == 0, F.lit(2**62)).otherwise(k % 100)).alias("span"), C.rule_seconds(k - 500, 0).alias("seconds"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name WHEN c_custkey % 4 = 1 THEN 'id' WHEN c_custkey % 4 = 2 THEN 'system' ELSE 'anonymous' END AS actor, CASE WHEN n < 1024 THEN format('{} B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS shown FROM (SELECT *, c_custkey AS n FROM customer)")
def f16_audit_names(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    actor = C.audit_name(F.when(k % 4 == 0, F.col("c_name")), F.when(k % 4 == 1, F.lit("id")), F.when(k % 4 == 2, F.lit("system")))
    return t.customer.select("c_custkey", actor.alias("actor"), C.size_text(k).alias("shown"))


@query(with_sql("objects", "SELECT key, size FROM objects WHERE NOT starts_with(key, 'v2/ns/org1/u1/') AND NOT starts_with(key, 'v2/ns/org2/u2!tag/view!/') "))
def k3_prefix_delete(t: Tables) -> DataFrame:
    o = N.delete_prefix(t.objects(), "v2/ns/org1/u1")
    return N.delete_prefix(N.delete_prefix(o, ""), "v2/ns/org2/u2!tag/view!/").select("key", "size")


@query("SELECT o_custkey AS key, min(o_orderkey) AS writer FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1")
def k2_first_writer_wins(t: Tables) -> DataFrame:
    there = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"))
    writes = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("writer"))
    return N.put_if_absent(there, writes, F.col("writer"))


@query("SELECT c_custkey AS key, CASE WHEN o.k IS NULL THEN 'old' ELSE 'new' END AS body FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') o ON k = c_custkey UNION SELECT o_custkey, 'new' FROM orders WHERE o_orderstatus = 'O'")
def k1_overwrite_put(t: Tables) -> DataFrame:
    current = t.customer.select(F.col("c_custkey").alias("key"), F.lit("old").alias("body"))
    return N.put(current, t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("key"), F.lit("new").alias("body")).distinct())


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'gap' WHEN o_orderkey % 4 = 1 THEN 'rewind' WHEN o_orderkey % 4 = 2 THEN 'size' END AS error FROM orders")
def k5_upload_appends(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    return t.orders.select("o_orderkey", N.append_error(F.lit(10), F.when(k == 0, 11).when(k == 1, 9).otherwise(10), F.lit(5), F.when(k == 2, 6).when(k == 3, 5)).alias("error"))


@query(with_sql("objects", f"SELECT concat('junk/', key) AS key, concat('lost+found/junk/', key) AS target FROM objects WHERE {NOW_MS} - ms >= 864000000"))
def k10_quarantine(t: Tables) -> DataFrame:
    o = t.objects()
    both = o.unionByName(o.withColumn("key", F.concat(F.lit("junk/"), "key")))
    return O.quarantine(O.parsed_keys(both), NOW_MS, 864_000_000).select("key", "target")


@query("SELECT concat('events_total{kind=\"', event_type, '\",big=\"', (value > 50)::VARCHAR, '\"} ', count(*)) AS line FROM events GROUP BY event_type, value > 50")
def k9_exposition(t: Tables) -> DataFrame:
    counts = t.events.groupBy(F.col("event_type").alias("kind"), (F.col("value") > 50).alias("big")).agg(F.count(F.lit(1)).alias("value"))
    return N.exposition(counts, "events_total", ["kind", "big"])


@query("""SELECT event_id, concat('replication.push.d', event_id % 3, ':a/b:', event_type) AS push, concat('replication.delete.d', event_id % 3, ':a/b:', event_type, CASE WHEN event_id % 2 = 0 THEN concat('@', event_id) ELSE '' END) AS delete,
  'a/b' AS ns, concat('s', event_id) AS session, CASE WHEN event_id % 5 > 0 THEN concat('state', event_id) END AS state, CASE WHEN event_id % 5 > 0 THEN 'a/b%c' END AS shard FROM events""")
def f20_lock_and_upload_keys(t: Tables) -> DataFrame:
    n, d, k = F.col("event_id").cast("string"), F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string")), F.col("event_id") % 5 > 0
    up = K.upload_key(F.concat(F.lit("v2/repositories/a/b/_uploads/s"), n, F.lit("/staged/5")))
    state = F.when(k, F.base64(F.concat(F.lit("state"), n).cast("binary"))).otherwise("*not base64*")
    return t.events.select(
        "event_id", K.push_lock(F.lit("a/b"), F.col("event_type"), d).alias("push"), K.delete_lock(F.lit("a/b"), F.col("event_type"), d, F.when(F.col("event_id") % 2 == 0, F.col("event_id"))).alias("delete"),
        up.alias("u"), C.hasher_state(state).cast("string").alias("state"), F.when(k, K.shard_namespace(F.lit("a%2Fb%25c.json"))).alias("shard"),
    ).select("event_id", "push", "delete", "u.ns", "u.session", "state", "shard")


@query("""SELECT o_orderkey, CASE WHEN n < 60 THEN concat(n, 's ago') WHEN n < 3600 THEN concat(n // 60, 'm ago') WHEN n < 86400 THEN concat(n // 3600, 'h ago') ELSE concat(n // 86400, 'd ago') END AS ago,
CASE WHEN n < 1 THEN '0 seconds' WHEN n < 60 THEN concat(n, ' second', CASE WHEN n > 1 THEN 's' ELSE '' END) WHEN n < 3600 THEN concat(n // 60, ' minute', CASE WHEN n // 60 > 1 THEN 's' ELSE '' END) WHEN n < 86400 THEN concat(n // 3600, ' hour', CASE WHEN n // 3600 > 1 THEN 's' ELSE '' END)
ELSE concat(n // 86400, ' day', CASE WHEN n // 86400 > 1 THEN 's' ELSE '' END) END AS kept_for FROM (SELECT o_orderkey, o_orderkey % 70 * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 61 WHEN 2 THEN 3599 ELSE 40000 END AS n FROM orders)""")
def f22_durations(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    n = k % 70 * F.element_at(F.array(F.lit(1), F.lit(61), F.lit(3599), F.lit(40000)), (k % 4 + 1).cast("int"))
    return t.orders.select("o_orderkey", C.time_ago(n).alias("ago"), C.window_text(n).alias("kept_for"))


_KEY = b"shared key"
_INNER, _OUTER = (bytes(b ^ pad for b in _KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


@query(f"SELECT doc_id, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(text)))) AS signature FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL")
def f14_signatures(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", C.hmac_sha256(_KEY.decode())(F.col("text")).alias("signature"))


@query("""SELECT event_id, CASE WHEN event_id % 5 > 0 THEN concat('d', event_id) END AS target, CASE WHEN event_id % 5 > 0 THEN user_id % 3 END AS referrers, CASE WHEN event_id % 5 > 0 THEN event_id * 10 END AS size,
CASE WHEN event_id % 5 > 0 THEN concat('client', user_id) END AS client, CASE WHEN event_id % 5 > 0 THEN event_id END AS staged FROM events""")
def s13_record_decoders(t: Tables) -> DataFrame:
    """Bodies of links, tags, pulls and upload sessions; every fifth is no JSON."""
    n = F.col("event_id").cast("string")
    broken = lambda body: F.when(F.col("event_id") % 5 > 0, body).otherwise("{not json")
    refs = F.array_repeat(F.lit("r"), (F.col("user_id") % 3).cast("int"))
    link = J.link_body(broken(F.to_json(F.struct(F.concat(F.lit("d"), n).alias("target"), refs.alias("referenced_by"), F.lit("?").alias("unknown")))))
    tag = J.tag_body(broken(F.to_json(F.struct((F.col("event_id") * 10).alias("size"), F.lit("type").alias("media_type")))))
    pull = J.access_body(broken(F.to_json(F.struct(F.concat(F.lit("client"), F.col("user_id").cast("string")).alias("client")))))
    session = J.session_body(broken(F.to_json(F.struct(F.col("event_id").alias("offset")))))
    return t.events.select("event_id", link["target"].alias("target"), F.when(link["target"].isNotNull(), F.size(link["referenced_by"]).cast("bigint")).alias("referrers"), tag["size"].alias("size"), pull["client"].alias("client"), session["offset"].alias("staged"))


@query("""SELECT key, body, how FROM (SELECT c_custkey AS key, c_name AS body FROM customer), (VALUES ('copy'), ('move')) h(how) WHERE NOT (key % 3 = 0 AND how = 'move')
UNION ALL SELECT c_custkey + 10000000, c_name, how FROM customer, (VALUES ('copy'), ('move')) h(how) WHERE c_custkey % 3 = 0""")
def k4_copy_and_move(t: Tables) -> DataFrame:
    """Every third key to a new place; the last pair's source is not there."""
    objects = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("body"))
    pairs = objects.where("key % 3 = 0").select("key", (F.col("key") + 10_000_000).alias("target")).union(t.spark.sql("SELECT -1L, -2L"))
    return N.copy(objects, pairs).withColumn("how", F.lit("copy")).unionByName(N.move(objects, pairs).withColumn("how", F.lit("move")))


@query("""SELECT o_orderkey AS session, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' WHEN coalesce(size, 0) <> coalesce(size, 0) + (o_orderkey % 7 = 0)::INT THEN 'digest_invalid' ELSE 'completed' END AS outcome, body FROM orders
LEFT JOIN (SELECT l_orderkey, string_agg(l_returnflag || l_shipdate::DATE::VARCHAR, '' ORDER BY l_linenumber, l_returnflag || l_shipdate::DATE::VARCHAR) AS body, sum(11) AS size FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def k5_upload_completion(t: Tables) -> DataFrame:
    """Lines as parts of an order's upload; every fifth session is gone, every seventh hashed a byte more."""
    part = F.concat("l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd")).cast("binary")
    uploads = N.assembled(t.lineitem.select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("at"), part.alias("body")))
    asked = t.orders.select(F.col("o_orderkey").alias("session")).join(uploads, "session", "left")
    hashed = F.coalesce("size", F.lit(0)) + (F.col("session") % 7 == 0).cast("int")
    requests = asked.select("session", hashed.alias("hashed_size"), F.decode("body", "UTF-8").alias("body"))
    return N.completed(requests, requests.where("session % 5 > 0"), uploads).select("session", "outcome", "body")
