"""Edges of the store's operators: ties, nulls, tombstones, boundaries, empty inputs."""

import pytest
from pyspark.sql import functions as F

from tallyship.functions import grammar as G
from tallyship.functions import keys as K
from tallyship.operators import diff, events, graph, listing, liveness, maintenance, queue, resolve, retention, routing
from tallyship.sources import objects, records, sinks
from tallyship.sources.shared import ensure_checkpoints

EVENTS = "ns string, tag string, ms bigint, is_del boolean, digest string"


def _rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_winner_ties_and_missing_times(spark):
    e = spark.createDataFrame(
        [("n", "time", 1, False, "z"), ("n", "time", 2, True, "a"), ("n", "digest", 5, False, "a"), ("n", "digest", 5, True, "b"), ("n", "set", 5, True, "a"), ("n", "set", 5, False, "a"), ("n", "null", None, False, "z"), ("n", "null", 0, False, "a"), ("n", "alone", None, False, "q")], EVENTS
    )
    assert _rows(resolve.winners(e), "tag", "ms", "is_del", "digest") == sorted([("time", 2, True, "a"), ("digest", 5, True, "b"), ("set", 5, False, "a"), ("null", 0, False, "a"), ("alone", None, False, "q")], key=str)
    assert _rows(resolve.live_tags(e), "tag") == [("alone",), ("null",), ("set",)]
    legacy = spark.createDataFrame([("n", "time", "old"), ("n", "extra", "old"), ("n", "set", "old")], "ns string, tag string, digest string")
    assert _rows(resolve.shadowed_union(e, legacy), "tag", "digest") == [("alone", "q"), ("extra", "old"), ("null", "a"), ("set", "a")]
    assert resolve.winners(e.limit(0)).count() == 0


def test_write_gate(spark):
    cases = [(5, "m", 5, "m", "unchanged"), (5, "m", 5, "a", "superseded"), (5, "m", 5, "z", "applied"), (6, "m", 5, "z", "superseded"), (None, "m", 5, "a", "applied"), (5, "m", 5, None, "applied"), (6, "m", 5, None, "superseded"), (5, "m", None, "a", "applied")]
    writes = spark.createDataFrame([("n", str(i), c[2], c[3]) for i, c in enumerate(cases)] + [("n", "new", 1, "a")], "ns string, tag string, ms bigint, digest string")
    state = spark.createDataFrame([("n", str(i), c[0], c[1]) for i, c in enumerate(cases)], "ns string, tag string, ms bigint, digest string")
    got = dict(resolve.gate_writes(writes, state).select("tag", "outcome").collect())
    assert got == {str(i): c[4] for i, c in enumerate(cases)} | {"new": "applied"}


def test_age_boundaries(spark):
    df = spark.createDataFrame([(99,), (100,), (101,), (None,)], "age bigint")
    age = F.col("age")
    got = df.select("age", retention.young(age, 100).alias("y"), retention.upload_verdict(age, 100, F.lit("ok")).alias("u"), retention.abandoned(age, 100).alias("m")).collect()
    assert [tuple(r) for r in got] == [(99, True, "keep", False), (100, False, "keep", True), (101, False, "delete", True), (None, True, "keep", None)]
    entries = spark.createDataFrame([("k", "a", 0), ("k", "b", 900), ("k", "c", 901), ("k", "d", 2000)], "key string, entry string, ms bigint")
    assert _rows(resolve.retired_entries(entries, ["key"], 1900, 1000), "entry") == [("a",), ("b",)]
    e = spark.createDataFrame([("n", "t", 10, False, "a"), ("n", "t", 10, False, "b"), ("n", "t", 9, False, "c"), ("n", "t", None, False, "d")], EVENTS)
    assert _rows(resolve.demoted_entries(e, 109, 100), "digest") == [("c",)] and resolve.demoted_entries(e, 108, 100).count() == 0


@pytest.mark.parametrize(("n", "last", "keys", "token"), [(2, None, ["a", "b"], "b"), (2, "b", ["c", "d"], None), (5, "aa", ["b", "c", "d"], None), (0, None, [], None), (3, "z", [], None), (4, None, ["a", "b", "c", "d"], None)])
def test_pages(spark, n, last, keys, token):
    rows = listing.page(spark.createDataFrame([(k,) for k in "dcab"], "k string"), "k", n, last).collect()
    assert sorted(r.k for r in rows) == keys and {r.token for r in rows} <= {token}


def test_short_pages_of_referrers(spark):
    c = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "digest string, artifact_type string")
    got = listing.referrers_page(c, 2, "x").collect()
    assert [(r.digest, r.token) for r in got] == [("a", "b")]


def test_listing_and_children(spark):
    o = spark.createDataFrame([("t/v1/a",), ("t/v1-rc/a",), ("t/v1",), ("t/x",)], "key string")
    assert [r.key for r in listing.listed(o, "t/", 2, after="t/v1").collect()] == ["t/v1-rc/a", "t/v1/a"]
    assert _rows(listing.children(o, "t/"), "name", "is_dir") == [("v1", False), ("v1", True), ("v1-rc", True), ("x", False)]
    assert _rows(sinks.delete_prefix(o, "t/v1"), "key") == [("t/v1",), ("t/v1-rc/a",), ("t/x",)] and sinks.delete_prefix(o, "").count() == 4


def test_range_numbers_are_disjoint(spark):
    keys = spark.createDataFrame([(f"p/{c}{d}",) for c in "09AZaz-_" for d in ("", "x")], "key string")
    got = keys.select("key", objects.range_of(F.col("key"), "p/").alias("n")).collect()
    order = [r.n for r in sorted(got, key=lambda r: r.key.encode())]
    assert order == sorted(order) and len(objects.BOUNDS) == 63


def test_files_as_objects(spark, tmp_path):
    (tmp_path / "root" / "a").mkdir(parents=True)
    (tmp_path / "root" / "a" / "x").write_bytes(b"123")
    assert [(r.key, r.size) for r in objects.files(spark, str(tmp_path / "root")).collect()] == [("a/x", 3)]
    assert [bytes(r.content) for r in objects.contents(spark, str(tmp_path / "root")).collect()] == [b"123"]


H = "ab" * 32


@pytest.mark.parametrize(
    ("key", "want"),
    [
        ("", "unknown"), ("v2//x", "unknown"), ("v2/gc/a/b", "unknown"), ("v2/gc/a", "gc_marker"), (f"v2/blobs/sha256/ab/{H}/data", "blob_data"), (f"v2/blobs/sha256/ac/{H}/data", "unknown"),
        (f"v2/blobs/sha256/ab/{H.upper()}/data", "unknown"), (f"v2/ref/sha256/ab/{H}/n!own", "blob_ref"), (f"v2/ref/sha256/ab/{H}/n!r/idx.sha256.{H}", "blob_ref"), (f"v2/ref/sha256/ab/{H}/n!r/idx.md5.{H}", "unknown"),
        (f"v2/ns/Bad!tag/t!/{'0' * 16}.set.sha256.{H}", "unknown"), (f"v2/ns/a/b!tag/t!/{'0' * 16}.set.sha256.{H}", "tag_entry"), (f"v2/ns/a!tag/t!/{'0' * 15}.set.sha256.{H}", "unknown"), ("_jobs/pending/other/x.json", "unknown"),
        ("v2/repositories/a/_uploads/not-a-uuid/data", "unknown"), ("v2/repositories/_uploads/x", "unknown"), (f"v2/repositories/Odd/_manifests/tags/any thing/current/link", "link_tag"), ("_probe_1", "probe"), ("x/_probe_1", "unknown"), ("v2/cat/a/b!", "catalog_index"), ("v2/cat/a", "unknown"),
    ],
)
def test_key_categories(spark, key, want):
    assert spark.createDataFrame([(key,)], "k string").select(K.category(F.col("k"))).first()[0] == want


def test_names_round_trip(spark):
    df = spark.createDataFrame([(0,), (1_000_000,), (None,), (-5,)], "ms bigint")
    got = df.select("ms", K.newest_first(F.col("ms")).alias("o"), K.ordinal_time(K.newest_first(F.col("ms"))).alias("back"), K.job_storage_key(F.col("ms"), F.lit("id")).alias("j")).collect()
    assert [r.back for r in got] == [0, 1_000_000, None, -5]
    assert got[0].o == "f" * 15 + "e" and got[1].o < got[0].o < got[2].o and got[3].j == "0" * 16 + "-id"
    names = spark.createDataFrame([("org",), ("org/a",), ("orga",), ("x",)], "ns string")
    ns = F.col("ns")
    got = [tuple(r) for r in names.select(G.in_namespace(ns, F.lit("org")), G.below(ns, F.lit("org")), G.remote_name(ns, F.lit("org"), F.lit("m")), G.remote_name(ns, F.lit("org"), F.lit(None).cast("string"))).collect()]
    assert got == [(True, None, "m", "org"), (True, "a", "m/a", "a"), (False, None, None, None), (False, None, None, None)]
    assert spark.createDataFrame([("a" * 256,), ("a" * 255,)], "s string").select(G.is_namespace(F.col("s"))).collect() == [(False,), (True,)]
    assert spark.range(1).select(K.shard_namespace(F.lit("a%2Fb%25.json"))).first()[0] == "a/b%"


def test_prefix_join_takes_whole_segments(spark):
    repos = spark.createDataFrame([("a",), ("b/c",)], "name string")
    names = spark.createDataFrame([("a",), ("a/x/y",), ("ab",), ("b",), ("b/c/d",)], "ns string")
    assert dict(routing.with_repository(names, repos).select("ns", "repository").collect()) == {"a": "a", "a/x/y": "a", "ab": None, "b": None, "b/c/d": "b/c"}
    assert routing.overlapping(repos).count() == 0
    assert routing.overlapping(repos.union(spark.createDataFrame([("a/z",)], "name string"))).collect()[0].asDict() == {"outer": "a", "inner": "a/z"}


def test_orphans_fail_safe(spark):
    blobs = spark.createDataFrame([(i, t) for i, t in [("free", 0), ("young", 95), ("notime", None), ("own", 0), ("pinned", 0), ("broken", 0), ("oldref", 0)]], "digest string, modified_ms bigint")
    refs = spark.createDataFrame([("pinned", 95, False), ("broken", 0, None), ("oldref", 0, False)], "digest string, modified_ms bigint, unreadable boolean")
    backed = spark.createDataFrame([("own",)], "digest string")
    assert _rows(liveness.orphan_blobs(blobs, refs, backed, 100, 10), "digest") == [("free",), ("oldref",)]


def test_backing_by_kind(spark):
    refs = spark.createDataFrame(
        [("d", "n", "own", None, None), ("d", "n", "tag", "t", None), ("d", "n", "tag", "moved", None), ("d", "n", "digest", None, None), ("d", "n", "referrer", None, "s"), ("d", "n", "referenced_by", None, "m"), ("d", "n", "referenced_by", None, "gone"), ("d", "n", "layer", None, None), ("e", "n", "layer", None, None)],
        "digest string, ns string, kind string, name string, other string",
    )
    live = spark.createDataFrame([("n", "t", "d"), ("n", "moved", "x")], "ns string, tag string, digest string")
    revisions = spark.createDataFrame([("n", "m")], "ns string, digest string")
    records_ = spark.createDataFrame([("n", "s", "d")], "ns string, subject string, referrer string")
    tracked = spark.createDataFrame([("n", "layer", "d", ["gone", "m"]), ("n", "layer", "e", ["gone"])], "ns string, kind string, target string, referenced_by array<string>")
    got = _rows(liveness.backed_references(refs, live, revisions, records_, tracked), "digest", "kind", "name", "other")
    assert got == sorted([("d", "own", None, None), ("d", "tag", "t", None), ("d", "referrer", None, "s"), ("d", "referenced_by", None, "m"), ("d", "layer", None, None)], key=str)


def test_reconcile_keeps_what_is_unresolved(spark):
    local = spark.createDataFrame([("a", "1"), ("b", None), ("c", "1"), ("f", "1")], "tag string, digest string")
    remote = spark.createDataFrame([("a", "1", None), ("b", "9", None), ("d", "1", None), ("f", None, True)], "tag string, digest string, failed boolean")
    got = dict(diff.reconcile(local, remote, ["tag"], True).select("tag", "action").collect())
    assert got == {"a": "converged", "b": "unresolved", "c": "push", "d": "delete", "f": "skipped"}


def test_cascade_and_depth(spark):
    ensure_checkpoints(spark)
    r = spark.createDataFrame([("n", x) for x in "abcdefg"], "ns string, digest string")
    edges = spark.createDataFrame([("n", "a", "b"), ("n", "b", "c"), ("n", "d", "c"), ("n", "e", "f"), ("n", "g", "g2")], "ns string, digest string, target string")
    pins = spark.createDataFrame([("n", "e")], "ns string, digest string")
    got = _rows(graph.orphan_cascade(r, pins, edges, r.where("digest <> 'g'")), "digest", "round")
    assert got == [("a", 0), ("b", 1), ("c", 2), ("d", 0)]
    assert graph.orphan_cascade(r, r, edges, r).count() == 0
    chain = spark.createDataFrame([("n", f"{i:02d}", f"{i + 1:02d}") for i in range(20)], "ns string, digest string, target string")
    order = graph.push_order(chain, spark.createDataFrame([("n", "00")], "ns string, digest string")).collect()
    assert {(r.digest, r.depth, r.too_deep) for r in order} == {(f"{i:02d}", i, i > 8) for i in range(10)}


def test_queue_transitions(spark):
    arrivals = spark.createDataFrame([("b", "q", "l", 2), ("a", "q", "l", 1), ("c", "q", "m", 3)], "id string, queue string, lock_key string, seq int")
    pending = spark.createDataFrame([("p", "q", "m")], "id string, queue string, lock_key string")
    assert _rows(queue.enqueue(arrivals, pending), "id", "job", "outcome") == [("a", "a", "miss"), ("b", "a", "hit"), ("c", "p", "hit")]
    jobs = spark.createDataFrame([("j", 4, None, 0, "pending"), ("k", 0, 1, 0, "pending"), ("l", 3, None, 0, "pending")], "id string, attempts int, max_attempts int, not_before_ms bigint, state string")
    assert _rows(queue.fail(jobs, 1000), "id", "state", "attempts", "not_before_ms") == [("j", "failed", 5, 0), ("k", "failed", 1, 0), ("l", "pending", 4, 1800)]
    failed = queue.fail(jobs, 1000)
    assert _rows(queue.retry(failed, 7, F.col("id") == "j").where("id = 'j'"), "state", "attempts", "not_before_ms") == [("pending", 0, 7)]


def test_events_and_plans(spark):
    put = spark.createDataFrame([("n", "r", ["a", "b"]), ("n", "s", None)], "ns string, reference string, tags array<string>")
    assert _rows(events.put_events(put), "reference", "seq", "kind", "tag") == sorted([("r", 0, "manifest.push", None), ("r", 1, "tag.create", "a"), ("r", 2, "tag.create", "b"), ("s", 0, "manifest.push", None)], key=str)
    plan = maintenance.plan(maintenance.actions(put.select("ns", F.lit("t").alias("tag")), "DeleteTag", "x"), maintenance.actions(put.limit(0), "DeleteOrphanBlob"))
    assert plan.columns == list(maintenance.COLUMNS) and plan.count() == 2
    live = spark.createDataFrame([("n", "t"), ("n", "u")], "ns string, tag string")
    assert _rows(maintenance.apply_tag_deletes(live, plan), "tag") == [("u",)]


def test_manifest_decoding(spark):
    bodies = [('{"schemaVersion":2,"layers":[{"size":3},{"size":null}],"x":1}', None), ('{"schemaVersion":2,"manifests":[]}', None), ("nope", "unreadable"), ('{"schemaVersion":1,"layers":[]}', "schema_version"), ('{"schemaVersion":2,"layers":[],"manifests":[]}', "both_shapes"), ('{"schemaVersion":2,"mediaType":"a/b","layers":[]}', "media_type")]
    df = spark.createDataFrame(bodies, "body string, want string")
    got = df.select("want", records.push_error(F.col("body"), F.lit("c/d")).alias("e"), records.layers_size(records.manifest(F.col("body"))).alias("n"), records.shape(records.manifest(F.col("body"))).alias("s")).collect()
    assert all(r.want == r.e for r in got) and got[0].n == 3 and got[1].s == "index"


def test_sizes_of_all_units_and_keys(spark, tmp_path):
    from tallyship.plans.scans import f16_audit_names
    from tallyship.sources.adapters import Tables

    want = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 2**20 - 1: "1024.0 KB", 2**20: "1.0 MB", 5 * 2**19: "2.5 MB", 2**30: "1.0 GB", 3 * 2**39: "1536.0 GB"}
    spark.createDataFrame([(k, f"c{k}") for k in want], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.c_custkey: r.shown for r in f16_audit_names(Tables(spark, str(tmp_path))).collect()}
    assert got == want


def test_sizes_halfway_between_decimals_go_to_the_even_one(spark):
    from tallyship.functions.scalars import size_text

    sizes = [*range(1024, 12_288, 64), *(k * 2**18 + d for k in range(4, 80) for d in (-1, 0, 1)), *(k * 2**28 for k in range(4, 80)), 2**51 + 2**28, 2**52 + 2**28 + 1]
    units = lambda n: ("KB", 1024) if n < 2**20 else ("MB", 2**20) if n < 2**30 else ("GB", 2**30)
    want = {n: f"{n / size:.1f} {unit}" for n in sizes for unit, size in [units(n)]}
    rows = spark.createDataFrame([(n,) for n in [*want, None]], "n long").withColumn("shown", size_text(F.col("n"))).collect()
    assert {r.n: r.shown for r in rows} == want | {None: None} and want[1280] == "1.2 KB" and want[1792] == "1.8 KB"


def test_a_key_is_made_once_however_many_patterns_it_is_held_against(spark):
    made = F.concat(F.lit("v2/ns/a!tag/b!/"), F.sha2(F.col("id").cast("string").cast("binary"), 256))
    keys = spark.range(3).select(made.alias("key"), F.lit(0).alias("ms"))
    found = objects.quarantine(objects.parsed_keys(keys), 10, 5).select("key")
    assert found.count() == 3 and found._jdf.queryExecution().optimizedPlan().toString().count("sha2(") <= 2


def test_rows_are_made_once_for_all_kinds_of_action(spark):
    rows = spark.createDataFrame([("n", "a", 1), ("n", "b", 2), ("n", "c", None)], "ns string, tag string, x int").distinct()
    planned = maintenance.sorted_actions(rows, [("Low", "x", "x < 2"), ("Any", "y", "x > 0"), ("None", "z", "x > 5")])
    assert sorted((r.action, r.reason, r.tag) for r in planned.collect()) == [("Any", "y", "a"), ("Any", "y", "b"), ("Low", "x", "a")]
    assert planned.columns == list(maintenance.COLUMNS) and planned._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_missing_links_join_their_sides_once(spark):
    expected = spark.createDataFrame([("n", "layer", "a", 1), ("n", "layer", "b", 2), ("n", "layer", "c", 3)], "ns string, kind string, name string, target int")
    actual = spark.createDataFrame([("n", "layer", "a", 1), ("n", "layer", "b", 9)], expected.schema)
    found = liveness.missing_links(expected, actual, spark.createDataFrame([(2,), (2,)], "digest int"))
    assert sorted((r.name, r.action) for r in found.collect()) == [("b", "grant"), ("b", "recreate_link"), ("c", "recreate_link")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
