"""Liveness of content: which references are backed, which blobs are orphans, what to repair.

Unreadable or young records always speak for keeping; every such default is an
explicit coalesce here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyship.operators.retention import young

#: Kinds of reference that go by the holders of their link.
LEGACY = ("layer", "config", "manifest")


def backed_references(refs: DataFrame, live: DataFrame, revisions: DataFrame, referrers: DataFrame, tracked: DataFrame) -> DataFrame:
    """References whose other side still leads to the blob.

    refs: digest, ns, kind (own, tag, digest, referrer, referenced_by, layer, config,
    manifest), name (a tag) and other (a digest). An own reference always does. A tag
    has to resolve to the blob, a revision to be stored, a referrer to have its record
    under the subject, a back-reference its manifest's revision. The other kinds are
    legacy: their link (ns, kind, target, referenced_by) has to name a manifest that is
    still a revision, as a link file outlives the manifest's delete. What speaks for
    references is one table, so that they are made, dealt and joined once for all kinds;
    names and digests lead the join's keys, since sorting by namespaces first is slow.
    """
    text = lambda c: F.col(c).cast("string")
    speaks = lambda rows, kind, one, two=None: rows.select("ns", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text(one).alias("_one"), (text(two) if two else F.lit("")).alias("_two"))
    stored = revisions.select("ns", "digest").distinct()
    holders = tracked.select("ns", "kind", "target", F.explode("referenced_by").alias("holder")).join(stored.withColumnRenamed("digest", "holder"), ["ns", "holder"], "left_semi")
    known = (
        speaks(live, "tag", "tag", "digest").unionByName(speaks(stored, "digest", "digest")).unionByName(speaks(referrers, "referrer", "subject", "referrer"))
        .unionByName(speaks(stored, "referenced_by", "digest")).unionByName(speaks(holders.where(F.col("kind").isin(*LEGACY)), F.col("kind"), "target"))
    )
    kind, columns = F.col("kind"), refs.columns
    one = F.when(kind == "tag", text("name")).when(kind.isin("referrer", "referenced_by"), text("other")).when(kind.isin("digest", *LEGACY), text("digest"))
    two = F.when(kind.isin("tag", "referrer"), text("digest")).otherwise("")
    backed = refs.withColumn("_one", one).withColumn("_two", two).join(known, ["_one", "_two", "ns", "kind"], "left_semi")
    return refs.where(kind == "own").unionByName(backed.select(columns))


def orphan_blobs(blobs: DataFrame, refs: DataFrame, backed: DataFrame, now_ms: int, grace_ms: int) -> DataFrame:
    """Blobs that nothing pins: no backed reference, none too young to judge, none that cannot be read; and not young themselves."""
    age = lambda c: F.lit(now_ms) - F.col(c)
    pins = refs.where(young(age("modified_ms"), grace_ms) | F.coalesce(F.col("unreadable"), F.lit(True))).select("digest")
    held = pins.union(backed.select("digest")).distinct()
    return blobs.where(~young(age("modified_ms"), grace_ms)).join(held, "digest", "left_anti")


def dangling_references(refs: DataFrame, backed: DataFrame, blobs: DataFrame, now_ms: int, grace_ms: int) -> DataFrame:
    """References past grace that nothing backs, to bytes that are there."""
    aged = refs.where(~young(F.lit(now_ms) - F.col("modified_ms"), grace_ms))
    keys = ["digest", "ns", "entry"]
    return aged.join(backed.select(keys), keys, "left_anti").join(blobs.select("digest"), "digest", "left_semi")


def byteless_references(refs: DataFrame, blobs: DataFrame, now_ms: int, grace_ms: int) -> DataFrame:
    """References past grace to bytes that are not there; each is aged by its own key."""
    return refs.where(~young(F.lit(now_ms) - F.col("modified_ms"), grace_ms)).join(blobs.select("digest"), "digest", "left_anti")


def orphan_grants(grants: DataFrame, tracked: DataFrame, retained: DataFrame, any_repository: bool, now_ms: int, window_ms: int) -> DataFrame:
    """Grants (ns, digest, repository, modified_ms of the bytes) to revoke.

    Bytes younger than the window, or of unknown age, are left alone. Where repositories
    are configured, a grant in none of them goes outright; any other goes if no tracked
    link speaks for it and retention does not keep it.
    """
    keys = ["ns", "digest"]
    aged = grants.where(~young(F.lit(now_ms) - F.col("modified_ms"), window_ms))
    outright = F.col("repository").isNull() & F.lit(any_repository)
    loose = aged.where(~outright).join(tracked.select("ns", F.col("target").alias("digest")).distinct(), keys, "left_anti")
    return aged.where(outright).unionByName(loose.join(retained.select(keys), keys, "left_anti").select(aged.columns))


def orphan_namespaces(namespaces: DataFrame, repositories: DataFrame, resolved: DataFrame) -> DataFrame:
    """Namespaces in no repository; none at all if no repository is configured."""
    loose = namespaces.join(resolved.where(F.col("repository").isNotNull()).select("ns"), "ns", "left_anti")
    return loose.join(repositories.select(F.lit(1).alias("_any")).limit(1), F.lit(True), "left_semi")


def orphan_jobs(jobs: DataFrame, downstreams: DataFrame) -> DataFrame:
    """Jobs whose downstream is not configured; a job whose payload names none is kept."""
    return jobs.where(F.col("downstream").isNotNull()).join(downstreams.select(F.col("name").alias("downstream")), "downstream", "left_anti")


def orphan_multiparts(uploads: DataFrame, sessions: DataFrame, legacy_sessions: DataFrame) -> DataFrame:
    """Multipart uploads with neither a session record nor a legacy one; where the look-up failed they stay."""
    keys = ["ns", "session"]
    return uploads.where(~F.coalesce(F.col("probe_failed"), F.lit(False))).join(sessions.select(keys), keys, "left_anti").join(legacy_sessions.select(keys), keys, "left_anti")


def check_references(wanted: DataFrame, granted: DataFrame, blobs: DataFrame, policy: str) -> DataFrame:
    """References of a manifest to be stored, with an action by policy: strict fails, permissive drops, trusted grants if bytes are there."""
    g = granted.select("ns", "digest").distinct().withColumn("_granted", F.lit(True))
    b = blobs.select("digest").distinct().withColumn("_bytes", F.lit(True))
    missing = {"strict": F.lit("fail"), "permissive": F.lit("drop"), "trusted": F.when(F.col("_bytes").isNotNull(), "grant").otherwise("fail")}[policy]
    joined = wanted.join(g, ["ns", "digest"], "left").join(b, "digest", "left")
    return joined.withColumn("action", F.when(F.col("_granted").isNotNull(), "keep").otherwise(missing)).drop("_granted", "_bytes")


def tag_targets(live: DataFrame, blobs: DataFrame, revisions: DataFrame, now_ms: int, grace_ms: int) -> DataFrame:
    """Tags past grace with ``action``: delete_manifest without bytes, recreate_link without a revision, else ok."""
    b = blobs.select("digest").distinct().withColumn("_bytes", F.lit(True))
    r = revisions.select("ns", "digest").distinct().withColumn("_revision", F.lit(True))
    joined = live.where(~young(F.lit(now_ms) - F.col("ms"), grace_ms)).join(b, "digest", "left").join(r, ["ns", "digest"], "left")
    action = F.when(F.col("_bytes").isNull(), "delete_manifest").when(F.col("_revision").isNull(), "recreate_link").otherwise("ok")
    return joined.withColumn("action", action).drop("_bytes", "_revision")


def missing_links(expected: DataFrame, actual: DataFrame, blobs: DataFrame) -> DataFrame:
    """Links that manifests call for but the store lacks or has wrong, and grants for those whose bytes are there."""
    a = actual.select("ns", "kind", "name", F.col("target").alias("_target"))
    links = expected.join(a, ["name", "ns", "kind"], "left").where(~F.col("_target").eqNullSafe(F.col("target"))).select(expected.columns)
    there = blobs.select(F.col("digest").alias("target"), F.lit(True).alias("_bytes")).distinct()
    both = F.array(F.lit("recreate_link"), F.lit("grant"))
    marked = links.join(there, "target", "left").withColumn("action", F.explode(F.when(F.col("_bytes"), both).otherwise(F.array(F.lit("recreate_link")))))
    return marked.select(*links.columns, "action")


def dead_referrers(records: DataFrame, revisions: DataFrame, now_ms: int, grace_ms: int) -> DataFrame:
    """Referrer records past grace whose referrer is no revision any more."""
    aged = records.where(~young(F.lit(now_ms) - F.col("modified_ms"), grace_ms))
    return aged.join(revisions.select("ns", F.col("digest").alias("referrer")), ["ns", "referrer"], "left_anti")


def rehomed_back_references(tracked: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Legacy back-reference sets (ns, digest, referenced_by): what becomes of each member, and which sets can be retired as all are covered."""
    r = revisions.select("ns", F.col("digest").alias("referrer")).distinct().withColumn("_live", F.lit(True))
    each = tracked.select("ns", "digest", F.explode("referenced_by").alias("referrer")).join(r, ["ns", "referrer"], "left")
    members = each.select("ns", "digest", "referrer", F.when(F.col("_live").isNull(), "drop").otherwise("rehome").alias("action"))
    covered = members.groupBy("ns", "digest").agg(F.bool_and(F.col("action") == "rehome").alias("all_live"), F.count(F.lit(1)).alias("members"))
    return members, covered


def transfer_set(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """Distinct blobs of manifests that a downstream does not have yet."""
    return wanted.select("digest").distinct().join(there.select("digest"), "digest", "left_anti")


def smallest_other_namespace(refs: DataFrame, except_for: str) -> DataFrame:
    """For each blob the first namespace that refers to it, other than one."""
    return refs.where(F.col("ns") != except_for).groupBy("digest").agg(F.min("ns").alias("ns"))


def reference_sets(refs: DataFrame) -> DataFrame:
    """For each blob and namespace the sorted set of entries."""
    return refs.groupBy("digest", "ns").agg(F.array_sort(F.collect_set("entry")).alias("entries"))


def blocked_by_collection(digests: DataFrame, markers: DataFrame, now_ms: int) -> DataFrame:
    """Digests that a collector's run covers: between a marker's ends, both included, while it has not expired.

    Markers are a handful, one per running collector; each speaks for a range of one
    algorithm's hashes, so ranges are matched within their first two digits.
    """
    valid = markers.where(F.col("expires_ms") >= now_ms)
    shard = lambda c: F.conv(F.substring(F.split_part(c, F.lit(":"), F.lit(2)), 1, 2), 16, 10).cast("int")
    spread = valid.select("first", "last", F.split_part("first", F.lit(":"), F.lit(1)).alias("_alg"), F.explode(F.sequence(shard(F.col("first")), shard(F.col("last")))).alias("_shard"))
    keyed = digests.select("*", F.split_part("digest", F.lit(":"), F.lit(1)).alias("_alg"), shard(F.col("digest")).alias("_shard"))
    inside = (F.col("digest") >= F.col("first")) & (F.col("digest") <= F.col("last"))
    return keyed.join(spread, ["_alg", "_shard"]).where(inside).select(*digests.columns).distinct()
