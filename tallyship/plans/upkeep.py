"""The plan of a whole maintenance run, made of the queries that find its actions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyship.operators import maintenance as M
from tallyship.plans.registry import ORACLES, QUERIES, query
from tallyship.sources.adapters import Tables

#: Kinds of action with their reason, the query that finds them, and which of its rows call for one.
FINDERS = (
    ("DeleteOrphanBlob", "unreferenced", "j7_orphan_blobs", "true"),
    ("RemoveBlobIndexLink", "dangling", "j8_dangling_references", "true"),
    ("RemoveBlobIndexLink", "byteless", "j9_byteless_references", "true"),
    ("RemoveOrphanBlobGrant", "untracked", "j10_orphan_grants", "true"),
    ("DeleteInvalidNamespace", "no repository", "j11_orphan_namespaces", "true"),
    ("DeleteOrphanJob", "downstream", "j12_orphan_jobs", "true"),
    ("AbortMultipartUpload", "no session", "j13_orphan_multiparts", "true"),
    ("EnqueueReplicationPush", "differs", "j14_reconcile", "action = 'push'"),
    ("EnqueueReplicationDelete", "gone", "j14_reconcile", "action = 'delete'"),
    ("DeleteOrphanJobIndex", "no job", "j20_orphan_lock_index", "true"),
    ("DeleteInvalidTag", "no bytes", "j23_tag_targets", "action = 'delete_manifest'"),
    ("RecreateLink", "no revision", "j23_tag_targets", "action = 'recreate_link'"),
    ("RecreateLink", "missing", "j24_missing_links", "action = 'recreate_link'"),
    ("GrantBlobIndexLink", "missing", "j24_missing_links", "action = 'grant'"),
    ("DeleteOrphanReferrer", "dead", "j25_dead_referrers", "true"),
    ("RemoveReferrer", "not all live", "j26_back_reference_sets", "NOT all_live"),
    ("EnsureCatalogIndex", "uncatalogued", "j27_uncatalogued_namespaces", "true"),
    ("DeleteOrphanManifest", "cascade", "g4_orphan_cascade", "true"),
    ("RetireTrackedLink", "older entry", "w4_retired_access_entries", "true"),
    ("DemoteTagEntry", "older entry", "w5_demoted_entries", "true"),
    ("DeleteExpiredUpload", "expired", "p13_age_gates", "upload = 'delete'"),
    ("QuarantineKey", "unknown", "k10_quarantine", "true"),
    ("ConvertTagLink", "bare", "s14_link_forms", "form = 'bare'"),
    ("DeleteCorruptObject", "unrecognized", "s14_link_forms", "form = 'unrecognized'"),
    ("DeleteTag", "retention", "retention_verdict", "NOT retain"),
)

_SQL = " UNION ALL ".join(f"SELECT '{action}' AS action, '{reason}' AS reason, count(*) AS n FROM ({ORACLES[name]}) WHERE {rows} HAVING count(*) > 0" for action, reason, name, rows in FINDERS)


@query(_SQL)
def k7_maintenance_plan(t: Tables) -> DataFrame:
    """What a dry run reports: actions by kind and reason."""
    kinds = {name: [(action, reason, rows) for action, reason, n, rows in FINDERS if n == name] for _, _, name, _ in FINDERS}
    return M.report(M.plan(*(M.sorted_actions(QUERIES[name](t.spark, t.folder), k) for name, k in kinds.items())))
