"""Keys of the object store: building, parsing and classing them.

The key grammar is the physical schema, so a listing is parsed once into columns and
never read again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyship.functions import grammar as G

# The roots of the layout, its queues, and prefixes of what writers leave behind.
BLOBS, REPOS, REFS, NAMESPACES, CATALOG, MARKERS, JOBS = "v2/blobs", "v2/repositories", "v2/ref", "v2/ns", "v2/cat", "v2/gc", "_jobs"
QUEUES = ("cache", "replication")
LEFTOVERS = (".tx-log", ".tx-bodies", ".tx-locks")
LOST, PROBE = "lost+found", "_probe_"
ROOTS = (*(f"{r}/" for r in (BLOBS, REPOS, REFS, NAMESPACES, CATALOG, MARKERS, JOBS, LOST)), PROBE)

# How digests, tags and entries are written in keys; names as in the grammar, without its anchors and groups.
_HASHED = r"(sha256/[0-9a-f]{64}|sha512/[0-9a-f]{128})"
_DOTTED = r"(sha256\.[0-9a-f]{64}|sha512\.[0-9a-f]{128})"
_SHARDED = r"(sha256/([0-9a-f]{2})/\{G}[0-9a-f]{62}|sha512/([0-9a-f]{2})/\{H}[0-9a-f]{126})"
_TAG = G.TAG.strip("^$")
_NS = G.NAMESPACE.strip("^$").replace("(", "(?:")
_EVENT = r"[0-9a-fA-F]{16}\.(?:set|del)\." + _DOTTED
_ACCESS = r"[0-9a-fA-F]{16}\.[0-9a-fA-F]{8}"


def _sharded(group: int) -> str:
    """A digest under its two-digit shard; ``group`` is the number of this pattern's own group."""
    return _SHARDED.replace("{G}", str(group + 1)).replace("{H}", str(group + 2))


#: Category of a key: the first pattern that matches counts. Namespaces of link keys are raw, as their validity is judged later.
CATEGORIES: tuple[tuple[str, str], ...] = (
    ("tx_leftover", "^(" + "|".join(p.replace(".", r"\.") for p in LEFTOVERS) + ")/"),
    ("lost_and_found", r"^lost\+found/"),
    ("probe", f"^{PROBE}[^/]*$"),
    ("gc_marker", f"^{MARKERS}/[^/]+$"),
    ("job_claim", f"^{JOBS}/claims/[^/]+$"),
    ("job_pending", rf"^{JOBS}/pending/({'|'.join(QUEUES)})/[^/]*\.json$"),
    ("job_failed", rf"^{JOBS}/failed/({'|'.join(QUEUES)})/[^/]*\.json$"),
    ("job_index", rf"^{JOBS}/index/({'|'.join(QUEUES)})/[^/]*\.json$"),
    ("blob_data", f"^{BLOBS}/{_sharded(1)}/data$"),
    ("blob_index_shard", rf"^{BLOBS}/{_sharded(1)}/refs/[^/]*\.json$"),
    ("blob_ref", rf"^{REFS}/{_sharded(1)}/[^!]+!(own|r/(rev|layer|config|tag\.{_TAG}|sub\.{_DOTTED}|idx\.{_DOTTED}|{_DOTTED}))$"),
    ("tag_entry", f"^{NAMESPACES}/{_NS}!tag/{_TAG}!/{_EVENT}$"),
    ("tag_history", f"^{NAMESPACES}/{_NS}!hist/{_TAG}!/{_EVENT}$"),
    ("tag_access_entry", f"^{NAMESPACES}/{_NS}!atime/tag/{_TAG}!/{_ACCESS}$"),
    ("revision_access_entry", f"^{NAMESPACES}/{_NS}!atime/rev/{_HASHED}!/{_ACCESS}$"),
    ("access_time", f"^{NAMESPACES}/{_NS}!atime/(tag/{_TAG}|rev/{_HASHED})$"),
    ("revision_record", f"^{NAMESPACES}/{_NS}!rev/{_sharded(1)}$"),
    ("referrer_record", f"^{NAMESPACES}/{_NS}!sub/{_sharded(1)}/{_DOTTED}$"),
    ("catalog_index", f"^{CATALOG}/{_NS}!$"),
    ("upload_artifact", rf"^{REPOS}/.+?/_uploads/[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}/(data|session\.json|startedat|(hashstates|staged)/[0-9]+)$"),
    ("link_blob", f"^{REPOS}/.+?/_blobs/{_HASHED}/link$"),
    ("link_layer", f"^{REPOS}/.+?/_layers/{_HASHED}/link$"),
    ("link_config", f"^{REPOS}/.+?/_config/{_HASHED}/link$"),
    ("link_tag", f"^{REPOS}/.+?/_manifests/tags/[^/]+/current/link$"),
    ("link_revision", f"^{REPOS}/.+?/_manifests/revisions/{_HASHED}/link$"),
    ("link_referrer", f"^{REPOS}/.+?/_manifests/referrers/{_HASHED}/{_HASHED}/link$"),
    ("link_index", f"^{REPOS}/.+?/_manifests/index/{_HASHED}/{_HASHED}/link$"),
)


def category(key: Column) -> Column:
    """The category of a store key, ``unknown`` for any that no writer makes. Empty and dot segments are never known.

    The key is bound to a variable, so that it is made once, however it is made and
    wherever a filter is pushed, and only the patterns of its root are tried.
    """

    def of(k: Column) -> Column:
        found = F.lit("unknown")
        for name, pattern in reversed(CATEGORIES):
            roots = [r for r in ROOTS if pattern.startswith("^" + r.replace("+", r"\+"))]
            found = F.when((F.startswith(k, F.lit(roots[0])) if roots else F.lit(True)) & k.rlike(pattern), name).otherwise(found)
        return F.when((k == "") | k.rlike(r"(^|/)(\.{0,2})(/|$)"), "unknown").otherwise(found)

    return F.transform(F.array(key), of)[0]


def key_namespace(key: Column) -> Column:
    """The namespace inside a key, null if it has none."""
    own = F.regexp_extract(key, rf"^(?:{NAMESPACES}|{CATALOG})/([^!]+)!", 1)
    ref = F.regexp_extract(key, rf"^{REFS}/[^/]+/[^/]+/[^/]+/([^!]+)!", 1)
    repo = F.regexp_extract(key, rf"^{REPOS}/(.+?)/_(?:uploads|manifests|blobs|layers|config)/", 1)
    return F.nullif(F.concat(own, ref, repo), F.lit(""))


def key_digest(key: Column) -> Column:
    """The digest that a blob, reference or revision key stands under."""
    path = F.regexp_extract(key, rf"^(?:{BLOBS}|{REFS}|{NAMESPACES}/[^!]+!rev|{NAMESPACES}/[^!]+!sub)/([a-z0-9]+)/[0-9a-f]{{2}}/([0-9a-f]+)", 0)
    name = F.regexp_extract(path, r"/([a-z0-9]+)/[0-9a-f]{2}/[0-9a-f]+$", 1)
    return F.nullif(F.concat(name, F.lit(":"), F.regexp_extract(path, r"([0-9a-f]+)$", 1)), F.lit(":"))


def newest_first(ms: Column) -> Column:
    """The ordinal of a time in milliseconds: 16 hex digits that sort newest first; a null time sorts last."""
    return F.when(ms.isNull(), "f" * 16).otherwise(F.lower(F.lpad(F.hex(F.lit(-2).cast("bigint") - ms), 16, "0")))


def ordinal_time(ordinal: Column) -> Column:
    """The time of an ordinal, null for the one of a missing time."""
    signed = F.conv(ordinal, 16, -10).cast("bigint")
    return F.when(ordinal != "f" * 16, F.lit(-2).cast("bigint") - signed)


def tag_entry_name(ms: Column, deletion: Column, digest: Column) -> Column:
    """<ordinal>.<set|del>.<algorithm>.<hash>"""
    return F.concat_ws(".", newest_first(ms), F.when(deletion, "del").otherwise("set"), G.algorithm(digest), G.hash_of(digest))


def parse_tag_entry(name: Column) -> Column:
    """struct(ms, deletion, digest), null unless the name has the form of ``tag_entry_name``."""
    part = lambda k: F.split_part(name, F.lit("."), F.lit(k))
    parsed = F.struct(ordinal_time(part(1)).alias("ms"), (part(2) == "del").alias("deletion"), F.concat(part(3), F.lit(":"), part(4)).alias("digest"))
    return F.when(name.rlike(f"^{_EVENT}$"), parsed)


LONGEST_CLIENT = 256


def access_entry_name(ms: Column, client: Column) -> Column:
    """<ordinal>.<first 8 hex digits of the client's sha256>; the client is cut at 256 characters first."""
    return F.concat_ws(".", newest_first(ms), F.substring(F.sha2(F.left(client, F.lit(LONGEST_CLIENT)).cast("binary"), 256), 1, 8))


def parse_access_entry(name: Column) -> Column:
    """The time of an access entry's name, null for other forms."""
    return F.when(name.rlike(f"^{_ACCESS}$"), ordinal_time(F.split_part(name, F.lit("."), F.lit(1))))


def job_storage_key(ms: Column, job_id: Column) -> Column:
    """Sixteen hex digits of the earliest start, then the id; times before 1970 count as 0."""
    return F.concat(F.lower(F.lpad(F.hex(F.greatest(ms, F.lit(0).cast("bigint"))), 16, "0")), F.lit("-"), job_id)


def job_not_before(key: Column) -> Column:
    """The inverse of ``job_storage_key`` for the time."""
    return F.when(key.rlike("^[0-9a-f]{16}-"), F.conv(F.substring(key, 1, 16), 16, -10).cast("bigint"))


def ref_entry(kind: Column, name: Column, other: Column) -> Column:
    """The tail of a reference key: ``name`` is a tag, ``other`` the digest at a link's other end."""
    dotted = F.concat_ws(".", G.algorithm(other), G.hash_of(other))
    return (
        F.when(kind == "blob", "own")
        .when(kind == "digest", "r/rev")
        .when(kind == "layer", "r/layer")
        .when(kind == "config", "r/config")
        .when(kind == "tag", F.concat(F.lit("r/tag."), name))
        .when(kind == "referrer", F.concat(F.lit("r/sub."), dotted))
        .when(kind == "manifest", F.concat(F.lit("r/idx."), dotted))
        .when(kind == "referenced_by", F.concat(F.lit("r/"), dotted))
    )


def parse_ref_entry(entry: Column) -> Column:
    """struct(kind, name, other) of a reference key's tail, null for no known form."""
    tail = F.regexp_replace(entry, "^r/", "")
    dotted = F.regexp_extract(tail, rf"{_DOTTED}$", 1)
    other = F.when(dotted != "", F.replace(dotted, F.lit("."), F.lit(":")))
    kind = (
        F.when(entry == "own", "blob")
        .when(~F.startswith(entry, F.lit("r/")), None)
        .when(tail == "rev", "digest")
        .when(tail == "layer", "layer")
        .when(tail == "config", "config")
        .when(tail.rlike(rf"^tag\.{_TAG}$"), "tag")
        .when(tail.rlike(rf"^sub\.{_DOTTED}$"), "referrer")
        .when(tail.rlike(rf"^idx\.{_DOTTED}$"), "manifest")
        .when(tail.rlike(rf"^{_DOTTED}$"), "referenced_by")
    )
    name = F.when(kind == "tag", F.substring(tail, F.lit(5), F.length(tail)))
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), name.alias("name"), F.when(kind.isin("referrer", "manifest", "referenced_by"), other).alias("other")))


def shard_namespace(file_name: Column) -> Column:
    """The namespace that a legacy shard's file name encodes."""
    bare = F.regexp_replace(file_name, r"\.json$", "")
    return F.replace(F.replace(bare, F.lit("%2F"), F.lit("/")), F.lit("%25"), F.lit("%"))


def upload_key(key: Column) -> Column:
    """struct(ns, session) of a key below an upload session, null for others."""
    at = lambda k: F.regexp_extract(key, rf"^{REPOS}/(.+)/_uploads/([^/]+)/", k)
    return F.when(at(1) != "", F.struct(at(1).alias("ns"), at(2).alias("session")))


def push_lock(ns: Column, reference: Column, downstream: Column) -> Column:
    """Pushes of one reference to one downstream share a lock, so a later one joins the one that waits."""
    return F.concat_ws(":", F.concat(F.lit("replication.push."), downstream), ns, reference)


def delete_lock(ns: Column, reference: Column, downstream: Column, ms: Column) -> Column:
    """Deletes carry their time; a null time (a delete by reconciliation) leaves it out."""
    return F.concat(F.concat_ws(":", F.concat(F.lit("replication.delete."), downstream), ns, reference), F.when(ms.isNull(), "").otherwise(F.concat(F.lit("@"), ms.cast("string"))))


def dir_prefix(prefix: Column) -> Column:
    """A prefix that ends at a directory, so that ``tags/v1`` never takes in ``tags/v1-rc``; null for the empty one."""
    return F.when(prefix != "", F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/")))
