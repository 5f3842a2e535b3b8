"""Names and digests: the grammars that a string has to match, and their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammars of public registry names.
NAMESPACE = r"^[a-z0-9]+((__|[._]|-+)[a-z0-9]+)*(/[a-z0-9]+((__|[._]|-+)[a-z0-9]+)*)*$"
TAG = r"^[a-zA-Z0-9_][a-zA-Z0-9._-]{0,127}$"
DIGEST = r"^(sha256:[0-9a-f]{64}|sha512:[0-9a-f]{128})$"
MEDIA_TYPE = r"^[A-Za-z0-9][A-Za-z0-9!#$&^_.+-]{0,126}/[A-Za-z0-9][A-Za-z0-9!#$&^_.+-]{0,126}$"
SESSION_ID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
LONGEST_NAMESPACE, FALLBACK_HASH = 255, 64


def is_namespace(c: Column) -> Column:
    return (F.octet_length(c) <= LONGEST_NAMESPACE) & c.rlike(NAMESPACE)


def is_tag(c: Column) -> Column:
    return c.rlike(TAG)


def is_digest(c: Column) -> Column:
    return c.rlike(DIGEST)


def is_media_type(c: Column) -> Column:
    return c.rlike(MEDIA_TYPE)


def is_session_id(c: Column) -> Column:
    return c.rlike(SESSION_ID)


def algorithm(digest: Column) -> Column:
    return F.split_part(digest, F.lit(":"), F.lit(1))


def hash_of(digest: Column) -> Column:
    return F.split_part(digest, F.lit(":"), F.lit(2))


def shard_of(digest: Column) -> Column:
    """The two hex digits under which a digest's keys stand."""
    return F.substring(hash_of(digest), 1, 2)


def fallback_tag(digest: Column) -> Column:
    """The tag under which referrers of a digest are listed where there is no listing of them."""
    return F.concat(algorithm(digest), F.lit("-"), F.substring(hash_of(digest), 1, FALLBACK_HASH))


def digest_of(content: Column, bits: int = 256) -> Column:
    """The content address of a string or binary column."""
    return F.concat(F.lit(f"sha{bits}:"), F.sha2(content.cast("binary"), bits))


def in_namespace(ns: Column, prefix: Column) -> Column:
    """Whether a namespace is ``prefix`` or lies below it, by whole segments."""
    return (ns == prefix) | F.startswith(ns, F.concat(prefix, F.lit("/")))


def below(ns: Column, prefix: Column) -> Column:
    """The namespace without a leading whole-segment prefix; null where it is none, or the whole."""
    rest = F.substring(ns, F.length(prefix) + 2, F.length(ns))
    return F.when(F.startswith(ns, F.concat(prefix, F.lit("/"))) & (rest != ""), rest)


def nested(ns: Column, prefix: Column) -> Column:
    """The namespace under ``prefix``; null if that is too long."""
    joined = F.concat(prefix, F.lit("/"), ns)
    return F.when(F.octet_length(joined) <= LONGEST_NAMESPACE, joined)


def remote_name(ns: Column, local: Column, target: Column) -> Column:
    """A namespace's name in a remote store: without ``local``, then under ``target``; either may be null."""
    bare = F.when(local.isNull(), ns).otherwise(below(ns, local))
    at_root = ns == local
    return (
        F.when(at_root & target.isNotNull(), target)
        .when(at_root, ns)
        .when(target.isNull(), bare)
        .otherwise(nested(bare, target))
    )
