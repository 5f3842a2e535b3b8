"""Decoders of JSON records: lenient on stored ones, strict on those that come in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyship import schemas as S
from tallyship.functions.grammar import DIGEST

# Media types of images and indexes.
IMAGE_TYPE, INDEX_TYPE = "application/vnd.oci.image.manifest.v1+json", "application/vnd.oci.image.index.v1+json"


def manifest(body: Column) -> Column:
    """A manifest of any shape; unknown fields are ignored, what cannot be read is null."""
    return F.from_json(body, S.MANIFEST)


def link_body(body: Column) -> Column:
    return F.from_json(body, S.LINK_BODY)


def tag_body(body: Column) -> Column:
    return F.from_json(body, S.TAG_BODY)


def access_body(body: Column) -> Column:
    return F.from_json(body, S.ACCESS_BODY)


def session_body(body: Column) -> Column:
    return F.from_json(body, S.SESSION_BODY)


def shape(m: Column) -> Column:
    """index or image; a manifest with neither list counts as an image."""
    return F.when(m["manifests"].isNotNull(), "index").otherwise("image")


def push_error(body: Column, declared: Column) -> Column:
    """Why a pushed manifest is refused, null if it is not: unreadable, both_shapes, schema_version, media_type."""
    m = manifest(body)
    both = m["manifests"].isNotNull() & (m["layers"].isNotNull() | m["config"].isNotNull())
    broken = m.isNull() | (m["schemaVersion"].isNull() & m["layers"].isNull() & m["manifests"].isNull() & m["config"].isNull())
    return (
        F.when(broken, "unreadable")
        .when(both, "both_shapes")
        .when(~m["schemaVersion"].eqNullSafe(F.lit(2)), "schema_version")
        .when(m["mediaType"].isNotNull() & declared.isNotNull() & (m["mediaType"] != declared), "media_type")
    )


def descriptor(m: Column, digest: Column, size: Column) -> Column:
    """What listings say of a manifest: its type (else that of its shape), artifact type (else its config's), size and annotations."""
    return F.struct(
        F.coalesce(m["mediaType"], F.when(shape(m) == "index", INDEX_TYPE).otherwise(IMAGE_TYPE)).alias("media_type"),
        digest.alias("digest"),
        size.alias("size"),
        F.coalesce(m["artifactType"], m["config"]["mediaType"]).alias("artifact_type"),
        m["annotations"].alias("annotations"),
    )


def layers_size(m: Column) -> Column:
    return F.aggregate(F.coalesce(m["layers"], F.array().cast(S.MANIFEST["layers"].dataType)), F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x["size"], F.lit(0)))


def _bare(body: Column) -> Column:
    return F.regexp_replace(body, r"^\s+|\s+$", "")


def link_form(body: Column) -> Column:
    """How a stored link is written: json, bare (a digest alone), or unrecognized."""
    return F.when(link_body(body)["target"].isNotNull(), "json").when(_bare(body).rlike(DIGEST), "bare").otherwise("unrecognized")


def link_target(body: Column) -> Column:
    """The digest of a link in either form."""
    return F.coalesce(link_body(body)["target"], F.when(_bare(body).rlike(DIGEST), _bare(body)))
