"""Explicit schemas of the store's records; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TEXT, LONG, TEXT_MAP = T.StringType(), T.LongType(), T.MapType(T.StringType(), T.StringType())

PLATFORM = _struct(architecture=TEXT, os=TEXT, variant=TEXT, **{"os.version": TEXT}, features=T.ArrayType(TEXT))

DESCRIPTOR = _struct(mediaType=TEXT, digest=TEXT, size=LONG, annotations=TEXT_MAP, artifactType=TEXT, platform=PLATFORM)

#: An image or an index: whichever it is, the other's fields are null.
MANIFEST = _struct(
    schemaVersion=T.IntegerType(),
    mediaType=TEXT,
    artifactType=TEXT,
    annotations=TEXT_MAP,
    subject=DESCRIPTOR,
    config=DESCRIPTOR,
    layers=T.ArrayType(DESCRIPTOR),
    manifests=T.ArrayType(DESCRIPTOR),
)

LINK_BODY = _struct(target=TEXT, created_at=TEXT, accessed_at=TEXT, referenced_by=T.ArrayType(TEXT), media_type=TEXT)
TAG_BODY = _struct(at=TEXT, media_type=TEXT, size=LONG, annotations=TEXT_MAP)
ACCESS_BODY = _struct(client=TEXT, at=TEXT)
SESSION_BODY = _struct(last_activity=TEXT, offset=LONG, hash_state=TEXT)
