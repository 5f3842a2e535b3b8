"""The graph of manifests: edges, plans for pushes and deletes, the orphan cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Depth beyond which a push of nested indexes is refused.
DEEPEST = 8


def edges(manifests: DataFrame) -> DataFrame:
    """Edges of manifests (ns, digest, parsed manifest ``m``): ns, digest, kind, target. A target named twice is one edge."""
    target = lambda c, kind: F.struct(F.lit(kind).alias("kind"), c["digest"].alias("target"))
    none = F.array().cast("array<struct<kind:string,target:string>>")
    listed: Column = F.concat(
        F.when(F.col("m.config.digest").isNotNull(), F.array(target(F.col("m.config"), "config"))).otherwise(none),
        F.coalesce(F.transform("m.layers", lambda x: target(x, "layer")), none),
        F.coalesce(F.transform("m.manifests", lambda x: target(x, "manifest")), none),
        F.when(F.col("m.subject.digest").isNotNull(), F.array(target(F.col("m.subject"), "subject"))).otherwise(none),
    )
    return manifests.select("ns", "digest", F.explode(F.array_distinct(listed)).alias("e")).select("ns", "digest", "e.kind", "e.target")


def push_plan(manifests: DataFrame, tags: Column) -> DataFrame:
    """The ordered link operations of a push: its revision, its tags, its subject's referrer record, then its edges."""
    op = lambda kind, name, target: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"), target.alias("target"))
    null, own = F.lit(None), F.col("digest")
    many = lambda c, kind: F.coalesce(F.transform(c, lambda x: op(kind, null, x["digest"])), F.array().cast("array<struct<kind:string,name:string,target:string>>"))
    some = lambda c, kind, target: F.when(F.col(c).isNotNull(), F.array(op(kind, null, target))).otherwise(F.array().cast("array<struct<kind:string,name:string,target:string>>"))
    steps = F.concat(
        F.array(op("revision", null, own)),
        F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: op("tag", t, own)),
        some("m.subject.digest", "referrer", F.col("m.subject.digest")),
        some("m.config.digest", "config", F.col("m.config.digest")),
        many("m.layers", "layer"),
        many("m.manifests", "manifest"),
    )
    return manifests.select("ns", "digest", F.posexplode(steps).alias("step", "op")).select("ns", "digest", "step", "op.kind", "op.name", "op.target")


def delete_plan(digests: DataFrame, live: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Link operations that delete revisions (ns, digest): the revision, every tag that points at it, and its edges."""
    own = digests.select("ns", "digest", F.lit("revision").alias("kind"), F.col("digest").cast("string").alias("name"))
    tags = live.join(digests, ["ns", "digest"], "left_semi").select("ns", "digest", F.lit("tag").alias("kind"), F.col("tag").alias("name"))
    out = edge_rows.join(digests, ["ns", "digest"], "left_semi").select("ns", "digest", "kind", F.col("target").cast("string").alias("name"))
    return own.unionByName(tags).unionByName(out)


def orphan_cascade(revisions: DataFrame, pins: DataFrame, edge_rows: DataFrame, deletable: DataFrame, checkpoint: bool = True) -> DataFrame:
    """Revisions to delete, with the round in which they fall.

    revisions and deletable: ns, digest (deletable by policy); pins: what a tag or other
    root holds; edge_rows: ns, digest, target: an index holds its children, and a referrer its
    subject. A revision falls once
    nothing that stays refers to it. Deleting parents frees children, so rounds go on
    until one finds none; content addresses have no cycles, so their number is the
    depth of the graph.

    How many hold a candidate is counted once. A round then joins only the edges of
    what fell in the one before, and a candidate falls when as many of its holders are
    gone as it has. Each round's small results are checkpointed to cut lineage;
    without ``checkpoint`` the plan grows with the depth.
    """
    kept = lambda df: df.checkpoint() if checkpoint else df
    candidates = revisions.join(deletable, ["ns", "digest"], "left_semi").join(pins.select("ns", "digest"), ["ns", "digest"], "left_anti").distinct()
    inner = kept(edge_rows.join(revisions, ["ns", "digest"], "left_semi").select("ns", "digest", "target").distinct())
    holders = inner.groupBy("ns", F.col("target").alias("digest")).agg(F.count(F.lit(1)).alias("holders"))
    counted = kept(candidates.join(holders, ["ns", "digest"], "left").withColumn("holders", F.coalesce("holders", F.lit(0))))
    fall = kept(counted.where("holders = 0").select("ns", "digest", F.lit(0).alias("round")))
    gone, freed, depth = fall, None, 0
    while not fall.isEmpty():
        depth += 1
        less = inner.join(fall.select("ns", "digest"), ["ns", "digest"]).groupBy("ns", F.col("target").alias("digest")).agg(F.count(F.lit(1)).alias("n"))
        less = kept(less.join(counted.select("ns", "digest"), ["ns", "digest"], "left_semi"))
        freed = less if freed is None else freed.unionByName(less)
        so_far = freed.join(less.select("ns", "digest"), ["ns", "digest"], "left_semi").groupBy("ns", "digest").agg(F.sum("n").alias("n"))
        fall = kept(so_far.join(counted, ["ns", "digest"]).where("n = holders").select("ns", "digest", F.lit(depth).alias("round")))
        gone = gone.unionByName(fall)
    return gone


def push_order(edge_rows: DataFrame, roots: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """Manifests below roots (ns, digest) with their greatest depth; deeper ones go first, and any beyond ``deepest`` is ``too_deep``.

    A level a step, at most ``deepest`` + 1 of them; each is checkpointed, so it is
    made once and joins only the level above.
    """
    level = roots.select("ns", F.col("digest").alias("root"), "digest", F.lit(0).alias("depth"))
    child = edge_rows.select("ns", "digest", "target")
    every = level
    for depth in range(1, deepest + 2):
        level = level.select("ns", "root", "digest").join(child, ["ns", "digest"]).select("ns", "root", F.col("target").alias("digest")).distinct().withColumn("depth", F.lit(depth)).checkpoint()
        if level.isEmpty():
            break
        every = every.unionByName(level)
    deepest_at = every.groupBy("ns", "root", "digest").agg(F.max("depth").alias("depth"))
    return deepest_at.withColumn("too_deep", F.col("depth") > deepest)


def tree(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Roots (nodes that nothing else refers to) with their sorted children; references to oneself do not count."""
    real = edge_rows.where(F.col("digest") != F.col("target"))
    roots = nodes.join(real.select("ns", F.col("target").alias("digest")).distinct(), ["ns", "digest"], "left_anti")
    kids = real.groupBy("ns", "digest").agg(F.array_sort(F.collect_set("target")).alias("children"))
    return roots.join(kids, ["ns", "digest"], "left").select("ns", "digest", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def rebuilt_index(edge_rows: DataFrame, held: DataFrame, actual: DataFrame) -> DataFrame:
    """References that manifests call for and the index lacks, only for blobs that the namespace holds already."""
    wanted = edge_rows.select("ns", F.col("target").alias("digest"), "kind").distinct()
    return wanted.join(held, ["ns", "digest"], "left_semi").join(actual, ["ns", "digest", "kind"], "left_anti")


def without_descriptor(index: Column, digest: Column) -> Column:
    """An index's descriptors without one; null (delete the index) if none is left."""
    kept = F.filter(index, lambda d: d["digest"] != digest)
    return F.when(F.size(kept) > 0, kept)


def with_descriptor(index: Column, descriptor: Column) -> Column:
    """An index's descriptors with one, in place of any of the same digest."""
    return F.concat(F.filter(index, lambda d: d["digest"] != descriptor["digest"]), F.array(descriptor))
