"""Reconciliation of a store with a downstream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(local: DataFrame, remote: DataFrame, key: list[str], prune: bool, value: str = "digest") -> DataFrame:
    """Keys of either side with ``action``.

    Different or missing downstream: push; equal: converged; a remote look-up that
    failed (``failed`` true): skipped; downstream only: delete if ``prune``, else keep.
    A local row that does not resolve (null value) still counts as local: nothing is
    deleted for it, and nothing pushed.
    """
    mine = local.select(*key, F.col(value).alias("_mine"), F.lit(True).alias("_here"))
    theirs = remote.select(*key, F.col(value).alias("_theirs"), F.coalesce(F.col("failed"), F.lit(False)).alias("_failed"), F.lit(True).alias("_there")) if "failed" in remote.columns else remote.select(*key, F.col(value).alias("_theirs"), F.lit(False).alias("_failed"), F.lit(True).alias("_there"))
    joined = mine.join(theirs, key, "full_outer")
    action = (
        F.when(F.coalesce("_failed", F.lit(False)), "skipped")
        .when(F.col("_here").isNull(), "delete" if prune else "keep")
        .when(F.col("_mine").isNull(), "unresolved")
        .when(F.col("_mine").eqNullSafe(F.col("_theirs")), "converged")
        .otherwise("push")
    )
    return joined.select(*key, F.col("_mine").alias("local"), F.col("_theirs").alias("remote"), action.alias("action"))


def push_outcome(remote_ms, remote_digest, ms, digest):
    """What a push comes to: converged if the remote has the digest, superseded if its tag is newer (or as new and higher), else pushed."""
    newer = F.coalesce((remote_ms > ms) | ((remote_ms == ms) & (remote_digest > digest)), F.lit(False))
    return F.when(remote_digest.eqNullSafe(digest), "converged").when(newer, "superseded").otherwise("pushed")
