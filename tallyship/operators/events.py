"""Events of requests, and their fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyship.functions.grammar import is_digest


def put_events(requests: DataFrame) -> DataFrame:
    """Events of manifest puts (ns, digest, reference, tags), emitted before the write: one push, then one per tag."""
    first = F.array(F.struct(F.lit("manifest.push").alias("kind"), F.lit(None).cast("string").alias("tag")))
    more = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.struct(F.lit("tag.create").alias("kind"), t.alias("tag")))
    return requests.select("*", F.posexplode(F.concat(first, more)).alias("seq", "_e")).select(*requests.columns, "seq", "_e.kind", "_e.tag")


def delete_events(requests: DataFrame) -> DataFrame:
    """Events of manifest deletes (ns, reference): by digest one, by tag also the tag's own."""
    by_digest = is_digest(F.col("reference"))
    none = F.lit(None).cast("string")
    one = F.struct(F.lit("manifest.delete").alias("kind"), F.when(by_digest, F.col("reference")).alias("digest"), none.alias("tag"))
    two = F.struct(F.lit("tag.delete").alias("kind"), none.alias("digest"), F.col("reference").alias("tag"))
    both = F.when(by_digest, F.array(one)).otherwise(F.array(one, two))
    return requests.select("*", F.posexplode(both).alias("seq", "_e")).select(*requests.columns, "seq", "_e.kind", "_e.digest", "_e.tag")


def first_error(outcomes: DataFrame, key: list[str], error: str = "error", seq: str = "seq", required: Column | None = None) -> DataFrame:
    """After all deliveries: the first failure of each key that counts, null for none."""
    counts = F.col(error).isNotNull() if required is None else F.col(error).isNotNull() & required
    return outcomes.groupBy(*key).agg(F.min_by(F.when(counts, F.col(error)), F.when(counts, F.col(seq))).alias("first_error"), F.count_if(F.col(error).isNotNull()).alias("failures"))


def delivery_outcomes(attempts: DataFrame) -> DataFrame:
    """Events after all attempts (event_id, endpoint, policy, attempt, error): how many endpoints have them, how many gave up, and whether the event stands.

    Every endpoint is served, whatever happens to the others. An event fails if a
    required endpoint gave up; the first such, in order of endpoints, says why.
    """
    last = attempts.groupBy("event_id", "endpoint", "policy").agg(F.max_by("error", "attempt").alias("error"))
    bad = F.col("error").isNotNull()
    first = F.min(F.when(bad & (F.col("policy") == "required"), F.struct("endpoint", "error")))
    out = last.groupBy("event_id").agg(F.count_if(~bad).alias("delivered"), F.count_if(bad).alias("gave_up"), first.alias("_first"))
    return out.select("event_id", "delivered", "gave_up", F.col("_first.endpoint").alias("failed_endpoint"), F.col("_first.error").alias("first_error"))


def policy_input(columns: dict[str, Column], action: Column) -> Column:
    """A request as policies see it: a map of the fields that are set."""
    entries = F.array(F.struct(F.lit("action").alias("key"), action.alias("value")), *(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in columns.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
