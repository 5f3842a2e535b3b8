"""Scalar functions: clocks, durations, backoff, ranges, digests of messages, display forms."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MOST, _LEAST = 2**63 - 1, -(2**63)


def epoch_millis(t: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, read as UTC whatever the session's zone is."""
    return F.unix_millis(F.from_utc_timestamp(t.cast("timestamp"), F.current_timezone()))


def saturating(n: Column, factor: int) -> Column:
    """n * factor, held at the ends of the range of longs."""
    return F.coalesce(F.try_multiply(n.cast("bigint"), F.lit(factor).cast("bigint")), F.when(n > 0, F.lit(_MOST)).otherwise(F.lit(_LEAST)))


def minutes(n: Column) -> Column:
    return saturating(n, 60)


def hours(n: Column) -> Column:
    return saturating(n, 3600)


def days(n: Column) -> Column:
    return saturating(n, 86400)


def rule_seconds(t: Column, missing: Column | int) -> Column:
    """A time in seconds as rules see it: a missing one is ``missing``, one before 1970 is 0."""
    return F.greatest(F.coalesce(t, F.lit(missing) if isinstance(missing, int) else missing), F.lit(0)).cast("bigint")


def backoff_ms(attempt: Column, base: int = 100, factor: float = 2.0, most: int = 10_000) -> Column:
    """The delay before a retry, without jitter: base * factor**attempt, ``most`` at the most."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(factor), attempt), F.lit(float(most))).cast("bigint")


def audit_name(username: Column, ident: Column, internal: Column) -> Column:
    return F.coalesce(username, ident, internal, F.lit("anonymous"))


def parse_range(header: Column) -> Column:
    """struct(kind, first, last) of a Range header: from_to, suffix, whole (several ranges), malformed."""
    body = F.regexp_extract(header, r"^(?i:bytes)=(.*)$", 1)
    known = header.rlike("^(?i:bytes)=")
    first, last = (F.try_to_number(F.nullif(F.regexp_extract(body, r"^([0-9]*)-([0-9]*)$", k), F.lit("")), F.lit("9" * 18)).cast("bigint") for k in (1, 2))
    window = body.rlike("^[0-9]{1,18}-[0-9]{0,18}$")
    kind = (
        F.when(header.isNull() | ~known, "malformed")
        .when(F.contains(body, F.lit(",")), "whole")
        .when(body.rlike("^-[0-9]{1,18}$"), "suffix")
        .when(window & (last.isNull() | (first <= last)), "from_to")
        .otherwise("malformed")
    )
    return F.struct(kind.alias("kind"), first.alias("first"), last.alias("last"))


def resolve_range(r: Column, total: Column) -> Column:
    """struct(outcome, first, last) of a parsed range against a length: partial, whole, unsatisfiable, malformed."""
    suffix, end = r["kind"] == "suffix", total - 1
    last = F.when(suffix, end).otherwise(F.least(F.coalesce(r["last"], end), end))
    first = F.when(suffix, total - F.least(r["last"], total)).otherwise(r["first"])
    outcome = (
        F.when(r["kind"] == "malformed", "malformed")
        .when((r["kind"] == "whole") | (total == 0), "whole")
        .when(suffix & (r["last"] == 0), "unsatisfiable")
        .when(~suffix & (first >= total), "unsatisfiable")
        .otherwise("partial")
    )
    partial = outcome == "partial"
    return F.struct(outcome.alias("outcome"), F.when(partial, first).alias("first"), F.when(partial, last).alias("last"))


def byte_range(content: Column, r: Column) -> Column:
    """The bytes of a resolved range: the part, the whole, or null where the request fails."""
    binary = content.cast("binary")
    part = F.substring(binary, (r["first"] + 1).cast("int"), (r["last"] - r["first"] + 1).cast("int"))
    return F.when(r["outcome"] == "partial", part).when(r["outcome"] == "whole", binary)


def size_text(n: Column) -> Column:
    """A size for people: B, KB, MB or GB with one decimal, ties to the even one as C prints them (Java rounds them up)."""
    shown = F.when(n.isNotNull(), F.format_string("%d B", n))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        x = n / float(1024**power)
        even = F.floor(x) + F.rint((x - F.floor(x)) * 10) / 10
        shown = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", even)).otherwise(shown)
    return shown


def time_ago(seconds: Column) -> Column:
    """How long ago something was, in the largest whole unit up to days."""
    shown = F.concat(F.floor(seconds).cast("string"), F.lit("s ago"))
    for size, unit in ((60, "m"), (3600, "h"), (86400, "d")):
        shown = F.when(seconds >= size, F.concat(F.floor(seconds / size).cast("string"), F.lit(f"{unit} ago"))).otherwise(shown)
    return shown


def window_text(seconds: Column) -> Column:
    """A window of time in words, in the largest whole unit up to days."""
    shown = F.concat(seconds.cast("string"), F.lit(" seconds"))
    for size, unit in ((1, "second"), (60, "minute"), (3600, "hour"), (86400, "day")):
        n = F.floor(seconds / size)
        shown = F.when(seconds >= size, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))).otherwise(shown)
    return shown


def hmac_sha256(key: str):
    """A function of a string column that signs its bytes; Spark has no such built-in."""

    @F.pandas_udf("string")
    def sign(body: pd.Series) -> pd.Series:
        return body.map(lambda b: None if b is None else hmac.new(key.encode(), b.encode(), hashlib.sha256).hexdigest())

    return sign


def hasher_state(text: Column) -> Column:
    """The bytes of a stored hasher checkpoint, null if it is not base64."""
    return F.try_to_binary(text, F.lit("base64"))
