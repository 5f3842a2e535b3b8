"""Secret scans by pattern and by sliding-window entropy, in SQL expressions only.

Patterns give the spans of assignments, access keys and hex strings. Beyond them,
candidate strings (long runs of key characters) are classed by the characters they
use, and a window slides over each: the Shannon entropy of its characters is kept
up to date from the counts of the character that enters and the one that leaves.
Counts are packed twelve to a long, so a step changes two numbers, and the sum of
c*log2(c) is kept in units of 2**-32, so it does not drift however long a string is.
Candidates with a window above the threshold of their class are reported unless a
rule of the allow list knows them or a pattern has found them already. All work is
in proportion to a text's length and the number of its spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyship.llm.shared import bound, free_names, running_greatest, running_totals, sha256_hex, text_or_empty

#: The base patterns, with the group whose length decides, its least length, and words one of which every match has.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", ASSIGN, 2, 12, ("passw", "secret", "token", "api")),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18, ("akia",)),
    ("hex", r"([0-9a-f]{16,})", 1, 16, ()),
)
ENTROPY = "entropy"

CANDIDATE = r"([A-Za-z0-9+/_-]{20,})"

#: Twelve counts of five bits fit in a long.
PACKED, COUNT_BITS = 12, 5

#: c*log2(c) is counted in parts of one.
UNIT = 1 << 32


@dataclass(frozen=True)
class CharClass:
    """Characters of a candidate, all of them among ``alphabet``; ``needs`` must all be found in it, and a window has ``bits`` at least."""

    name: str
    alphabet: str
    pattern: str
    needs: tuple[str, ...]
    window: int
    bits: float


#: The first class that fits counts.
CLASSES = (
    CharClass("hex", "0123456789abcdefABCDEF", r"^[0-9A-Fa-f]+$", ("[0-9]", "[A-Fa-f]"), 20, 3.0),
    CharClass("lower", "abcdefghijklmnopqrstuvwxyz0123456789", r"^[a-z0-9]+$", ("[0-9].*[0-9]", "[a-z]"), 20, 3.7),
    CharClass("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r"^[A-Z0-9]+$", ("[0-9].*[0-9]", "[A-Z]"), 20, 3.7),
    CharClass("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", r"^[A-Za-z0-9+/_-]+$", ("[0-9]", "[A-Z]", "[a-z]"), 20, 3.8),
)

#: Candidates that are known to be no secrets: UUIDs and paths; and what a span found may not have in it: placeholders, runs of one character.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^/?(?:[a-z_-]++/)++[A-Za-z0-9_-]{0,15}$",
)
ALLOWED_INSIDE = (
    r"(?i)example|placeholder|changeme|your[_-]",
    r"(.)\1{7,}",
    r"(?i)abcdefghij|0123456789",
)


def _table(values: list[int], kind: str = "int") -> Column:
    return F.lit(values).cast(f"array<{kind}>")


def _n_log_n(c: int) -> int:
    return round(c * math.log2(c) * UNIT) if c > 1 else 0


def entropy_span(text: Column, kind: CharClass) -> Column:
    """struct(first, stop): where windows of at least ``kind.bits`` begin and end in a string of the class, first null if none do.

    The sum of c*log2(c) over the counts c of a window changes with the two counts
    that a step touches; the entropy of a window of w characters is log2(w) - sum/w.
    """
    w, longs = kind.window, -(-len(kind.alphabet) // PACKED)
    if w >= 1 << COUNT_BITS:
        raise ValueError(f"a window has {(1 << COUNT_BITS) - 1} characters at most")
    number = [max(kind.alphabet.find(chr(c)), 0) for c in range(128)]
    held_in, from_bit = _table([n // PACKED for n in number]), _table([n % PACKED * COUNT_BITS for n in number])
    grows = _table([_n_log_n(c + 1) - _n_log_n(c) for c in range(w + 1)], "bigint")
    most = math.floor((math.log2(w) - kind.bits) * w * UNIT + w)  # w parts for rounding
    at = F.transform(F.split(text, ""), lambda c: F.struct(F.element_at(held_in, F.ascii(c) + 1).alias("long"), F.element_at(from_bit, F.ascii(c) + 1).alias("bit")))
    steps = bound(at, lambda at: F.transform(at, lambda x, i: F.struct(x.alias("now"), F.get(at, i - w).alias("gone"))))
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x["bit"])
    count = lambda s, x: F.call_function("shiftright", F.get(s["counts"], x["long"]), x["bit"]).bitwiseAND(F.lit((1 << COUNT_BITS) - 1).cast("bigint")).cast("int")
    if_at = lambda j, x: F.when(j == x["long"], one(x)).otherwise(F.lit(0).cast("bigint"))

    def step(s: Column, x: Column) -> Column:
        leaves = F.coalesce(F.element_at(grows, count(s, x["gone"])), F.lit(0))
        had = count(s, x["now"]) - F.coalesce(x["now"] == x["gone"], F.lit(False)).cast("int")
        changed = F.transform(s["counts"], lambda held, j: held + if_at(j, x["now"]) - if_at(j, x["gone"]))

        def after(total: Column) -> Column:
            at = s["at"] + 1
            high = (at >= w) & (total <= most)
            return F.struct(
                at.alias("at"),
                changed.alias("counts"),
                total.alias("total"),
                F.when(high & s["first"].isNull(), at - w).otherwise(s["first"]).alias("first"),
                F.when(high, at).otherwise(s["stop"]).alias("stop"),
            )

        return bound(s["total"] - leaves + F.element_at(grows, had + 1), after)

    state = F.struct(F.lit(0).alias("at"), _table([0] * longs, "bigint").alias("counts"), F.lit(0).cast("bigint").alias("total"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("stop"))
    return bound(F.aggregate(steps, state, step), lambda end: F.struct(end["first"].alias("first"), end["stop"].alias("stop")))


def _matches(text: Column, pattern: str, group: int) -> Column:
    """array<struct<whole, part, start>> of the leftmost non-overlapping matches; starts count code points."""
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
        F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("bigint")).alias("gaps"),
    )

    def placed(m: Column) -> Column:
        gaps = F.slice(m["gaps"], F.lit(1), F.size(m["whole"]))
        sizes = F.transform(F.arrays_zip(gaps.alias("gap"), m["whole"].alias("whole")), lambda z: z["gap"] + F.length(z["whole"]))
        zipped = F.arrays_zip(m["whole"].alias("whole"), m["part"].alias("part"), gaps.alias("gap"), running_totals(sizes).alias("before"))
        return F.transform(zipped, lambda z: F.struct(z["whole"].alias("whole"), z["part"].alias("part"), (z["before"] + z["gap"]).alias("start")))

    return bound(found, placed)


def _span(start: Column, stop: Column, rank: int, name: str) -> Column:
    return F.struct(start.cast("bigint").alias("start"), F.lit(rank).alias("rank"), stop.cast("bigint").alias("stop"), F.lit(name).alias("kind"))


_NO_SPANS = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"


def _pattern_spans(text: Column, lowered: Column, rank: int) -> Column:
    name, pattern, group, least, words = KINDS[rank]
    found = F.transform(
        F.filter(_matches(text, pattern, group), lambda m: F.length(m["part"]) >= least),
        lambda m: _span(m["start"], m["start"] + F.length(m["whole"]), rank, name),
    )
    there = F.lit(False) if words else text.rlike(pattern)
    for word in words:
        there = there | F.contains(lowered, F.lit(word))
    return F.when(there, found).otherwise(F.array().cast(_NO_SPANS))


def _entropy_spans(text: Column) -> Column:
    def judged(m: Column) -> Column:
        string = m["whole"]
        known = F.lit(False)
        for rule in ALLOWED:
            known = known | string.rlike(rule)
        span = F.lit(None).cast("struct<first:int,stop:int>")
        for kind in reversed(CLASSES):
            fits = string.rlike(kind.pattern)
            for need in kind.needs:
                fits = fits & string.rlike(need)
            span = F.when(fits & (F.length(string) >= kind.window), entropy_span(string, kind)).otherwise(span)
        return F.struct(string.alias("whole"), m["start"].alias("start"), F.when(~known, span).alias("span"))

    def placeholder(x: Column) -> Column:
        inside = F.substring(x["whole"], x["span"]["first"] + 1, x["span"]["stop"] - x["span"]["first"])
        said = F.lit(False)
        for rule in ALLOWED_INSIDE:
            said = said | inside.rlike(rule)
        return said

    found = F.transform(_matches(text, CANDIDATE, 0), judged)
    high = F.filter(found, lambda x: x["span"]["first"].isNotNull() & ~placeholder(x))
    spans = F.transform(high, lambda x: _span(x["start"] + x["span"]["first"], x["start"] + x["span"]["stop"], len(KINDS), ENTROPY))
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.array().cast(_NO_SPANS))


def _apart(extra: Column, base: Column) -> Column:
    """The spans of ``extra`` that overlap none of ``base``: none before them reaches into them, and none after them begins in them."""
    far = 1 << 62

    def pick(spans: Column) -> Column:
        reach = running_greatest(F.transform(spans, lambda s: F.when(s["rank"] < len(KINDS), s["stop"]).otherwise(F.lit(-1).cast("bigint"))))
        ahead = F.reverse(running_greatest(F.reverse(F.transform(spans, lambda s: F.when(s["rank"] < len(KINDS), -s["start"]).otherwise(F.lit(-far).cast("bigint")))), -far))
        zipped = F.arrays_zip(spans.alias("span"), reach.alias("reach"), ahead.alias("ahead"))
        free = F.filter(zipped, lambda z: (z["span"]["rank"] == len(KINDS)) & (z["reach"] <= z["span"]["start"]) & (-z["ahead"] >= z["span"]["stop"]))
        return F.transform(free, lambda z: z["span"])

    return F.when((F.size(extra) == 0) | (F.size(base) == 0), extra).otherwise(bound(F.array_sort(F.concat(base, extra)), pick))


def with_secret_spans(docs: DataFrame, text_col: str = "text", base: str = "_secret_base", extra: str = "_secret_extra") -> DataFrame:
    """Adds two arrays of struct(start, rank, stop, kind): spans of the base patterns, and further spans found by entropy.

    Positions count code points, ends are exclusive; arrays are sorted by start and
    then kind. A null or empty text has no spans. An entropy span that overlaps a
    base span is left out, as the base has found it. Rows stay as they are: repeated
    rows are each scanned, no rows give no rows, and other columns are kept. The two
    new names must be free, or a ``ValueError`` says so.
    """
    if {base.lower(), extra.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"a column is named {base} or {extra} already")
    whole, lower = free_names(docs, "_secret_text", "_secret_lower")
    text = text_or_empty(text_col)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    lowered = docs.select(*kept, text.alias(whole), F.lower(text).alias(lower))
    scanned = lowered.select(
        *kept,
        F.array_sort(F.concat(*(_pattern_spans(F.col(whole), F.col(lower), r) for r in range(len(KINDS))))).alias(base),
        _entropy_spans(F.col(whole)).alias(extra),
    )
    return scanned.select(*kept, base, _apart(F.col(extra), F.col(base)).alias(extra))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


#: Characters of the blocks from which the kept parts of a text are cut.
BLOCK_CHARS = 4096


def _cut(blocks: Column, first: Column, stop: Column) -> Column:
    """Characters first to stop of a text in blocks; only its own blocks are read."""
    of = lambda n: F.floor(n / BLOCK_CHARS).cast("int")
    at = lambda n: (n % BLOCK_CHARS).cast("int")
    block = lambda n: F.coalesce(F.get(blocks, n), F.lit(""))
    same = F.substring(block(of(first)), at(first) + 1, (stop - first).cast("int"))
    between = F.array_join(F.slice(blocks, of(first) + 2, F.greatest(of(stop) - of(first) - 1, F.lit(0))), "")
    across = F.concat(F.substring(block(of(first)), at(first) + 1, F.lit(BLOCK_CHARS)), between, F.substring(block(of(stop)), F.lit(1), at(stop)))
    return F.when(of(first) == of(stop), same).otherwise(across)


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every span, overlapping ones together, replaced by ``mark``.

    Kept parts are cut from blocks of the text, so the work is in proportion to the
    text and the number of spans, not to their product.
    """

    def clean(x: Column) -> Column:
        reach = running_greatest(F.transform(x["spans"], lambda s: s["stop"]), 0)
        fresh = F.filter(F.arrays_zip(x["spans"].alias("span"), reach.alias("reach")), lambda z: z["span"]["start"] >= z["reach"])
        parts = F.transform(fresh, lambda z: _cut(x["blocks"], z["reach"], z["span"]["start"]))
        rest = _cut(x["blocks"], F.array_max(F.transform(x["spans"], lambda s: s["stop"])), x["n"])
        return F.array_join(F.concat(parts, F.array(rest)), mark)

    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK_CHARS), F.lit(0))
    given = F.struct(F.array_sort(spans).alias("spans"), blocks.alias("blocks"), F.length(text).cast("bigint").alias("n"))
    return F.when(F.size(spans) > 0, bound(given, clean)).otherwise(text)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256 and spans (see ``with_secret_spans``)."""
    found = with_secret_spans(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    count = lambda r: F.size(F.filter("_secret_base", lambda s: s["rank"] == r)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(r).alias(f"n_{name}") for r, (name, *_) in enumerate(KINDS)),
        sha256_hex(spans_text(F.col("_secret_base"))).alias("base_sha256"),
        spans_text(F.array_sort(F.concat("_secret_base", "_secret_extra"))).alias("spans"),
    )


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with all spans replaced in their texts; a column ``n_chars``, if there, counts the new text.

    A null or empty text, and one without secrets, stays as it is, and so do all
    other columns, whatever their names. Repeated rows are each redacted; no rows
    give no rows; a text as long as it may be is redacted whole.
    """
    base, extra, spans, clean = free_names(docs, "_secret_base", "_secret_extra", "_secret_spans", "_secret_clean")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    found = with_secret_spans(docs, text_col, base, extra).select(*kept, F.concat(base, extra).alias(spans))
    whole = F.col(f"`{text_col}`").cast("string")
    done = found.select(*kept, F.when(F.size(spans) > 0, redact(whole, F.col(spans))).alias(clean))
    there = F.col(clean).isNotNull()
    new = {text_col: F.when(there, F.col(clean)).otherwise(F.col(f"`{text_col}`")).cast(docs.schema[text_col].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(there, F.length(clean)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))
