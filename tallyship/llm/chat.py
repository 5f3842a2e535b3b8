"""Chat formatting with typed content parts, in SQL expressions only.

A turn's content is an array of typed parts. The visitor of each kind flattens a
part into text: text parts are escaped, image, audio and document parts become
ordered placeholders, each with an attachment reference and the number of tokens
that it will expand to. Turns are then joined into one text by a template that
marks every turn, with the spans of the assistant's text as the loss mask.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyship.llm.shared import running_totals

#: The template's marks. Those of other chat formats are escaped too.
TURN, END, NEWLINE = "<|turn|>", "<|end|>", "<|nl|>"

#: What opens a control string, and what follows it; a backslash between the two takes its meaning away.
_OPEN, _REST = r"([<\[])", r"(\||/?s>|/?INST\])"

PART = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.LongType()),
    ]
)

#: Tokens that the placeholders expand to: a patch of an image, a second of audio, a page of a document.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1024


def escape(text: Column) -> Column:
    """Takes the meaning from control strings; ``unescape`` gives the text back."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _OPEN + _REST, "$1\\\\$2")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.replace(F.regexp_replace(text, _OPEN + r"\\" + _REST, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A string column as an array with one text part."""
    fields = [F.lit("text").alias("kind"), text.alias("text")] + [F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]]
    return F.array(F.struct(*fields))


def _placeholder(kind: str) -> Column:
    return F.lit(f"<|{kind}|>")


#: Visitors: for each kind of part, its text and the tokens that its placeholder expands to.
VISITORS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "text": (lambda p: escape(F.coalesce(p["text"], F.lit(""))), lambda p: F.lit(0).cast("bigint")),
    "image": (
        lambda p: _placeholder("image"),
        lambda p: (F.ceil(F.coalesce(p["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(p["height"], F.lit(0)) / PATCH)).cast("bigint"),
    ),
    "audio": (lambda p: _placeholder("audio"), lambda p: F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE).cast("bigint")),
    "document": (lambda p: _placeholder("document"), lambda p: (F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS).cast("bigint")),
}


def _visit(part: Column) -> Column:
    """A part as struct(body, tokens, ref, unknown); one of an unknown or null kind has an empty body, and is counted."""
    body, tokens = F.lit(""), F.lit(0).cast("bigint")
    for kind, (to_text, to_tokens) in VISITORS.items():
        body = F.when(part["kind"] == kind, to_text(part)).otherwise(body)
        tokens = F.when(part["kind"] == kind, to_tokens(part)).otherwise(tokens)
    media = part["kind"].isin([k for k in VISITORS if k != "text"])
    unknown = ~F.coalesce(part["kind"].isin(list(VISITORS)), F.lit(False))
    return F.struct(body.alias("body"), tokens.alias("tokens"), F.when(media, F.coalesce(part["ref"], F.lit(""))).alias("ref"), unknown.cast("bigint").alias("unknown"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content: Column | str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formats conversations, one row each.

    ``content`` is a string column (one text part a turn) or an ``array`` of
    ``PART``. Returns conv_id; formatted, the text; n_turns; loss, an array of
    struct(char_start, chars, byte_start, bytes) over ``formatted`` in order of
    turns, covering the escaped content of turns in ``loss_roles``; attachments,
    an array of struct(position, ref, tokens) in order of the placeholders;
    expanded_tokens, their sum; and unknown_parts, how many parts are of no known
    kind, whose content is not in the text.

    Turns are ordered by number, nulls first, then by role and content, so that
    repeated or tied rows all stay, in a fixed order. A null role or text counts
    as empty, a null part list as none; rows with a null conversation id are one
    conversation. No rows give no rows. Only the named columns are read. A
    conversation is one output row, so it has to fit in a task.
    """
    parts = text_part(F.col(content).cast("string")) if isinstance(content, str) and not isinstance(turns.schema[content].dataType, T.ArrayType) else (F.col(content) if isinstance(content, str) else content)
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(""))
    visited = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        role.alias("role"),
        F.transform(F.coalesce(parts, F.array().cast(T.ArrayType(PART))), _visit).alias("seen"),
    )
    pieces = visited.select(
        "conv_id",
        "turn",
        "role",
        F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n")).alias("head"),
        F.array_join(F.transform("seen", lambda p: p["body"]), "").alias("body"),
        F.transform(F.filter("seen", lambda p: p["ref"].isNotNull()), lambda p: F.struct(p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("media"),
        F.aggregate("seen", F.lit(0).cast("bigint"), lambda s, p: s + p["unknown"]).alias("unknown"),
    )
    chats = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body", "head", "media", "unknown"))).alias("rows"))
    piece = lambda r: F.concat(r["head"], r["body"], F.lit(END + "\n"))
    placed = chats.select(
        "conv_id",
        "rows",
        running_totals(F.transform("rows", lambda r: F.length(piece(r)).cast("bigint"))).alias("chars"),
        running_totals(F.transform("rows", lambda r: F.octet_length(piece(r)).cast("bigint"))).alias("bytes"),
    )
    span = lambda r, c, b: F.struct(
        r["role"].isin(list(loss_roles)).alias("counts"),
        (c + F.length(r["head"])).alias("char_start"), F.length(r["body"]).cast("bigint").alias("chars"),
        (b + F.octet_length(r["head"])).alias("byte_start"), F.octet_length(r["body"]).cast("bigint").alias("bytes"),
    )
    spans = F.transform(F.arrays_zip("rows", "chars", "bytes"), lambda z: span(z["rows"], z["chars"], z["bytes"]))
    media = F.flatten(F.transform("rows", lambda r: r["media"]))
    return placed.select(
        "conv_id",
        F.array_join(F.transform("rows", piece), "").alias("formatted"),
        F.size("rows").cast("bigint").alias("n_turns"),
        F.transform(F.filter(spans, lambda s: s["counts"]), lambda s: s.dropFields("counts")).alias("loss"),
        F.transform(media, lambda m, i: F.struct(i.alias("position"), m["ref"].alias("ref"), m["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate(media, F.lit(0).cast("bigint"), lambda s, m: s + m["tokens"]).alias("expanded_tokens"),
        F.aggregate("rows", F.lit(0).cast("bigint"), lambda s, r: s + r["unknown"]).alias("unknown_parts"),
    )


def read_turns(formatted: Column) -> Column:
    """Parses a formatted chat of text parts into array<struct<role, text>>."""
    pieces = F.split(formatted, r"<\|turn\|>", -1)
    raw = F.slice(pieces, F.lit(2), F.size(pieces))
    body = lambda x: F.substring(x, F.lit(1), F.length(x) - len(END) - 1)
    cut = lambda x: F.instr(x, "\n")
    return F.transform(F.transform(raw, body), lambda x: F.struct(unescape(F.replace(F.substring(x, F.lit(1), cut(x) - 1), F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(F.substring(x, cut(x) + 1, F.length(x))).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask, as one string."""
    raw = formatted.cast("binary")
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(raw, (s["byte_start"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))), "")
