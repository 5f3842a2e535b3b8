"""Quality rules by repetition coverage.

For n-grams of several lengths, rolling hashes find those that occur twice or more
in a text, and the share of the text's characters inside them is measured; the same
for duplicated lines. A text whose share exceeds the limit of any length is dropped.
Texts are judged one by one, so the work is a map over blocks of texts: no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyship.llm.blocks import BLANK, Block, blocks, mixed, numbered, prefix, words, worker_keeps

#: Largest share of a text's word characters inside duplicated n-grams, by n, and inside repeated lines.
NGRAM_LIMITS = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
LINE_LIMIT = 0.30

#: The base rule: fewest words, n of its windows, and percent of words that may lie in repeated windows.
LEAST_WORDS, BASE_N, BASE_PERCENT = 20, 8, 30

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

_STEP = np.uint64(0xD6E8FEB86659FD93)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _covered(begins: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in windows of n words at the given places, all different."""
    depth = np.zeros(total + 1, np.int8)
    depth[begins] += 1
    depth[begins + n] -= 1
    return np.cumsum(depth[:-1], dtype=np.int8) > 0  # n windows at most cover a word


def _within(places: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many of the sorted places lie between each edge and the next."""
    return np.diff(np.searchsorted(places, edges))


def measure(block: Block) -> dict[str, np.ndarray]:
    """Counts for each text of a block; chars are code points.

    Sums are taken over words, not over bytes, so a block needs some sixteen bytes of
    memory for a byte of text.
    """
    data, offsets, texts = block.data, block.offsets, len(block.offsets) - 1
    starts, stops = words(data, offsets)
    sizes = stops - starts
    letters = np.append(data, np.uint8(0)) & 0xC0 != 0x80  # first bytes of code points; one more so that every edge is in range
    length = np.add.reduceat(letters, np.stack([starts, stops], 1).ravel(), dtype=np.int32)[::2] if len(starts) else np.zeros(0, np.int32)
    del letters
    owner = (np.searchsorted(offsets, starts, "right") - 1).astype(np.int32)
    first = np.searchsorted(starts, offsets)  # each text's first word
    ids = numbered(data[~BLANK[data]], prefix(sizes))

    per_text = lambda x: (s := prefix(x))[first[1:]] - s[first[:-1]]
    out = {"n_words": np.diff(first), "word_chars": per_text(length)}
    out["n_symbols"] = _within(np.flatnonzero(SYMBOL[data]), offsets)

    # n-grams: the hash of n+1 words is made from that of n; a longer n-gram can repeat only where the shorter one does
    symbols, salt = mixed(ids), mixed(np.arange(texts, dtype=np.uint64) + np.uint64(1 << 40))
    last = first[owner + 1]
    at, hashed = np.arange(len(ids)), np.zeros(len(ids), np.uint64)
    known = None
    for n in range(1, max(*NGRAM_LIMITS, BASE_N) + 1):
        fits = at + n <= last[at]
        at, hashed = at[fits], hashed[fits]
        hashed = hashed * _STEP + symbols[at + n - 1]
        if n not in NGRAM_LIMITS and n != BASE_N:
            continue
        known = _repeated(mixed(hashed ^ salt[owner[at]]))
        at, hashed = at[known], hashed[known]
        covered = _covered(at, n, len(ids))
        out[f"dup_{n}_chars"] = per_text(np.where(covered, length, 0))
        if n == BASE_N:
            out["n_repeat_words"] = per_text(covered)

    # lines, without their ends
    ends = np.flatnonzero(data == 10)
    begin = np.union1d(ends + 1, offsets)
    line = numbered(data[data != 10], begin - np.searchsorted(ends, begin))
    line_owner = np.searchsorted(offsets, begin[:-1], "right") - 1
    line_words = np.searchsorted(starts, begin)
    worded = np.diff(line_words) > 0
    key = line_owner * (line.max(initial=0) + 1) + line
    rank = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[rank[1:]] = key[rank[1:]] == key[rank[:-1]]
    again &= worded
    in_line = (s := prefix(length))[line_words[1:]] - s[line_words[:-1]]
    out["n_dup_lines"] = np.bincount(line_owner[again], minlength=texts)
    out["dup_line_chars"] = np.bincount(line_owner[again], weights=in_line[again], minlength=texts).astype(np.int64)
    return out


def _verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
    over = m["dup_line_chars"] > LINE_LIMIT * m["word_chars"]
    for n, limit in NGRAM_LIMITS.items():
        over |= m[f"dup_{n}_chars"] > limit * m["word_chars"]
    return failed, ~(failed | over)


REPORT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}_chars" for n in NGRAM_LIMITS)]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_keeps("quality", dict)
    for block in blocks(batches):
        m = measure(block)
        failed, kept = _verdict(m)
        columns = [block.rows.column("doc_id"), *(pa.array(m[c].astype(np.int64)) for c in REPORT), pa.array(failed), pa.array(kept)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *REPORT, "base_failed", "kept"])


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the counts of ``REPORT``, base_failed and kept.

    Words are runs of characters other than ASCII white space. A null or empty text
    has no words and fails the base rule, as does any text of under 20 words; a text
    as long as it may be is judged whole. Repeated rows are judged alike, each on its
    own; no rows give no rows. Only the two columns are read.
    """
    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in REPORT) + ", base_failed boolean, kept boolean"
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_judge, schema)


def _keeping(text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("quality", dict)
        for block in blocks(batches, text_col):
            yield block.rows.filter(pa.array(_verdict(measure(block))[1]))

    return keep


def keep_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns, whatever their names.

    A null or empty text, and one without words, goes. Repeated rows are judged alike,
    each on its own, and ties do not arise; a text as long as it may be is judged
    whole; no rows give no rows.
    """
    return docs.mapInArrow(_keeping(text_col), docs.schema)
