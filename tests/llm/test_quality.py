"""Quality rules against a plain count over words and lines."""

import random
import re
from collections import Counter

from tallyship.llm.quality import LINE_LIMIT, NGRAM_LIMITS, judge_quality, keep_quality

EDGES = [None, "", " \n\t", "one", "a b c d e f g h " * 3, "x\n\nx\nx y\n \n ", "é" * 30 + " ü v", "w " * 19, "w " * 20, "# * $ % & | < > #", "tail\nline\ntail", "a\r\na\r\n", "long " * 30000]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def covered(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        seen, inside = Counter(grams), [False] * len(words)
        for i, g in enumerate(grams):
            if seen[g] > 1:
                inside[i : i + n] = [True] * n
        return inside

    lines, seen, again = text.split("\n"), set(), []
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line) and line in seen:
            again.append(line)
        seen.add(line)
    chars = sum(map(len, words))
    repeat = sum(covered(8))
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    over = sum(len(w) for line in again for w in re.findall(r"[^\x20\x09-\x0D]+", line)) > LINE_LIMIT * chars
    over |= any(sum(len(w) for w, c in zip(words, covered(n), strict=True) if c) > limit * chars for n, limit in NGRAM_LIMITS.items())
    return len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(again), repeat, failed, not (failed or over)


def _rows(df):
    return [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in df.collect()]


def test_matches_plain_counts(spark):
    rng = random.Random(5)
    texts = EDGES + [" ".join(rng.choice(["a", "bb", "c\n", "d\nd", "é", "#"]) for _ in range(rng.randrange(80))) for _ in range(150)]
    texts += [" ".join(rng.choice([f"w{i}" for i in range(40)]) for _ in range(rng.randrange(200))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, kept long")
    assert sorted(_rows(judge_quality(df))) == [(i, *brute(t)) for i, t in enumerate(texts)]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    got = _rows(judge_quality(docs))
    assert sorted(got) == sorted((i, *brute(t)) for i, t in texts.items())
    assert {r[-1] for r in got} == {True, False}
    kept = keep_quality(docs)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {r[0] for r in got if r[-1]}


def test_no_rows_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert judge_quality(empty).count() == 0 and keep_quality(empty).count() == 0
    twice = _rows(judge_quality(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")))
    assert len(twice) == 2 and twice[0] == twice[1]
