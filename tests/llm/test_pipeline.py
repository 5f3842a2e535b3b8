"""The pipeline against plain versions of its stages."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tallyship.llm import secrets

from .brute_secrets import PATTERNS
from .test_minhash import brute_classes
from .test_native import _windows
from .test_quality import brute as brute_quality

DIR = "/root/testdata/sf0.001"


def _redacted(text):
    base = [(m.start(), m.end()) for _, p, g, least in PATTERNS for m in p.finditer(text) if len(m[g]) >= least]
    spans = list(base)
    for m in re.finditer(secrets.CANDIDATE, text):
        if any(re.search(rule, m[0]) for rule in secrets.ALLOWED):
            continue
        kind = next((k for k in secrets.CLASSES if re.search(k.pattern, m[0]) and all(re.search(n, m[0]) for n in k.needs)), None)
        a, b = _windows(m[0], kind) if kind else (None, None)
        if a is not None and any(re.search(rule, m[0][a:b]) for rule in secrets.ALLOWED_INSIDE):
            continue
        if a is not None and not any(m.start() + a < y and x < m.start() + b for x, y in base):
            spans.append((m.start() + a, m.start() + b))
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[REDACTED]"
        at = max(at, b)
    return out + text[at:]


def brute(rows):
    rows = [r for r in rows if brute_quality(r[1])[-1]]
    best = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        if key not in best or (-len(t), i) < (-len(best[key][1]), best[key][0]):
            best[key] = (i, t)
    rows = sorted(best.values())
    classes = brute_classes([t for _, t in rows])
    return {rows[k][0]: _redacted(rows[k][1]) for k in sorted(set(classes))}


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, before, DIR), "test")
        assert docs.columns == before.columns and docs.dtypes == before.dtypes, name
    assert dict(docs.select("doc_id", "text").collect()) == want
    assert all(len(r.text) == r.n_chars for r in docs.collect())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, total = {}, 0
    for r in corpus_pipeline.run(spark, DIR).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
        total = max(total, r.offset + r.length)
    assert got.keys() == want.keys() and total <= 2048
    for i, pieces in got.items():
        ids = np.array([*t.encode(want[i], add_special_tokens=False).ids, 0], "<u4")
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in pieces) and sum(n for _, n, _ in pieces) == len(ids)


def test_stages_take_empty_and_null_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stored(stage(spark, docs, DIR), "test")
        assert corpus_pipeline.packing(spark, docs, DIR).count() == 0


def test_stages_take_clashing_columns_ties_and_long_texts(spark):
    """Extra columns named as the stages name theirs come through; of ties one stays, and a long text is whole."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    long, short = (" ".join(word() for _ in range(n)) for n in (60_000, 60))
    rows = [(1, long), (1, long), (2, long + " "), (3, short), (4, short.replace(" ", "\n", 1)), (5, None), (None, short), (6, short + " tail")]
    clash = ["_key_id", "_key_digest", "_secret_base", "kept", "label", "salt", "bands", "piece", "Digest"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *range(len(clash))) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, before, DIR), "test")
        assert docs.dtypes == before.dtypes, name
        if name == "exact dedup":
            assert sorted(r.doc_id for r in docs.collect()) == [2, 3, 6]
    got = {r.doc_id: r for r in docs.collect()}
    assert got.keys() == {2, 3} and got[2].text == long + " " and all(tuple(r)[5:] == tuple(range(len(clash))) for r in got.values())
    placed = corpus_pipeline.packing(spark, docs, DIR)
    assert {r.doc_id for r in placed.collect()} == {2, 3}
