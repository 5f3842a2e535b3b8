"""Token counts from flat files against a split of the whole file."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyship.llm.separators import count_documents, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _split(ids, separator):
    docs, n = [], 0
    for i in ids:
        if i == separator:
            docs.append((n, True))
            n = 0
        else:
            n += 1
    return docs + [(n, False)] * (n > 0)


@pytest.mark.parametrize("width", [2, 4])
def test_any_block_edges(spark, tmp_path, width):
    rng, want = random.Random(width), {}
    kinds = ([], [7], [7, 7, 7], [1], [1] * 100, [1] * 100 + [7], [7] + [1] * 33, [1, 7] * 40, [1] * 15 + [7] + [1] * 40 + [7, 7] + [1] * 16)
    for i, ids in enumerate([*kinds, *([rng.choice([1, 2, 3, 7]) for _ in range(rng.randrange(300))] for _ in range(12))]):
        (tmp_path / f"f{i}.ids").write_bytes(np.array(ids, f"<u{width}").tobytes() + b"x" * (i % 2))
        want |= {(f"f{i}.ids", k): d for k, d in enumerate(_split(ids, 7))}
    for block in (width, 8 * width, 32 * width, 1 << 20):
        got = count_tokens(spark, str(tmp_path), width, 7, block).collect()
        assert len(got) == len(want) and {(r.file.rpartition("/")[2], r.ordinal): (r.n_tokens, r.ended) for r in got} == want


def test_documents(spark):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (None, "a b", "x"), (5, "twice", "x"), (5, "twice", "x"), (-3, "<|endoftext|>", "x")], docs.schema)
    both = docs.union(extra)
    want = sorted((i if i is not None else -9, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in both.collect())
    got = count_documents(spark, both, PATH, 50256, 1 << 12).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -9, r.n_tokens) for r in got) == want
    assert count_documents(spark, both.limit(0), PATH, 50256).count() == 0
