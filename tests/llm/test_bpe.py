"""Merge replay against the tiktoken library, and the round trip."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyship.llm.bpe import ReplayEncoder, Vocabulary, bpe_decode, bpe_digests, bpe_encode, replay
from tallyship.llm.blocks import prefix

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "don't 's stop's", "a  b \n\n c", "x  y ", "<|endoftext|>", "a" * 5000, "ab" * 999 + "b", "é𝄞中文 ́a", "12 345,6", "\x1c\x85 z"]


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return ReplayEncoder(PATH, P.PATTERN)


def _encode(encoder, texts):
    raw = [(t or "").encode() for t in texts]
    ids, offsets = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), prefix(np.array([len(r) for r in raw], np.int64)))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abeinrsth's., \n12é 中"))), max_size=4))
def test_equals_tiktoken(plain, encoder, texts):
    assert _encode(encoder, texts) == [plain.encode_ordinary(t) for t in texts]


def test_edges(plain, encoder):
    assert _encode(encoder, TEXTS) == [plain.encode_ordinary(t or "") for t in TEXTS]


def _toy(tmp_path, more):
    tokens = [bytes([b]) for b in range(256)] + more
    path = tmp_path / "toy"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    return Vocabulary(str(path))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=12), max_size=5), st.permutations([b"ab", b"bc", b"abc", b"aa", b"aaa", b"ca", b"cab", b"bca", b"aab"]))
def test_any_order_of_ranks(tmp_path_factory, words, order):
    v = _toy(tmp_path_factory.mktemp("v"), order)
    raw = [w.encode() for w in words]
    ids, lengths = replay(v, raw)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])][: len(raw)] == [v.merge_one(w) for w in raw]


def test_pairs_side_by_side_with_a_lower_rank_between(tmp_path):
    """aaaa: the first aa makes aaa, which ranks below aa, before the second aa can."""
    v = _toy(tmp_path, [b"aaa", b"aa"])
    ids, _ = replay(v, [b"aaaa", b"aaaaaaa", b"aa"])
    assert ids.tolist() == [*v.merge_one(b"aaaa"), *v.merge_one(b"aaaaaaa"), 257]


def test_documents(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (5, "twice"), (5, "twice")], "doc_id long, text string")
    both = docs.union(extra)
    want = sorted((i if i is not None else -1, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in both.collect() for x in [plain.encode_ordinary(t or "")])
    got = bpe_digests(both, PATH, P.PATTERN).collect()
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got) == want
    back = bpe_decode(bpe_encode(extra, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted((r.doc_id or -1, bytes(r.decoded)) for r in back) == sorted((i or -1, (t or "").encode()) for i, t in extra.collect())
    assert bpe_digests(extra.limit(0), PATH, P.PATTERN).count() == 0
