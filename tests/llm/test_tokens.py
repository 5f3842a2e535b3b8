"""Token output: chunked encoding, plane files, packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tallyship.llm import queries
from tallyship.llm.bitplanes import PlaneReader, PlaneWriter, from_planes, to_planes, write_and_read
from tallyship.llm.blocks import prefix
from tallyship.llm.packing import cut_pieces, pack, pack_documents, plan_bins, sequences
from tallyship.llm.tokens import TextEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "don't stop, 's it's,'s ,'s x", "a  b  c\n\n d", "  x 　", "<|endoftext|> x", "l" * 3000, "é" * 500 + "𝄞", "#a#b,c;d_e__f 12ab34", "a\x1c b\x1f\x1f c", "“q” – ’s x’s", "\r\n\r\n \tx\n y"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return TextEncoder(PATH)


def _encode(encoder, texts):
    raw = [(t or "").encode() for t in texts]
    ids, offsets = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), prefix(np.array([len(r) for r in raw], np.int64)))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'st.,_ \n\t12é  ́　\x1c\x85中"))), max_size=4))
def test_chunks_encode_as_wholes(plain, encoder, texts):
    assert _encode(encoder, texts) == [plain(t) for t in texts]


def test_encoder_edges(plain, encoder):
    assert _encode(encoder, TEXTS) == [plain(t) for t in TEXTS]
    assert _encode(encoder, TEXTS[::-1]) == [plain(t) for t in TEXTS[::-1]]


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 65536])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert (from_planes(to_planes(ids, bits), n) == ids).all()


def test_file_reads_back_and_seeks(tmp_path):
    import pyarrow as pa
    from pyarrow.fs import LocalFileSystem

    rng, fs = np.random.default_rng(0), LocalFileSystem()
    docs = [rng.integers(0, 50000, n, dtype=np.uint32) for n in (0, 5, 300, 1, 64, 129, 0)]
    with fs.open_output_stream(str(tmp_path / "x")) as out:
        w = PlaneWriter(out, chunk_ids=64)
        for i, d in enumerate(docs):
            w.add(d, pa.array([i], pa.int64()), np.array([len(d)]))
        assert w.close() == (7, 499)
    with fs.open_input_file(str(tmp_path / "x")) as f:
        r = PlaneReader(f)
        assert [(i, d.tolist()) for i, d in r.documents()] == [(i, d.tolist()) for i, d in enumerate(docs)]
        whole = np.concatenate(docs)
        for first, n in ((0, 499), (63, 2), (130, 200), (498, 1), (10, 0)):
            assert (r.ids(first, n) == whole[first : first + n]).all()


def _frame(spark, texts):
    return spark.createDataFrame([(len(texts) - i, t, "x") for i, t in enumerate(texts)] + [(3, "again", "y"), (3, "again", "y"), (None, "no id", "z")], "doc_id long, text string, start string").repartition(3)


def test_plane_files_of_documents(spark, plain):
    got = write_and_read(spark, _frame(spark, TEXTS), PATH, 2).collect()
    want = sorted([(-1, "no id")] + [(len(TEXTS) - i, t or "") for i, t in enumerate(TEXTS)] + [(3, "again")] * 2)
    ids = [[*plain(t), 2] for _, t in want]
    starts = prefix(np.array(list(map(len, ids))))
    rows = [(None if i < 0 else i, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x, s in zip(want, ids, starts, strict=False)]
    assert sorted(got, key=lambda r: r.start) == rows
    assert write_and_read(spark, _frame(spark, []).limit(0), PATH, 2).count() == 0


def _check_bins(counts, bins):
    left, capacity = counts.copy(), len(counts) - 1
    for pieces, times in bins:
        assert sum(n * k for n, k in pieces) <= capacity and times >= 1
        for n, k in pieces:
            left[n] -= k * times
    assert not left.any()
    return sum(t for _, t in bins)


def test_plans_use_every_piece():
    rng = np.random.default_rng(1)
    for capacity in (1, 7, 64, 2048):
        for _ in range(6):
            counts = np.zeros(capacity + 1, np.int64)
            np.add.at(counts, np.minimum(rng.geometric(rng.uniform(0.002, 0.6), 3000), capacity), 1)
            n = _check_bins(counts, plan_bins(counts))
            total = int((counts * np.arange(capacity + 1)).sum())
            assert n <= -(-total // capacity) * 1.03 + 2


def test_two_pieces_replace_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]
    assert plan_bins(counts)[0] == ([(6, 1), (2, 2)], 1)  # 6+3 leaves 1; 2+2 in place of 3 leaves none


def test_packing_documents(spark, plain):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["the", "of", "zq", "é,"]) for _ in range(rng.randrange(2500))) for _ in range(60)]
    df = _frame(spark, texts)
    placed = pack_documents(df, PATH)
    rows = placed.collect()
    docs = {}
    for i, t in df.select("doc_id", "text").collect():
        docs.setdefault(i, []).append([*plain(t), 0])
    pieces = sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for i, all_ids in docs.items():
        for ids in all_ids:
            first = len(ids) % 2048 or 2048
            cuts = [0, *range(first, len(ids) + 1, 2048)]
            want += [(i or -1, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert pieces == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 2048
    assert pack_documents(df.limit(0), PATH).count() == 0


def test_sequences_hold_the_ids(spark, plain):
    df = spark.createDataFrame([(i, "word " * (i * 37 % 90)) for i in range(60)], "doc_id long, text string")
    pieces = cut_pieces(df, PATH, 0, 128, with_ids=True)
    placed = pack(pieces.drop("ids"), 128)
    got = {r.sequence_id: r.ids for r in sequences(placed, pieces).collect()}
    for r in placed.collect():
        assert got[r.sequence_id][r.offset : r.offset + r.length] == [*plain("word " * (r.doc_id * 37 % 90)), 0][r.start : r.start + r.length]
    assert all(len(x) <= 128 for x in got.values())


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>", "<|endoftext|", "|> a", "plain words, no token", "é <|endoftext|>\n 12"]


def test_added_tokens_get_their_ids(spark, tmp_path):
    default = Tokenizer.from_file(PATH)
    want = [default.encode(t or "", add_special_tokens=False).ids for t in ADDED + TEXTS]
    assert want[0] == [64, 220, 50256, 275]
    assert _encode(TextEncoder(PATH, added=True), ADDED + TEXTS) == want
    df = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    planes = queries.op1_bit_planes(spark, str(tmp_path)).collect()
    assert {r[0]: (r[2], r[3]) for r in planes} == {i: (len(want[i]) + 1, crc([*want[i], 2])) for i in range(len(ADDED))}
    for placed in (queries.op2_best_two_fit(spark, str(tmp_path)), corpus_pipeline.packing(spark, df, "")):
        assert {r.doc_id: r.ids_crc32 for r in placed.collect()} == {i: crc([*want[i], 0]) for i in range(len(ADDED))}
