"""Repeat removal against a dictionary of all windows; suffix arrays against sorted suffixes."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyship.llm import induced, suffixes
from tallyship.llm.blocks import prefix
from tallyship.llm.induced import permuted_common_prefixes, repeated_windows, suffix_array
from tallyship.llm.suffixes import remove_repeats


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([1, 2, 3, 200]), max_size=80))
def test_suffix_arrays(text):
    got = suffix_array(np.array(text, np.uint8))
    assert got.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("alphabet", [1, 2, 4, 50, 70_000])
def test_suffix_arrays_by_recursion(monkeypatch, alphabet):
    """Names of every alphabet are sorted by induction, down to strings of three."""
    monkeypatch.setattr(induced, "FEW", 3)
    monkeypatch.setattr(induced, "STRETCH", 5)
    rng = np.random.default_rng(alphabet)
    for k in range(60):
        text = np.tile(rng.integers(0, alphabet, int(rng.integers(1, 150))), 1 + k % 3)
        plain = text.tolist()
        assert suffix_array(text).tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(b"ab"), min_size=1, max_size=60))
def test_common_prefixes(text):
    data, cap = np.array(text, np.uint8), 20
    order = suffix_array(data)
    got = permuted_common_prefixes(data, order, np.arange(len(text)), cap)
    for i in range(len(text)):
        k = order.tolist().index(i)
        j = order[k - 1] if k else len(text)
        n = 0
        while n < cap and max(i, j) + n < len(text) and text[i + n] == text[j + n]:
            n += 1
        assert got[i] == n


def test_windows_get_equal_numbers():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(30))) for _ in range(60)]
    places, numbers = repeated_windows(np.frombuffer(b"".join(strings), np.uint8), prefix(np.array(list(map(len, strings)))), 6)
    windows = [(i, s[i : i + 6]) for s in strings for i in range(len(s) - 5)]
    assert places.tolist() == [i for i, _ in windows]
    assert len({(w, n) for (_, w), n in zip(windows, numbers.tolist(), strict=True)}) == len({w for _, w in windows}) == len(set(numbers.tolist()))


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            if i is not None or w not in first:
                key = i if i is not None else float("inf")
                first[w] = min(first.get(w, float("inf")), key)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (i if i is not None else float("inf")):
                gone[k : k + 50] = b"\1" * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def _corpus(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    shared = [" ".join(word() for _ in range(n)) for n in (8, 20, 60, 300)]
    texts = []
    for _ in range(120):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 4))]
        parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared)[rng.randrange(20) :])
        texts.append("|".join(parts))
    texts += [texts[5]] * 4 + [texts[6] + "x", texts[7][:-1], texts[8][3:]]
    texts += [None, "", "a" * 49, "a" * 50, "a" * 51, "a" * 5000, "ab" * 40, "b" + "a" * 60, "é" * 25, "é" * 26]
    return texts


@pytest.mark.parametrize("crowd", [suffixes.CROWD, 3])
def test_equals_all_windows(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 4000)
    rng = random.Random(crowd)
    texts = _corpus(rng)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True)) + [(3, texts[9]), (3, texts[9]), (None, texts[10]), (None, texts[11] + "z")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string").repartition(5)
    assert sorted(map(tuple, remove_repeats(df).collect()), key=str) == brute(rows)


def test_pieces_of_a_shard_are_all_sorted(monkeypatch):
    """A piece that alone has its minimizer is in the array too, if it stands in two documents."""
    seen = []
    monkeypatch.setattr(suffixes, "repeated_windows", lambda data, offsets, width: seen.append(data.tobytes()) or repeated_windows(data, offsets, width))
    rng = np.random.default_rng(4)
    one, two, three = (bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (81, 60, 55))
    table = pa.table({"low": [1, 4, 7], "high": [2, 4, 9], "key": [5, 6, 7], "salts": [1, 1, 3], "piece": pa.array([one, two, three], pa.binary())})
    runs = suffixes._sorting(table).to_pylist()
    assert seen == [one + three]
    assert sorted((r["from"], r["to"], r["first_ord"], r["salts"]) for r in runs) == [(0, 5, 7, 3), (0, 31, 1, 1)]


def test_pieces_left_out_share_no_window():
    """Pieces around one minimizer, of which some share a window: all of these meet others, and most of the rest do not."""
    rng = np.random.default_rng(12)
    draw = lambda n: bytes(rng.integers(97, 101, n).astype(np.uint8))
    texts = [draw(400) for _ in range(30)]
    for k in range(0, 30, 3):  # the next two get a part of this one, of 20 to 80 bytes
        for j in (1, 2):
            n, at = int(rng.integers(20, 81)), int(rng.integers(0, 300))
            texts[k + j] = texts[k + j][:150] + texts[k][at : at + n] + texts[k + j][150 + n :]
    pieces = set()
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        at, hashed, least = suffixes.minimizers(data, np.array([0, len(data)]))
        for p in at.tolist():
            has = [i for i in range(max(0, p - 30), min(p, len(least) - 1) + 1) if least[i] == hashed[p]]
            pieces.add((int(hashed[p]), t[has[0] : has[-1] + 50]))
    pieces = sorted(pieces)
    windows = {}
    for k, (_, p) in enumerate(pieces):
        for i in range(len(p) - 49):
            windows.setdefault(p[i : i + 50], set()).add(k)
    sharing = {k for w in windows.values() if len(w) > 1 for k in w}
    meets = suffixes._meet_others(np.frombuffer(b"".join(p for _, p in pieces), np.uint8), prefix(np.array([len(p) for _, p in pieces])))
    assert sharing and sharing <= set(np.flatnonzero(meets).tolist()) and meets.sum() < len(pieces) / 2


def test_texts_longer_than_a_block(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    long = " ".join(word() for _ in range(500_000))
    assert len(long) > 2 << 20
    rows = [(1, "x#" + long[1_000_000:1_000_100] + "#y"), (2, long), (3, long[:70] + "!"), (4, long)]
    got = {r[0]: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and (got[2].n_removed, got[2].n_spans) == (100, 1) and (got[3].n_removed, got[4].n_removed) == (70, len(long))
    assert got[2].kept_sha256 == hashlib.sha256((long[:1_000_000] + long[1_000_100:]).encode()).hexdigest()


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, remove_repeats(docs).collect()), key=str)
    assert got == brute(rows) and any(r[2] for r in got)


def test_no_rows(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert remove_repeats(spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")).count() == 2


@pytest.mark.parametrize("part", [1, 31, 1000])
def test_minimizers_are_the_same_in_parts(monkeypatch, part):
    rng = np.random.default_rng(3)
    data, offsets = rng.integers(97, 100, 700).astype(np.uint8), np.array([0, 49, 99, 400, 400, 700])
    whole = suffixes.minimizers(data, offsets)
    monkeypatch.setattr(suffixes, "PART", part)
    assert all((a == b).all() for a, b in zip(whole, suffixes.minimizers(data, offsets), strict=True))


def test_names_that_stand_once_are_not_sorted_again(monkeypatch):
    """Of the string of names only those that recur are sorted, and the first behind each of them; a separator ends what is compared."""
    monkeypatch.setattr(induced, "FEW", 300)
    rng = np.random.default_rng(8)
    words = [bytes(rng.integers(97, 105, int(rng.integers(2, 6))).astype(np.uint8)) for _ in range(60)]
    pieces = [b" ".join(words[k] for k in rng.integers(0, 60, 20))[:80] for _ in range(400)]
    pieces += [pieces[k][int(rng.integers(0, 20)) :] for k in range(40)]
    data, offsets = np.frombuffer(b"".join(pieces), np.uint8), prefix(np.array(list(map(len, pieces))))
    plain, sizes = induced.suffix_array, []
    monkeypatch.setattr(induced, "suffix_array", lambda text, *end: sizes.append(len(text)) or plain(text, *end))
    places, numbers = induced.repeated_windows(data, offsets, 50)
    windows = [p[i : i + 50] for p in pieces for i in range(len(p) - 49)]
    assert len(set(zip(windows, numbers.tolist(), strict=True))) == len(set(windows)) == len(set(numbers.tolist())) < len(windows)
    assert len(sizes) >= 3 and sizes[2] < sizes[1] / 4


@pytest.mark.parametrize("few", [3, 40])
def test_windows_get_equal_numbers_by_recursion(monkeypatch, few):
    monkeypatch.setattr(induced, "FEW", few)
    monkeypatch.setattr(induced, "STRETCH", 5)
    rng = np.random.default_rng(few)
    for _ in range(60):
        strings = [bytes(rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(0, 30))).astype(np.uint8)) for _ in range(int(rng.integers(1, 25)))]
        places, numbers = repeated_windows(np.frombuffer(b"".join(strings), np.uint8), prefix(np.array(list(map(len, strings)))), 6)
        windows = [s[i : i + 6] for s in strings for i in range(len(s) - 5)]
        assert len(set(zip(windows, numbers.tolist(), strict=True))) == len(set(windows)) == len(set(numbers.tolist()))


def test_a_text_gives_the_pieces_of_its_own_minimizers():
    """Two texts of one block with the same bytes, of which different minimizers are shared."""
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 123, 400).astype(np.uint8)).decode()
    at, hashed, _ = suffixes.minimizers(np.frombuffer(text.encode(), np.uint8), np.array([0, 400]))
    keys = suffixes._dealt(hashed[at])
    rows = pa.RecordBatch.from_pydict({"text": [text] * 3, "hashes": pa.array([keys[1:3].tobytes(), b"", keys[4:5].tobytes()], pa.binary())})
    block = next(suffixes.blocks(iter([rows])))
    row, _, _, key, _ = suffixes._pieces(block, 10, np.zeros(0, np.uint64))
    assert row.tolist() == [0, 0, 2] and key.tolist() == (keys[[1, 2, 4]] & suffixes._same_bits(10)).tolist()
