"""Near-duplicates against weighted Jaccard similarities of all pairs."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tallyship.llm import minhash
from tallyship.llm.components import components
from tallyship.llm.minhash import Sampler, Weights, keep_one_of_each, near_duplicates, shingle_keys
from tallyship.llm.blocks import prefix


def _shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_classes(texts, similarity=0.8, plain=True):
    """Smallest position of each text's component over all pairs (weights of a small corpus: exact document frequencies)."""
    bags = [_shingles(t) for t in texts]
    unlike = {t or "": b for t, b in zip(texts, bags, strict=True)}
    df = Counter(s for b in unlike.values() for s in b)
    idf = {s: 0.5 + 0.5 * np.log(len(unlike) / n) / np.log(max(len(unlike), 2)) for s, n in df.items()}
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, b in enumerate(bags):
        for s in b or {None: 0}:
            by.setdefault(s, []).append(i)
    pairs = {p for members in by.values() for p in combinations(members, 2)}
    for i, j in pairs:
        a, b = bags[i], bags[j]
        low = sum(min(a[s], b[s]) * idf[s] for s in a.keys() & b.keys())
        high = sum(max(a[s], b[s]) * idf[s] for s in a.keys() | b.keys())
        sim = low / high if high else float((texts[i] or "") == (texts[j] or ""))
        if plain and high:
            sim = max(sim, (a & b).total() / (a | b).total())
        if sim >= similarity - 1e-9:
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return [root(i) for i in range(len(texts))]


def _corpus(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(rng.randrange(40, 160))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:20]:
        for edits in (1, 2, 30):
            c = b[:]
            for _ in range(edits):
                c[rng.randrange(len(c))] = word()
            texts.append(" ".join(c))
    chain = base[30][:]
    for _ in range(8):  # each near the one before, the ends far apart
        chain = chain[3:] + [word() for _ in range(3)]
        texts.append(" ".join(chain))
    return texts + [texts[3]] * 5 + [texts[4].upper(), None, "", " \n", "one two", "one two", "One  TWO", "a b c d e f"]


def test_classes_equal_all_pairs(spark):
    texts = _corpus(random.Random(4))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, node string, label int").repartition(3)
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    want = brute_classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    sizes = Counter(want)
    assert all(got[i].class_size == sizes[want[i]] for i in got)
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_documents_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    want = brute_classes([r.text for r in rows])
    got = dict(near_duplicates(docs).select("doc_id", "class_id").collect())
    assert got == {r.doc_id: rows[w].doc_id for r, w in zip(rows, want, strict=True)}


def test_edges(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert keep_one_of_each(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"), (7, "other words stand here now"), (None, "quite alone in this little table"), (9, "x " * 20000)]
    got = near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and sorted(str(r.class_id) for r in got) == ["7", "7", "7", "7", "9", "None"]
    kept = keep_one_of_each(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(str, kept)) == sorted(map(str, [kept[0].__class__(doc_id=i, text=t) for i, t in rows[1:2] + rows[3:]]))


@pytest.mark.parametrize("sizes", [(minhash.SMALL, minhash.BLOCK), (2, 8), (2, 64)])
def test_large_bucket_of_unlike_texts_loses_no_link(spark, monkeypatch, sizes):
    """Texts that share most shingles but are under the limit of one another, with one true pair among them."""
    monkeypatch.setattr(minhash, "SMALL", sizes[0])
    monkeypatch.setattr(minhash, "BLOCK", sizes[1])
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(60):
        c = base[:]
        for j in rng.sample(range(0, 60, 6), 3):
            c[j] = f"x{k}y{j}"
        texts.append(" ".join(c))
    texts.append(texts[17] + " tail")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(near_duplicates(df).select("doc_id", "class_id").collect())
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_samples_agree_as_often_as_similarity_says():
    rng = np.random.default_rng(3)
    sampler = Sampler(400)
    shingles = np.unique(rng.integers(0, 2**48, 300).astype(np.uint64))
    a = rng.uniform(0.5, 3, len(shingles)).astype(np.float32)
    b = np.where(rng.random(len(shingles)) < 0.3, a * 2, a).astype(np.float32)
    one, two = (sampler.samples(shingles, w, np.array([0]))[0] for w in (a, b))
    assert abs((one == two).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.08


def test_shingles_do_not_depend_on_the_block():
    raw = [t.encode() for t in ["a b c d e f", "", "B C", "é x " * 9]]
    joined = shingle_keys(np.frombuffer(b"".join(raw), np.uint8), prefix(np.array([len(r) for r in raw])))
    for i, r in enumerate(raw):
        keys, tf = shingle_keys(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        own = joined[0] >> np.uint64(48) == i
        assert (joined[0][own] & np.uint64(2**48 - 1)).tolist() == keys.tolist() and joined[1][own].tolist() == tf.tolist()


def test_idf_falls_with_every_doubling_of_the_frequency():
    counts = np.zeros((2, 1 << 16), np.int64)
    counts[:, :11] = 2 ** np.arange(11)
    idf = Weights(counts, 1 << 10).idf[0][:11]
    assert np.allclose(idf, 0.5 + 0.05 * np.arange(10, -1, -1)) and Weights(np.ones((2, 1 << 16), np.int64), 50).idf.max() == 1


def _pairs_at(texts, similarity):
    """All pairs of plain similarity ``similarity`` or more, counted over the texts that share a shingle with each."""
    bags = [_shingles(t) for t in texts]
    number, postings = {}, []
    kept = []
    for i, b in enumerate(bags):
        own = np.fromiter((number.setdefault((s, k), len(number)) for s, n in b.items() for k in range(n)), np.int64)
        postings += [[] for _ in range(len(number) - len(postings))]
        met = [postings[f] for f in own.tolist()]
        if any(met):
            shared = np.bincount(np.fromiter((j for m in met for j in m), np.int64), minlength=i)
            sizes = np.array([len(kept[j]) for j in range(i)])
            kept_pairs = np.flatnonzero(shared >= similarity * (sizes + len(own) - shared) - 1e-9)
            yield from ((int(j), i) for j in kept_pairs if shared[j])
        for f in own.tolist():
            postings[f].append(i)
        kept.append(own)


def test_recall_over_ten_thousand_documents(spark):
    """At least 0.9 of all pairs of different texts at 0.8 or more are in one class; the README gives the figure."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    rng = random.Random(10)
    for i, text in [r for r in rows if len((r[1] or "").split()) > 100][:1500]:  # copies that are just near enough, and some that are not quite
        words = text.split(" ")
        for at in rng.sample(range(len(words)), max(1, len(words) // rng.randrange(44, 90))):
            words[at] = f"w{rng.randrange(10**6)}"
        rows.append((10**6 + i, " ".join(words)))
    first = {}
    for i, t in rows:
        first.setdefault(t or "", i)
    texts, ids = list(first), list(first.values())
    pairs = list(_pairs_at(texts, 0.8))
    got = dict(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).select("doc_id", "class_id").collect())
    found = sum(got[ids[i]] == got[ids[j]] for i, j in pairs)
    print(f"recall {found / len(pairs):.4f} of {len(pairs)} pairs of {len(texts)} texts")
    assert len(texts) > 10_000 and len(pairs) > 1000 and found >= 0.9 * len(pairs)


def test_rows_that_stay_keep_clashing_columns(spark):
    rows = [(1, "a b c d e f g h", 5, None), (1, "a b c d e f g h", 5, None), (2, "a b c d e f g h", 6, 1), (3, None, 7, 2), (4, "x " * 50_000, 8, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key_id int, _KEY_digest int")
    got = keep_one_of_each(df)
    assert got.dtypes == df.dtypes and sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 3), *((100, i) for i in range(101, 140)), *((i, i + 1) for i in range(200, 260))]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 4: 4, 5: 4} | dict.fromkeys(range(100, 140), 100) | dict.fromkeys(range(200, 261), 200)
    assert got == want


def _plain(a, b):
    a, b = _shingles(a), _shingles(b)
    return (a & b).total() / (a | b).total()


def test_copies_do_not_part_a_text_from_its_near_copy(spark):
    """One text's copies are a third of the rows; its near copy is at plain 0.82."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(213)]
    near = base[:]
    for at in (20, 70, 120, 170):
        near[at] = word()
    near += [word()]
    assert 0.81 < _plain(" ".join(base), " ".join(near)) < 0.83
    texts = [" ".join(near)] + [" ".join(base)] * 30 + [" ".join(word() for _ in range(60)) for _ in range(59)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    least = minhash.weights_of(df.withColumn("digest", minhash._digest("text"))).idf.min()
    assert abs(least - (0.5 + 0.5 * np.log(61 / 2) / np.log(61))) < 1e-6  # a frequency of two texts, whatever their copies
    got = dict(near_duplicates(df).select("doc_id", "class_id").collect())
    assert got == {i: 0 if i < 31 else i for i in range(len(texts))}


@pytest.mark.parametrize("small", [minhash.SMALL, 2, 10**6])
def test_plain_similarity_links_inside_a_hot_group(spark, monkeypatch, small):
    """A third of the texts share most shingles, all under the limit of one another but for one pair at plain 0.82."""
    monkeypatch.setattr(minhash, "SMALL", small)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(213)]
    texts = []
    for _ in range(30):
        own = base[:]
        for at in rng.sample(range(5, 205, 10), 5):
            own[at] = word()
        texts.append(" ".join(own))
    near = texts[7].split() + [word()]
    for at in (20, 70, 120, 170):
        near[at] = word()
    texts += [" ".join(near)] + [" ".join(word() for _ in range(60)) for _ in range(59)]
    pairs = {p for p in combinations(range(31), 2) if _plain(texts[p[0]], texts[p[1]]) >= 0.8}
    assert pairs == {(7, 30)} and brute_classes(texts, plain=False) == list(range(len(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(near_duplicates(df).select("doc_id", "class_id").collect())
    assert got == {i: 7 if i == 30 else i for i in range(len(texts))}
