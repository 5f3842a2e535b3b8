"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. A count-min sketch counts in how many distinct texts each shingle of five words
   occurs, over all of them. Weights are tf * idf with idf = (1 + log(N/df) / log(N/df0)) / 2
   for N texts: 1 for a shingle of df0 texts or fewer, a half for one of all texts. df0 is
   what the sketch can tell apart: the shingles that share a counter on average, or 1 if
   that is less, so N/df0 is 2**20 over the mean number of distinct shingles a text,
   however many texts there are. The sketch is summed slice by slice over the cluster.
   The half keeps the texts of a hot group together as candidates: with a bare log(N/df)
   the words in which two copies differ outweigh all that they share, and a pair at 0.8
   in a third of 250,000 texts would share a bucket once in twenty times (by calculation).
2. For each of 48 hash functions a text samples one (shingle, quantised weight) so
   that two texts agree with the probability of their weighted Jaccard similarity.
   Bands of four samples put texts into buckets. Equal texts are one node.
3. In a small bucket every two nodes are compared. In a larger one 256 nodes, drawn by
   hash, are compared with all the others, and the links found join nodes into
   components; then every node outside the bucket's main component is compared with
   all of the bucket. So no link between components is lost, and work stays in
   proportion to a bucket's size unless its texts are unlike. Comparisons of a larger
   bucket are dealt out as blocks of 256 by 256 texts, of which each is one product of
   matrices and gives no more rows than it has texts.
4. A comparison computes two Jaccard similarities from the two whole texts, by the
   weights and by plain counts of shingles (idf 1). The greater one counts, so a pair
   in a large group is linked where it would be linked as a rare one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyship.llm.blocks import BLOCK_ROWS, Block, blocks, flat, mixed, stretch_hashes, words, worker_keeps
from tallyship.llm.components import components
from tallyship.llm.shared import matching_rows, stored, text_or_empty

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 12, 4

#: The sketch's size, the slices in which it is summed, and the idf of a shingle of all texts.
SKETCH_ROWS, SKETCH_BITS, SLICES, LEAST_IDF = 2, 20, 64, 0.5

#: Bits of a shingle's hash; the others of a 64-bit key number the text in its block.
HASH_BITS = np.uint64(48)

#: Nodes of a bucket up to which every two are compared by themselves, and nodes of a block.
SMALL, BLOCK = 16, 256

#: Shingles that a block's matrices have at once.
COLUMNS = 4096

_TABLE_BITS = 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.uint64(0xD6E8FEB86659FD93)


def shingle_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (text number, shingle hash) of a block's texts, and how often each shingle occurs in its text.

    Words are runs of non-blank characters, ASCII letters in lower case. A text of
    fewer than five words has one shingle, of all its words; one of none has none.
    """
    data = _LOWER[data]
    starts, stops = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = mixed(stretch_hashes(data, starts, stops) + (stops - starts).astype(np.uint64))
    owner = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(starts, offsets)
    last = first[owner + 1]
    at = np.arange(len(starts))
    hashed = np.zeros(len(starts), np.uint64)
    for k in range(SHINGLE):
        there = at + k < last
        hashed = np.where(there, hashed * _WORD + word[np.minimum(at + k, len(word) - 1)], hashed)
    whole = (at + SHINGLE <= last) | (at == first[owner])  # the latter: a short text's only shingle
    keys = np.sort((owner[whole].astype(np.uint64) << HASH_BITS) | (mixed(hashed[whole]) >> (np.uint64(64) - HASH_BITS)))
    new = np.append(True, keys[1:] != keys[:-1])
    return keys[new], np.diff(np.append(np.flatnonzero(new), len(keys)))


def _sketch_slots(shingles: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for row in range(SKETCH_ROWS):
        yield row, (mixed(shingles ^ np.uint64(row + 1 << 56)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _hash_of(keys: np.ndarray) -> np.ndarray:
    return keys & ((np.uint64(1) << HASH_BITS) - np.uint64(1))


def _sketching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_keeps("sketch", dict)
    counts, n = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64), 0
    for block in blocks(batches):
        shingles = _hash_of(shingle_keys(block.data, block.offsets)[0])
        for row, slots in _sketch_slots(shingles):
            counts[row] += np.bincount(slots, minlength=1 << SKETCH_BITS)
        n += block.rows.num_rows
    if n:
        for k, part in enumerate(np.split(counts, SLICES, axis=1)):
            yield _slice_row(k, n, part)


_SLICE = "slice int, n bigint, counts binary"


def _slice_row(k: int, n: int, counts: np.ndarray) -> pa.RecordBatch:
    import zstandard

    return pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "n": [n], "counts": [zstandard.compress(counts.tobytes(), 1)]})


def _slice_counts(packed: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(packed), np.int64).reshape(SKETCH_ROWS, -1)


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for k, n, packed in zip(*(batch.column(c).to_pylist() for c in ("slice", "n", "counts")), strict=True):
            more, counts = sums.get(k, (0, 0))
            sums[k] = more + n, counts + _slice_counts(packed)
    for k, (n, counts) in sums.items():
        yield _slice_row(k, n, counts)


class Weights:
    """Shingle weights from the document frequencies in a sketch."""

    def __init__(self, counts: np.ndarray, n_docs: int):
        least = max(1.0, counts[0].sum() / counts.shape[1])  # a frequency below this cannot be told from it
        spread = math.log(max(n_docs / least, 2.0))
        common = np.log(np.maximum(n_docs, 1) / np.maximum(counts, least)) / spread
        self.idf = np.clip(LEAST_IDF + (1 - LEAST_IDF) * common, LEAST_IDF, 1).astype(np.float32)

    def of(self, shingles: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """tf * idf; the sketch's least count is nearest the truth, so the greatest idf counts."""
        idf = np.zeros(len(shingles), np.float32)
        for row, slots in _sketch_slots(shingles):
            np.maximum(idf, self.idf[row][slots], out=idf)
        return tf.astype(np.float32) * idf


def weights_of(docs: DataFrame) -> Weights:
    """Weights over all distinct texts of documents (text, digest); the driver gets one sketch of fixed size."""
    sketched = docs.select("digest", "text").dropDuplicates(["digest"]).select("text").mapInArrow(_sketching, _SLICE)
    counts, n = np.zeros((SKETCH_ROWS, SLICES, (1 << SKETCH_BITS) // SLICES), np.int64), 0
    for r in sketched.repartition("slice").mapInArrow(_merging, _SLICE).collect():
        counts[:, r.slice] += _slice_counts(bytes(r.counts))
        n = max(n, r.n)
    return Weights(counts.reshape(SKETCH_ROWS, -1), n)


class Sampler:
    """Improved consistent weighted sampling with ``n`` hash functions.

    The random numbers r, c and beta of a shingle come from tables at its hashed slot,
    the same in every task. Of ln a = ln c - r (t - beta + 1), t = floor(ln w / r + beta),
    the smallest is the sample; its bits and the shingle's stand for (shingle, t).
    """

    def __init__(self, n: int = BANDS * ROWS, seed: int = 7):
        rng, size = np.random.default_rng(seed), 1 << _TABLE_BITS
        self.r = rng.gamma(2, 1, (n, size)).astype(np.float32) + np.float32(1e-6)
        self.ln_c = np.log(rng.gamma(2, 1, (n, size))).astype(np.float32)
        self.beta = rng.random((n, size), np.float32)
        self.odd = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of samples for each run of shingles that begins at ``starts``."""
        log_w, low = np.log(weights), shingles & np.uint64(0xFFFFFFFF)
        out = np.empty((len(starts), len(self.odd)), np.uint64)
        for h, odd in enumerate(self.odd):
            slot = ((shingles * odd) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
            r, beta = self.r[h][slot], self.beta[h][slot]
            ln_a = self.ln_c[h][slot] - r * (np.floor(log_w / r + beta) - beta + np.float32(1))
            bits = ln_a.view(np.uint32)
            bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))  # in the order of the floats
            out[:, h] = np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | low, starts)
        return out


def _sampler() -> Sampler:
    return worker_keeps("sampler", Sampler)


def _signing(weights: Weights) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler()
        for block in blocks(batches, limit=2 << 20):
            keys, tf = shingle_keys(block.data, block.offsets)
            shingles, text = _hash_of(keys), (keys >> HASH_BITS).astype(np.int64)
            bands = [None] * block.rows.num_rows
            if len(keys):
                starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                samples = sampler.samples(shingles, weights.of(shingles, tf), starts)
                hashed = np.zeros((len(starts), BANDS), np.uint64)
                for k in range(ROWS):
                    hashed = mixed(hashed * _WORD + samples[:, k::ROWS])
                for t, row in zip(text[starts].tolist(), hashed.view(np.int64).tolist(), strict=True):
                    bands[t] = row
            columns = [block.rows.column("doc_id"), block.rows.column("digest"), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "bands"])

    return sign


def _pairs(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that both sides' texts have at most ``limit`` bytes, or are a single pair."""
    total = flat(batch.column("a_text"))[1] + flat(batch.column("b_text"))[1]
    first = 0
    while first < batch.num_rows:
        stop = max(first + 1, int(np.searchsorted(total, total[first] + limit, "right")) - 1)
        stop = min(stop, first + BLOCK_ROWS)
        yield batch.slice(first, stop - first)
        first = stop


def _comparing(weights: Weights) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pairs(batch, 4 << 20):
                rows, sides = Block(part, *flat(part.column("a_text"))), []
                for block in (rows, Block(part, *flat(part.column("b_text")))):
                    keys, tf = shingle_keys(block.data, block.offsets)
                    sides.append((keys, weights.of(_hash_of(keys), tf), tf))
                (a, *of_a), (b, *of_b) = sides
                _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                n = rows.rows.num_rows
                pair = lambda k: (k >> HASH_BITS).astype(np.int64)
                similarity = np.zeros(n)
                for wa, wb in zip(of_a, of_b, strict=True):  # weighted and plain
                    shared = np.bincount(pair(a[at_a]), np.minimum(wa[at_a], wb[at_b]), n)
                    total = np.bincount(pair(a), wa, n) + np.bincount(pair(b), wb, n) - shared
                    np.maximum(similarity, shared / np.maximum(total, 1e-12), out=similarity)
                yield pa.RecordBatch.from_arrays([rows.rows.column("a"), rows.rows.column("b"), pa.array(similarity)], names=["a", "b", "similarity"])

    return compare


def _features(texts: pa.Array, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature and weight; the k-th occurrence of a shingle is a feature, so that shared ones add up to the least tf."""
    keys, tf = shingle_keys(*flat(texts))
    each = np.repeat(np.arange(len(keys)), tf)
    nth = np.arange(len(each)) - np.repeat(np.cumsum(tf) - tf, tf)
    shingles = _hash_of(keys)
    one = weights.of(shingles, np.ones(len(keys), np.int64)).astype(np.float64)
    return (keys >> HASH_BITS).astype(np.int64)[each], mixed(shingles[each] + (nth.astype(np.uint64) << HASH_BITS)), one[each]


def _joining(weights: Weights, similarity: float) -> Callable[[pa.Table], pa.Table]:
    """Compares the drawn nodes of a block with its others; gives a and b, each node linked in it and the first of those it is connected to."""

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_drawn = table.column("drawn").to_numpy(zero_copy_only=False).astype(bool)
        node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
        text, feature, weight = _features(pa.concat_arrays(table.column("text").chunks) if table.num_rows else pa.array([], pa.string()), weights)
        totals = [np.bincount(text, weight, len(node)), np.bincount(text, minlength=len(node))]
        kinds, number, count = np.unique(feature, return_inverse=True, return_counts=True)
        shared = count[number] > 1
        text, number, weight = text[shared], number[shared], weight[shared]
        column = np.cumsum(count > 1) - 1
        number = column[number]
        order = np.argsort(number, kind="stable")
        text, number, weight = text[order], number[order], weight[order]
        rows_d, rows_m = np.flatnonzero(is_drawn), np.flatnonzero(~is_drawn)
        place = np.empty(len(node), np.int64)
        place[rows_d], place[rows_m] = np.arange(len(rows_d)), np.arange(len(rows_m))
        weighted = np.zeros((len(rows_d), len(rows_m)))
        plain = weighted.copy() if (weight != 1).any() else weighted
        last = int(number[-1]) + 1 if len(number) else 0
        for begin in range(0, last, COLUMNS):
            part = slice(*np.searchsorted(number, [begin, begin + COLUMNS]))
            own, col, w = text[part], number[part] - begin, weight[part]
            d, m = np.zeros((len(rows_d), COLUMNS)), np.zeros((len(rows_m), COLUMNS))
            in_d = is_drawn[own]
            d[place[own[in_d]], col[in_d]] = w[in_d]
            m[place[own[~in_d]], col[~in_d]] = 1
            weighted += d @ m.T
            if plain is not weighted:
                plain += (d > 0).astype(np.float64) @ m.T
        similar = np.zeros(weighted.shape, bool)
        for both, total in zip((weighted, plain), totals, strict=True):
            similar |= both / np.maximum(total[rows_d][:, None] + total[rows_m][None, :] - both, 1e-12) >= similarity - 1e-9
        similar &= (label[rows_d][:, None] != label[rows_m][None, :]) & (node[rows_d][:, None] != node[rows_m][None, :])
        if not similar.any():
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
        none = np.iinfo(np.int64).max
        up_d, up_m = node[rows_d].copy(), node[rows_m].copy()
        while True:  # the smallest node of each component inside the block
            next_m = np.minimum(up_m, np.where(similar, up_d[:, None], none).min(axis=0))
            next_d = np.minimum(up_d, np.where(similar, next_m[None, :], none).min(axis=1))
            if (next_m == up_m).all() and (next_d == up_d).all():
                break
            up_d, up_m = next_d, next_m
        a, b = np.concatenate([node[rows_d], node[rows_m]]), np.concatenate([up_d, up_m])
        return pa.Table.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    return join


def _nodes(signed: DataFrame, salts: int) -> DataFrame:
    """Distinct texts: digest, node, id of the first document, number of copies, bands, and the salts of its rows."""
    once = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))
    grouped = signed.groupBy("digest").agg(F.min(once).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.collect_set("salt").alias("salts"))
    return stored(grouped.select("digest", F.monotonically_increasing_id().alias("node"), F.col("first.doc_id").alias("first_id"), "copies", "bands", "salts"), "nodes")


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, salts: int = 64) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, digest (of its text) and label (its class's number).

    A class is a component of links between texts whose weighted or plain Jaccard
    similarity is ``similarity`` or more, and class_id the smallest document id in it. Equal texts are always
    in one class, those without words too; a null text counts as empty. A null id
    gives way to any other as class_id. Repeated rows each get their row; no rows
    give no rows. Texts are compared whole. Only the two columns are read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"), _digest(text_col).alias("digest"))
    weights = weights_of(rows)
    signed = stored(rows.mapInArrow(_signing(weights), "doc_id bigint, digest binary, bands array<bigint>"), "signed").withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(salts)))
    nodes = _nodes(signed, salts)

    banded = nodes.where("bands IS NOT NULL").select("node", F.posexplode("bands").alias("band", "hash")).withColumn("node_salt", F.pmod(F.hash("node"), F.lit(salts)))
    buckets = banded.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("size"), F.collect_set("node_salt").alias("salts")).where("size > 1")
    spread = buckets.select("band", "hash", "size", F.explode("salts").alias("node_salt"))
    # a node's place among its bucket's, a number from 0 to the bucket's size that is dealt by hash
    dealt = (F.pmod(F.xxhash64("node", "band", "hash"), F.lit(1 << 40)) / F.lit(float(1 << 40))) * F.col("size")
    members = stored(banded.join(spread, ["band", "hash", "node_salt"]).select(F.xxhash64("band", "hash").alias("bucket"), "node", "size", dealt.alias("place")), "members")
    texts = _texts(rows, nodes, members)

    small = members.where(F.col("size") <= SMALL)
    other = small.select("bucket", F.col("node").alias("other"))
    pairs = small.join(other, "bucket").where("node < other").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    links = stored(_compare(pairs, texts, weights), "compared").where(F.col("similarity") >= similarity - 1e-9).select("a", "b")

    large = members.where(F.col("size") > SMALL)
    for step in ("drawn", "apart"):
        labels = components(links)
        placed = stored(large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "placed")
        counted = placed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
        mixed_up = stored(counted.where((F.col("most") < F.col("all")) & (F.col("all") > (0 if step == "drawn" else BLOCK))), "mixed-buckets")
        if mixed_up.isEmpty():
            break
        blocks_of = placed.join(mixed_up, "bucket")
        across = F.ceil(F.col("all") / BLOCK)
        if step == "drawn":
            chosen, down = F.col("place") < BLOCK, F.lit(1).cast("bigint")
        else:
            chosen, down = F.col("label") != F.col("main"), F.ceil((F.col("all") - F.col("most")) / BLOCK)
        share = F.col("place") / F.col("size")
        at = lambda n: F.least(F.floor(share * n), n - 1)
        drawn = blocks_of.where(chosen).select("bucket", at(down).alias("y"), F.explode(F.sequence(F.lit(0).cast("bigint"), across - 1)).alias("x"), "node", "label", F.lit(True).alias("drawn"))
        others = blocks_of.select("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), down - 1)).alias("y"), at(across).alias("x"), "node", "label", F.lit(False).alias("drawn"))
        dealt_out = drawn.unionByName(others).join(texts, "node")
        found = dealt_out.groupBy("bucket", "y", "x").applyInArrow(_joining(weights, similarity), "a bigint, b bigint")
        links = links.unionByName(stored(found, "joined"))
    labels = components(links)

    classed = stored(nodes.select("digest", "node", "first_id", "copies", "salts").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "classed")
    whole = classed.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"), F.collect_set(F.pmod(F.hash("node"), F.lit(salts))).alias("label_salts"))
    shared = whole.select("label", "class_id", "class_size", F.explode("label_salts").alias("label_salt"))
    by_text = classed.withColumn("label_salt", F.pmod(F.hash("node"), F.lit(salts))).join(shared, ["label", "label_salt"])
    verdict = by_text.select("digest", "label", F.explode("salts").alias("salt"), "class_id", "class_size")
    return signed.join(verdict, ["digest", "salt"]).select("doc_id", "class_id", "class_size", "digest", "label")


def _texts(rows: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """node and text of the nodes that have company in a bucket; only one document of each stays after the join."""
    asked = nodes.join(members.select("node").distinct(), "node").select("first_id", F.col("digest").alias("wanted"), "node")
    near = rows.join(asked, rows["doc_id"].eqNullSafe(asked["first_id"]) & (rows["digest"] == asked["wanted"]))
    return stored(near.select("node", "text").dropDuplicates(["node"]), "texts")


def _compare(pairs: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """a, b and similarity, the greater of weighted and plain, for pairs of nodes."""
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    two = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    return two.select("a", "b", "a_text", "b_text").mapInArrow(_comparing(weights), "a bigint, b bigint, similarity double")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each class the one with the smallest id stays, with all its columns, whatever their names.

    A null id gives way to any other; among rows with the same id in a class, the
    smallest digest of the text decides, and of wholly equal ones one stays. A null
    text counts as empty. No rows give no rows. The documents themselves are shuffled
    once, to meet the ids and digests of those that stay.
    """
    alike = near_duplicates(docs, id_col, text_col).groupBy("label", F.col("doc_id").alias("id"), "digest").agg(F.count(F.lit(1)).alias("n"))
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "n")).alias("one")
    chosen = stored(alike.groupBy("label").agg(one).select("one.id", "one.digest", "one.n"), "kept-rows")
    return matching_rows(docs, {"id": F.col(f"`{id_col}`").cast("bigint"), "digest": _digest(text_col)}, chosen)
