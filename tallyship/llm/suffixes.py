"""Removal of byte strings that also stand in an earlier document, by suffix arrays.

Strings of 50 bytes that occur in two texts have the same minimizer: the hash of 20
bytes in them that is smallest. So texts only need to be compared around minimizers
that two different texts share.

1. Every text's minimizers go to buckets by hash; a bucket tells which are shared.
   Minimizers that a task has in two texts already count as shared there, so a common
   one costs a row per task, not one per document. What a bucket tells goes to groups
   of texts, one row for each, and not to every text by itself.
2. Texts with shared minimizers give pieces: the bytes of all windows that have the
   minimizer. Where one occurs in so many texts that its pieces could crowd a task,
   every window is a piece by itself. Before they are shuffled, equal pieces of a block
   become one string with its smallest and its greatest document, and so again on arrival.
3. The pieces of a minimizer meet in a shard. The shard's suffix array is made by induced
   sorting over all of them with their documents, and permuted common prefixes tell which
   windows are equal, and so the smallest document of each. Every window that is removed
   is found there; what stays out is strings of one document that agree with no other
   string of the shard in the 35 bytes beside a minimizer, as no other has their windows.
4. Windows of later documents are removed from their texts, overlapping ones together.

Equal texts are found by digest; only the first goes through these steps, and the others
lose all their windows as whole copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyship.llm.blocks import blocks, flat, mixed, prefix, stretch_hashes, strings
from tallyship.llm.induced import repeated_windows
from tallyship.llm.shared import discard, release, sha256_hex, shared_dir, stored, text_or_empty

#: Bytes of a string, of what is hashed in it, and places of the hashed stretch in a string.
WIDTH, STRETCH = 50, 20
SPREAD = WIDTH - STRETCH + 1

#: A minimizer and the bytes on one side of it that any window has.
FLANK = STRETCH + (WIDTH - STRETCH) // 2

#: A minimizer of more texts than this, and than this share of all texts, has its windows dealt one by one.
CROWD, CROWD_SHARE = 4000, 1e-4

#: Minimizers of crowds at most, which every task gets: their texts are so many that no more can be.
MOST_CROWDS = 1 << 20

#: Keys over which the places of a crowd's piece are spread.
SALTS = 60

#: Bytes of text of which a task holds the minimizers at once, and aims for a bucket and a shard (whose arrays then fit a core's share of the caches).
UNIT_BYTES, BUCKET_BYTES, SHARD_BYTES = 24 << 20, 4 << 20, 2 << 20

#: Places that are hashed and folded at once, so that what the many passes over them make stays in a core's cache.
PART = 1 << 16

_LAST = 2**63 - 1  # stands for a null document id, after all others


def _slid(x: np.ndarray, fold: Callable) -> np.ndarray:
    """fold over SPREAD neighbours from each place on."""
    out = np.empty(len(x) - SPREAD + 1, x.dtype)
    for at in range(0, len(out), PART):
        part, width = x[at : at + PART + SPREAD - 1], 1
        while width * 2 <= SPREAD:
            part = fold(part[:-width], part[width:])
            width *= 2
        rest = SPREAD - width
        out[at : at + PART] = fold(part[: len(part) - rest], part[rest:]) if rest else part
    return out


def _hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the STRETCH bytes from each place on, never 0."""
    out = np.empty(len(data) - STRETCH + 1, np.uint64)
    for at in range(0, len(out), PART):
        n = min(PART, len(out) - at)
        out[at : at + n] = mixed(stretch_hashes(data[at : at + n + STRETCH - 1], slice(0, n), slice(STRETCH, n + STRETCH)))
    return out


def minimizers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the texts' minimizers, the hash at every place, and for every window of WIDTH bytes its smallest (0: no window)."""
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hashed = _hashes(data) | np.uint64(1)
    least = _slid(hashed, np.minimum)
    edge = np.zeros(n + 1, np.int64)
    long = np.diff(offsets) >= WIDTH
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - WIDTH + 1, -1)
    least[np.cumsum(edge)[: len(least)] == 0] = 0
    pad = np.zeros(SPREAD - 1, np.uint64)
    most = _slid(np.concatenate([pad, least, pad]), np.maximum)  # over the windows that hold a place
    return np.flatnonzero(most == hashed), hashed, least


def _dealt(hashed: np.ndarray) -> np.ndarray:
    """Keys by which minimizers are dealt: as hashes they are the smallest of many, most of them in the lowest buckets."""
    return mixed(hashed) | np.uint64(1)


def _letters(text: np.ndarray, hashed: np.ndarray, shift: int) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """Hashes for texts, packed by group of texts: the groups, their texts with the number of hashes of each, and the hashes."""
    by = np.argsort(text, kind="stable")
    text, hashed = text[by], hashed[by]
    begin = np.flatnonzero(np.append(True, text[1:] != text[:-1])[: len(text)])
    whose, count = text[begin], np.diff(np.append(begin, len(text)))
    group = (whose.view(np.uint64) >> np.uint64(shift)).astype(np.int64)
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
    if not len(cut):
        return group, [], []
    heads = [np.stack(x).tobytes() for x in zip(np.split(whose, cut[1:]), np.split(count, cut[1:]), strict=True)]
    return group[cut], heads, [x.tobytes() for x in np.split(hashed, begin[cut[1:]])]


def _group_shift(bits: int) -> int:
    """Bits of a text's number below those of its group; an eighth as many groups as buckets, since few minimizers are shared."""
    return 64 - max(5, bits - 3)


def _telling(table: pa.Table) -> pa.Table:
    """In a group of texts: each text's shared minimizers together."""
    heads = [np.frombuffer(x, np.int64).reshape(2, -1) for x in table.column("heads").to_pylist()]
    whose, count = np.concatenate(heads, axis=1)
    text, hashed = np.repeat(whose, count), np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)
    by = np.argsort(text, kind="stable")
    text, hashed = text[by], hashed[by]
    begin = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    return pa.Table.from_arrays([pa.array(text[begin]), pa.array([x.tobytes() for x in np.split(hashed, begin[1:])], pa.binary())], names=["text_id", "hashes"])


def _gathering(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    shift = np.uint64(64 - bits)

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        hashed, text = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((text, hashed))
        hashed, text = hashed[order], text[order]
        new = np.append(True, (hashed[1:] != hashed[:-1]) | (text[1:] != text[:-1]))
        hashed, text = hashed[new], text[new]
        first = np.append(True, hashed[1:] != hashed[:-1])
        count = np.diff(np.append(np.flatnonzero(first), len(hashed)))
        many = np.repeat(count > 1, count)
        if many.any():  # shared within the task: told to the texts at once
            group, heads, lists = _letters(text[many], hashed[many], _group_shift(bits))
            yield _rows(["bucket", "heads", "hashes"], -1 - group, heads, lists)
        one, group = ~many, count > 1
        multi, times = hashed[first][group], count[group]
        single, owner = hashed[one], text[one]
        edges = np.searchsorted(single >> shift, np.arange((1 << bits) + 1).astype(np.uint64))
        shared = np.searchsorted(multi >> shift, np.arange((1 << bits) + 1).astype(np.uint64))
        packs = []
        for b in range(1 << bits):
            s, m = slice(edges[b], edges[b + 1]), slice(shared[b], shared[b + 1])
            low = (single[s] << np.uint64(bits)) >> np.uint64(24)  # 40 bits below the bucket's own
            mine = np.concatenate([low.view(np.uint8).reshape(-1, 8)[:, :5], owner[s].view(np.uint8).reshape(-1, 8)], axis=1)
            known = np.concatenate([((multi[m] << np.uint64(bits)) >> np.uint64(24)), times[m].astype(np.uint64)])
            packs.append((mine.tobytes(), known.tobytes()))
        yield _rows(["bucket", "heads", "hashes"], np.arange(len(packs)), [b for _, b in packs], [a for a, _ in packs])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[bytes] = set()
        n = 0
        for block in blocks(batches, limit=2 << 20):
            at, hashed, _ = minimizers(block.data, block.offsets)
            own = block.rows.column("text_id").to_numpy()
            fresh = np.array([not (d in seen or seen.add(d)) for d in block.rows.column("digest").to_pylist()], bool)
            row = np.searchsorted(block.offsets, at, "right") - 1
            at, row = at[fresh[row]], row[fresh[row]]
            held.append((_dealt(hashed[at]), own[row]))
            n += len(block.data)
            if n > UNIT_BYTES:
                yield from flush(held)
                held, seen, n = [], set(), 0
        if any(len(x) for x, _ in held):
            yield from flush(held)

    return gather


def _rows(names: list[str], to: np.ndarray, heads: list[bytes], hashes: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(heads, pa.binary()), pa.array(hashes, pa.binary())], names=names)


def _meeting(bits: int, crowd: int) -> Callable[[pa.Table], pa.Table]:
    """In a bucket: shared minimizers for groups of texts, and those of a crowd of texts (group -1). What is known already passes."""

    def meet(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return pa.Table.from_arrays([pc.subtract(-1, table.column("bucket")), table.column("heads"), table.column("hashes")], names=["group", "heads", "hashes"])
        bucket = np.uint64(table.column("bucket")[0].as_py())
        mine = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint8).reshape(-1, 13)
        wide = np.zeros((2, len(mine), 8), np.uint8)
        wide[0, :, :5], wide[1] = mine[:, :5], mine[:, 5:]
        low, text = wide.view(np.uint64)[0, :, 0], wide.view(np.int64)[1, :, 0]
        known = [np.frombuffer(x, np.uint64) for x in table.column("heads").to_pylist()]
        known_low = np.concatenate([x[: len(x) // 2] for x in known])
        times = np.concatenate([x[len(x) // 2 :] for x in known]).astype(np.int64)
        order = np.lexsort((text, low))
        low, text = low[order], text[order]
        new = np.append(True, (low[1:] != low[:-1]) | (text[1:] != text[:-1]))[: len(low)]
        low, text = low[new], text[new]
        every, which = np.unique(np.concatenate([low, known_low]), return_inverse=True)
        total = np.bincount(which[: len(low)], minlength=len(every)) + np.bincount(which[len(low) :], times, len(every)).astype(np.int64)
        shared = total[which[: len(low)]] > 1
        whole = lambda x: (bucket << np.uint64(64 - bits)) | ((x << np.uint64(24)) >> np.uint64(bits)) | np.uint64(1)
        hot = whole(every[total > crowd])
        group, heads, lists = _letters(text[shared], whole(low[shared]), _group_shift(bits))
        return pa.Table.from_batches([_rows(["group", "heads", "hashes"], np.append(group, -1), [*heads, b""], [*lists, hot.tobytes()])])

    return meet


def _same_bits(bits: int) -> np.uint64:
    """The bits of a hash that buckets keep: their own, the 40 below, and the last one, which is always set."""
    kept = min(bits + 40, 64)
    return np.uint64((((1 << kept) - 1) << (64 - kept)) | 1)


def _pieces(block, bits: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, start, length and minimizer of the pieces of a block of texts with their shared minimizers, and which are of a crowd."""
    at, hashed, least = minimizers(block.data, block.offsets)
    row = np.searchsorted(block.offsets, at, "right") - 1
    key = _dealt(hashed[at]) & _same_bits(bits)
    octets, bounds = flat(block.rows.column("hashes"))
    own = mixed(np.arange(block.rows.num_rows))  # sets a text's hashes apart from the others'; one too many would only give a piece more
    told = np.sort((octets.view(np.uint64) & _same_bits(bits)) ^ np.repeat(own, np.diff(bounds) // 8))
    asked = np.append(told, np.uint64(0))[np.searchsorted(told, key ^ own[row])] == key ^ own[row]
    at, row, key = at[asked], row[asked], key[asked]
    padded = np.concatenate([np.zeros(SPREAD - 1, np.uint64), least, np.zeros(SPREAD, np.uint64)])
    has = np.lib.stride_tricks.sliding_window_view(padded, SPREAD)[at] == hashed[at][:, None]  # windows from at - SPREAD + 1 to at
    crowded = np.isin(key, hot & _same_bits(bits))
    calm = ~crowded
    first = at[calm] - SPREAD + 1 + np.argmax(has[calm], axis=1)
    last = at[calm] - np.argmax(has[calm][:, ::-1], axis=1)
    which, shift = np.nonzero(has[crowded])
    single = at[crowded][which] - SPREAD + 1 + shift
    start = np.concatenate([first, single])
    length = np.concatenate([last - first + WIDTH, np.full(len(single), WIDTH)])
    rows = np.concatenate([row[calm], row[crowded][which]])
    keys = np.concatenate([key[calm], mixed(stretch_hashes(block.data, single, single + WIDTH))])  # a crowd's windows spread by their content
    return rows, start, length, keys, np.arange(len(rows)) >= len(first)


def _piece_ids(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, as two integers, that stand for a piece."""
    return tuple(mixed(stretch_hashes(data, starts, stops, kind) + (stops - starts).astype(np.uint64)).view(np.int64) for kind in (0, 1))


def _emitting(bits: int, hot: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Where every piece stands in its text; of equal pieces of a block the first row has the bytes, the least and greatest document, and the salts.

    Pieces of a crowd are spread over ``SALTS`` salts by their document; ``salts`` has a bit for each.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=2 << 20):
            row, start, length, key, crowded = _pieces(block, bits, hot)
            if not len(row):
                continue
            ord_ = block.rows.column("ord").to_numpy()[row]
            salt = np.where(crowded, (mixed(ord_.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64), 0)
            id_a, id_b = _piece_ids(block.data, start, start + length)
            order = np.lexsort((id_b, id_a))
            new = np.append(True, (id_a[order][1:] != id_a[order][:-1]) | (id_b[order][1:] != id_b[order][:-1]))
            begin = np.flatnonzero(new)
            first = order[begin]
            place = np.full(len(row), -1, np.int64)
            place[first] = np.arange(len(first))
            sizes = prefix(length[first])
            octets = block.data[np.repeat(start[first] - sizes[:-1], length[first]) + np.arange(sizes[-1])]
            at = pa.array(place, mask=place < 0)
            only = lambda x: pa.array(x).take(at)
            columns = {
                "id_a": pa.array(id_a), "id_b": pa.array(id_b), "salt": pa.array(salt), "ord": pa.array(ord_), "text_id": pa.array(block.rows.column("text_id").to_numpy()[row]),
                "place": pa.array(start - block.offsets[row]), "piece": strings(octets, sizes).cast(pa.binary()).take(at), "key": pa.array(key.view(np.int64)),
                "low": only(np.minimum.reduceat(ord_[order], begin)), "high": only(np.maximum.reduceat(ord_[order], begin)),
                "salts": only(np.bitwise_or.reduceat(np.int64(1) << salt[order], begin)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return emit


_EMITTED = "id_a bigint, id_b bigint, salt bigint, ord bigint, text_id bigint, place bigint, piece binary, key bigint, low bigint, high bigint, salts bigint"
_RUNS = "id_a bigint, id_b bigint, salts bigint, from bigint, to bigint, first_ord bigint"


def _meet_others(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which pieces agree with another one in FLANK bytes that begin or end with their minimizer.

    The minimizer of a window has 30 other bytes of the window beside it, so 15 at least
    on one side: two pieces with a window in common agree in such bytes. A piece's
    minimizer is the smallest of its hashes; every place that has it counts.
    """
    n = len(data) - STRETCH + 1
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    hashed = _hashes(data)
    hashed[np.arange(n) + STRETCH > offsets[1:][owner[:n]]] = np.iinfo(np.uint64).max  # would reach into the next piece
    place = np.flatnonzero(hashed == np.minimum.reduceat(hashed, offsets[:-1])[owner[:n]])
    whose = owner[place]
    ends, begins = place + STRETCH - FLANK >= offsets[whose], place + FLANK <= offsets[whose + 1]
    flanks = np.concatenate([
        mixed(stretch_hashes(data, place[ends] + STRETCH - FLANK, place[ends] + STRETCH)),
        ~mixed(stretch_hashes(data, place[begins], place[begins] + FLANK)),
    ])
    _, which, count = np.unique(flanks, return_inverse=True, return_counts=True)
    meets = np.zeros(len(offsets) - 1, bool)
    meets[np.concatenate([whose[ends], whose[begins]])[count[which] > 1]] = True
    return meets


def _sorting(table: pa.Table) -> pa.Table:
    """In a shard: runs of windows of a piece that stand in an earlier document than the piece's last."""
    low, high, salts = (table.column(c).to_numpy() for c in ("low", "high", "salts"))
    piece = table.column("piece").combine_chunks()
    sorted_in = np.flatnonzero((low < high) | _meet_others(*flat(piece)))
    low, high, salts = low[sorted_in], high[sorted_in], salts[sorted_in]
    data, offsets = flat(piece.take(pa.array(sorted_in)))
    counts = np.maximum(np.diff(offsets) - WIDTH + 1, 0)
    owner = np.repeat(np.arange(len(sorted_in)), counts)
    offset, group = repeated_windows(data, offsets, WIDTH)
    least = np.full(int(group.max(initial=-1)) + 1, _LAST)
    np.minimum.at(least, group, low[owner])
    first_in = least[group]
    change = np.append(True, (owner[1:] != owner[:-1]) | (first_in[1:] != first_in[:-1]))[: len(owner)]
    begin = np.flatnonzero(change)
    stop = np.append(begin[1:], len(owner))[: len(begin)] - 1
    later = first_in[begin] < high[owner[begin]]
    begin, stop = begin[later], stop[later]
    whose = owner[begin]
    ids = _piece_ids(data, offsets[whose], offsets[whose + 1])
    return pa.Table.from_arrays([pa.array(x) for x in (*ids, salts[whose], offset[begin], offset[stop], first_in[begin])], names=["id_a", "id_b", "salts", "from", "to", "first_ord"])


def _removing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(iter([batch])):
            windows = block.rows.column("windows")
            text = np.repeat(np.arange(len(windows)), pc.list_value_length(windows).to_numpy(zero_copy_only=False))
            ends = windows.flatten()
            begin, stop = (ends.field(c).to_numpy() + block.offsets[text] for c in ("a", "b"))
            n = len(block.data)
            depth = np.bincount(begin, minlength=n + 1) - np.bincount(stop, minlength=n + 1)
            gone = np.cumsum(depth[:-1]) > 0
            edge = np.zeros(n + 1, bool)
            edge[block.offsets] = True
            fresh = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone[:-1])[:n]))
            left, at = block.data[~gone], block.offsets - prefix(gone)[block.offsets]
            kept = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            removed = np.diff(block.offsets) - np.diff(at)
            spans = np.diff(np.searchsorted(fresh, block.offsets))
            yield pa.RecordBatch.from_arrays([block.rows.column("ord"), block.rows.column("text_id"), pa.array(removed), pa.array(spans), pa.array(kept)], names=["ord", "text_id", "n_removed", "n_spans", "kept_sha256"])


def removed_windows(docs: DataFrame, salts: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For documents (doc_id, text): all rows with their digests; texts with shared minimizers; their windows to remove."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("ord"), "text", F.unhex(sha256_hex(F.col("text"))).alias("digest")).withColumn("text_id", F.xxhash64("digest"))
    rows = stored(keyed.select("doc_id", "ord", "digest", "text_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.pmod(F.hash("doc_id"), F.lit(salts)).alias("salt")), "texts")
    size = rows.agg(F.sum("n_bytes").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    total = size.n or 0
    bits = min(16, max(5, (total // 16 // BUCKET_BYTES * 11).bit_length()))
    # a text has no more minimizers than bytes over the least distance that two of equal hash may have, one
    crowd = max(CROWD, int(CROWD_SHARE * size.rows), total // MOST_CROWDS)

    met_at, pieces_at, whole_at = (shared_dir(spark, x) for x in ("met", "pieces", "distinct-pieces"))
    gathered = keyed.select("text_id", "digest", "text").mapInArrow(_gathering(bits), "bucket bigint, heads binary, hashes binary")
    met = stored(gathered.groupBy("bucket").applyInArrow(_meeting(bits, crowd), "group bigint, heads binary, hashes binary"), "met", met_at)
    release(spark)
    # more than total / MOST_CROWDS texts have each of them, so there are under MOST_CROWDS, 8 MB
    hot = np.frombuffer(b"".join(bytes(r.hashes) for r in met.where("group = -1 AND octet_length(hashes) > 0").select("hashes").collect()), np.uint64)
    told = met.where("group >= 0").groupBy("group").applyInArrow(lambda table: _telling(table), "text_id bigint, hashes binary")
    firsts = rows.groupBy("digest", "text_id").agg(F.min("ord").alias("first_ord")).withColumnRenamed("digest", "first_digest")
    asked = told.join(firsts, "text_id").select("first_digest", "first_ord", "hashes")
    near = keyed.join(asked, (keyed["ord"] == asked["first_ord"]) & (keyed["digest"] == asked["first_digest"]))
    texts = stored(near.select("ord", "digest", "text_id", "text", "hashes").dropDuplicates(["ord", "digest"]), "shared-texts")
    release(spark)
    discard(spark, met_at)

    emitted = stored(texts.mapInArrow(_emitting(bits, hot), _EMITTED), "pieces", pieces_at)
    release(spark)
    whole = stored(emitted.where("piece IS NOT NULL").groupBy("piece", "key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("salts").alias("salts")), "distinct-pieces", whole_at)
    release(spark)
    shards = max(16, int((emitted.agg(F.sum(F.octet_length("piece"))).first()[0] or 0) // SHARD_BYTES))
    sharded = whole.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    runs = stored(sharded.groupBy("shard").applyInArrow(lambda table: _sorting(table), _RUNS), "runs")
    release(spark)
    discard(spark, whole_at)
    salt = F.explode(F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")), lambda k: F.getbit("salts", k) == 1))
    told_to = runs.select("id_a", "id_b", "from", "to", "first_ord", salt.alias("salt"))  # where the piece's rows are, and nowhere else
    stand = emitted.select("id_a", "id_b", "salt", "ord", "text_id", "place").join(told_to, ["id_a", "id_b", "salt"]).where(F.col("ord") > F.col("first_ord"))
    spans = stand.select("ord", "text_id", (F.col("place") + F.col("from")).alias("a"), (F.col("place") + F.col("to") + WIDTH).alias("b"))
    windows = stored(spans.groupBy("ord", "text_id").agg(F.collect_list(F.struct("a", "b")).alias("windows")), "windows")
    release(spark)
    discard(spark, pieces_at)
    return rows, texts, windows


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A text is its UTF-8 bytes, of null none. A byte goes if a string of 50 bytes that
    covers it also starts in a document with a smaller id, whatever is removed there.
    A null id comes after all others. Documents with the same id do not count as
    earlier than one another. Texts of under 50 bytes stay whole; long ones are judged
    whole. Repeated rows each get their row; no rows give none. Only the two columns
    are read.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows, texts, windows = removed_windows(plain, salts)
    changed = texts.select("ord", "text_id", "text").join(windows, ["ord", "text_id"]).select("ord", "text_id", "text", "windows").mapInArrow(_removing, "ord bigint, text_id bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    copied = rows.groupBy("digest").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.collect_set("salt").alias("salts")).where("first_ord < last_ord")
    salted = copied.select("digest", F.explode("salts").alias("salt"), "first_ord")
    judged = rows.join(salted, ["digest", "salt"], "left").join(changed, ["ord", "text_id"], "left")
    copy = F.coalesce(F.col("ord") > F.col("first_ord"), F.lit(False)) & (F.col("n_bytes") >= WIDTH)
    zero = F.lit(0).cast("bigint")
    return judged.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("bigint")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copy, sha256_hex(F.lit(""))).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
