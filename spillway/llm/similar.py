"""Near-duplicate engine for documents and paragraphs: sketch, band, link through centres, verify, connect.

Sketch: fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017). In round i < t each element of a set is hashed to
one of t bins with a value; a bin keeps the least i + value. Rounds i >= t throw all elements into bin i - t, so each
bin fills for sure. A set stops after the round that fills its last bin, which for sets of t ln t elements is the first.

Bands aren't rows of a shuffle: a task deals out its pairs of a band and a key in packed blocks, one for each part of the
hash space, and such a part is sorted at once.

Linking never lists the pairs of a bucket. Each bucket's members are compared with its centre only (its least key).
Verified links give components; what stays in one bucket but in different components is compared in blocks: members that
aren't of the bucket's main component with each other, and with all of that component, first by sketch, then exactly. A link between different sets that share
a bucket is thus never lost, and a group of n copies costs n comparisons. Sets that are equal are one class from the
start, so copies cost nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Vocabulary, blocks, distinct, give_back, gram_hashes, mix, word_hashes

#: Members of a bucket that one task compares with as many others at a time.
CHUNK = 1024
#: Pairs that a block may give for each of its members; one with more is settled as a whole.
PAIRS_PER_MEMBER = 4
#: Keys that are broadcast, so that the others' rows aren't shuffled; beyond, a shuffled join.
BROADCAST_BYTES = 16 << 20
#: Text whose shingle sets a Python worker holds at once; with 8 MB a worker took 352 MB at most, with 1 MB 213.
BLOCK_BYTES = 1 << 20


@dataclass(frozen=True)
class Bands:
    """bands of rows coordinates each. A pair of similarity s shares a band with probability 1 - (1 - s**rows)**bands."""

    bands: int = 32
    rows: int = 4

    @property
    def size(self) -> int:
        return self.bands * self.rows


def sketch(shingles: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """One row of t coordinates (uint64) for each set shingles[offsets[k]:offsets[k + 1]]; no set may be empty."""
    n, free = len(offsets) - 1, np.iinfo(np.uint64).max
    out = np.full(n * t, free, np.uint64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    shingles, base = shingles[offsets[0] : offsets[-1]], row * t
    for i in range(2 * t):
        if not len(base):
            break
        with np.errstate(over="ignore"):
            h = mix(shingles + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        at = base + (h & np.uint64(0xFFFF)).astype(np.int64) % t if i < t else base + (i - t)
        if i:
            # a bin that an earlier round filled keeps its value, which is less
            new = np.flatnonzero(out[at] == free)
            at, h = at[new], h[new]
        np.minimum.at(out, at, (np.uint64(i) << np.uint64(48)) | (h >> np.uint64(16)))
        if i:
            at = np.sort(at)
            filled = at[np.concatenate((at[:1] == at[:1], at[1:] != at[:-1]))]
            left -= np.bincount(filled // t, minlength=n)
        else:
            left = (out.reshape(n, t) == free).sum(axis=1)
        going = left[row] > 0
        if not going.all():
            shingles, base, row = shingles[going], base[going], row[going]
    return out.reshape(n, t)


def band_keys(sketches: np.ndarray, bands: Bands) -> np.ndarray:
    """A 64-bit key for each band of each set; the band's number is part of it."""
    n = len(sketches)
    parts = sketches.reshape(n, bands.bands, bands.rows)
    with np.errstate(over="ignore"):
        key = mix(parts[:, :, 0] + np.arange(1, bands.bands + 1, dtype=np.uint64)[None, :])
        for k in range(1, bands.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits of a sorted set."""
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def shingle_sets(words: list[np.ndarray], n: int) -> list[np.ndarray]:
    """For each sequence of word hashes its sorted distinct hashes of n neighbours; of fewer words, the one hash of them
    all; of none, nothing. Hashes of neighbours are computed over all sequences at once and cut at their borders."""
    grams = gram_hashes(np.concatenate([np.empty(0, np.uint64), *words]), n)
    out, start = [], 0
    for w in words:
        if len(w) >= n:
            out.append(distinct(grams[start : start + len(w) - n + 1]))
        else:
            out.append(gram_hashes(w, len(w)) if len(w) else w)
        start += len(w)
    return out


def shingle_batches(batches, n: int, split, limit: int, keys: int = 1) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Blocks of keys with the shingle set of each text."""
    for ids, texts in blocks(batches, limit, keys):
        vocabulary = Vocabulary()
        seqs = [vocabulary.ids(split(text)) if text else np.empty(0, np.int32) for text in texts]
        hashes = word_hashes(vocabulary.words)
        yield ids, shingle_sets([hashes[s] for s in seqs], n)


def split_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; both are what bytes.lower and bytes.split do."""
    return text.lower().split()


SKETCH_TYPES = {"n_shingles": pa.int64(), "digest": pa.binary(), "keys": pa.list_(pa.int64()), "marks": pa.binary()}
SKETCH = "n_shingles bigint, digest binary, keys array<bigint>, marks binary"


def sketch_arrays(flat: np.ndarray, offsets: np.ndarray, bands: Bands, at_once: int = 512, digests: list[bytes] | None = None) -> list[pa.Array]:
    """n_shingles, digest, keys (one per band) and marks (one byte per coordinate) of sets flat[offsets[k]:offsets[k + 1]],
    none of them empty. Digests that are known needn't be taken again."""
    n = len(offsets) - 1
    keys, marks = np.empty((n, bands.bands), np.int64), np.empty((n, bands.size), np.uint8)
    for start in range(0, n, at_once):
        part = slice(start, min(n, start + at_once))
        cut = offsets[part.start : part.stop + 1]
        coordinates = sketch(flat[cut[0] : cut[-1]], cut - cut[0], bands.size)
        keys[part] = band_keys(coordinates, bands).view(np.int64)
        marks[part] = (mix(coordinates) & np.uint64(0xFF)).astype(np.uint8)
    if digests is None:
        digests = [set_digest(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    ends = lambda size: pa.py_buffer((np.arange(n + 1) * size).astype(np.int32))
    return [
        pa.array(np.diff(offsets), pa.int64()),
        pa.array(digests, pa.binary()),
        pa.Array.from_buffers(pa.list_(pa.int64()), n, [None, ends(bands.bands)], children=[pa.array(keys.reshape(-1))]),
        pa.Array.from_buffers(pa.binary(), n, [None, ends(bands.size), pa.py_buffer(marks)]),
    ]


def sketch_columns(sets: list[np.ndarray], bands: Bands) -> list[pa.Array]:
    """The arrays of sketch_arrays for all sets; n_shingles 0 and nulls for empty ones."""
    size = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(size)
    flat, offsets = np.concatenate([np.empty(0, np.uint64), *(sets[k] for k in some)]), np.concatenate(([0], np.cumsum(size[some])))
    at = np.full(len(sets), -1)
    at[some] = np.arange(len(some))
    place = pa.array(at, mask=at < 0)
    return [pa.array(size, pa.int64()), *(column.take(place) for column in sketch_arrays(flat, offsets, bands)[1:])]


def sketched(texts: DataFrame, bands: Bands, n: int, limit: int = BLOCK_BYTES) -> DataFrame:
    """key, tag and the sketch columns of each row of (key bigint, tag bigint, text). Map-only: text isn't shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in shingle_batches(batches, n, split_words, limit, 2):
            key, tag = zip(*ids, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(tag, pa.int64()), *sketch_columns(sets, bands)], ["key", "tag", *SKETCH_TYPES])

    return texts.mapInArrow(run, f"key bigint, tag bigint, {SKETCH}")


#: Links that one task connects; more are connected in rounds of shuffles.
LINKS = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys that are linked and the least key of each one's component."""
    keys, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    least, a, b = np.arange(len(keys)), at[: len(u)], at[len(u) :]
    while len(a):
        np.minimum.at(least, np.maximum(least[a], least[b]), np.minimum(least[a], least[b]))
        while not np.array_equal(least, further := least[least]):
            least = further
        apart = least[a] != least[b]
        a, b = a[apart], b[apart]
    return keys, keys[least]


def connect(scratch: Scratch, edges: DataFrame, name: str, rounds: int = 64, few: int = LINKS) -> DataFrame:
    """key, component (its least key) of every key in edges (a, b).

    A few links are connected by one task. More: alternates large-star and small-star (Kiveris et al. 2014): neighbours are linked to the least of a neighbourhood,
    until stars remain. Each round takes a minimum per key, which combines before the shuffle, and joins it back; a
    round's links are a table, so lineage stays short and no link is ever collected.
    """
    links = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    kept = f"{name}-0"
    if links.count() <= few:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.stack([b.column(k).to_numpy() for k in (0, 1)]) for b in batches]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in stars(*np.concatenate(held, axis=1))], ["key", "component"])

        return scratch.save(links.coalesce(1).mapInArrow(whole, "key bigint, component bigint"), f"{name}-1")
    for k in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = scratch.save(small, f"{name}-{k + 1}")
        state = now.agg(F.count("*").alias("n"), F.countDistinct("u").alias("us")).first()
        # stars: every key has one parent, and no parent is itself a child
        done = state["n"] == state["us"] and now.join(now.select(F.col("u").alias("x")), F.col("v") == F.col("x"), "left_semi").isEmpty()
        scratch.drop(kept)
        links, kept = now, f"{name}-{k + 1}"
        if done:
            return links.select(F.col("u").alias("key"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("key"), F.col("v").alias("component")).distinct())
    raise RuntimeError("components did not settle")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct arrays."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


#: Bits of a band that are compared: bands that are equal by chance give candidates, but no links. The others of 64 number
#: the pairs that a task deals out at once. And pairs of a bucket of bands, about; and bits of its number, at least.
BAND_BITS, BUCKET_PAIRS, BUCKET_BITS = 44, 1 << 19, 8


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binaries of the bytes of values, cut at the ends."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def unpacked(column: pa.Array, kind) -> np.ndarray:
    """The values of all binaries of a column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)


def shared_bands(reps: DataFrame, bands: Bands, bucket_pairs: int = BUCKET_PAIRS, least_bits: int = BUCKET_BITS) -> DataFrame:
    """band, key, centre (the least key of the band) of bands that several keys of reps (key, keys) have, each once."""
    bits = max(least_bits, (reps.count() * bands.bands // bucket_pairs).bit_length())
    places = 64 - BAND_BITS
    most = max(1, (1 << places) // bands.bands)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                if rows + part.num_rows > most:
                    yield dealt(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if held:
            yield dealt(held)
        give_back()

    def dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        key = np.concatenate([b.column(0).to_numpy() for b in held])
        band = np.concatenate([b.column(1).flatten().to_numpy() for b in held]).view(np.uint64)
        both = np.sort((band >> np.uint64(places) << np.uint64(places)) | np.arange(len(band), dtype=np.uint64))
        bucket = (both >> np.uint64(64 - bits)).astype(np.int32)
        begins = np.flatnonzero(np.concatenate((bucket[:1] == bucket[:1], bucket[1:] != bucket[:-1])))
        ends = np.append(begins, len(bucket))
        low = (both >> np.uint64(max(places, 32 - bits))).astype(np.uint32)
        mine = key[(both & np.uint64((1 << places) - 1)).astype(np.int64) // bands.bands]
        return pa.RecordBatch.from_arrays([pa.array(bucket[begins]), packed(low, ends), packed(mine, ends)], ["bucket", "low", "mine"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            borders = group_borders(batch, 1)
            for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                bucket = batch.column(0)[lo].as_py()
                if bucket != at and held:
                    yield from gathered(at, held)
                    held = []
                at = bucket
                part = batch.slice(lo, hi - lo)
                held.append((unpacked(part.column(1), np.uint32), unpacked(part.column(2), np.int64)))
        if held:
            yield from gathered(at, held)
        give_back()

    def gathered(bucket: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        low, key = (np.concatenate(c) for c in zip(*held, strict=True))
        both = np.sort((low.astype(np.uint64) << np.uint64(32)) | np.arange(len(low), dtype=np.uint64))
        same = (both[1:] ^ both[:-1]) >> np.uint64(32) == 0
        both = both[np.append(same, False) | np.append(False, same)]
        band, key = (both >> np.uint64(32)).astype(np.int64), key[(both & np.uint64((1 << 32) - 1)).astype(np.int64)]
        order = np.lexsort((key, band))
        band, key = band[order], key[order]
        new = np.append(True, band[1:] != band[:-1])[: len(band)]
        once = new | np.append(True, key[1:] != key[:-1])[: len(key)]
        band, key, new = band[once], key[once], new[once]
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(band)))
        centre, many = np.repeat(key[begins], sizes), np.repeat(sizes > 1, sizes)
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (np.int64(bucket << 32) | band, key, centre)], ["band", "key", "centre"])

    blocks_of = reps.select("key", "keys").mapInArrow(deal, "bucket int, low binary, mine binary")
    return blocks_of.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, "band bigint, key bigint, centre bigint")


#: Shingles that are looked up at once where a block is settled, unless one set has more.
LOOKED_UP = 1 << 20


def block_links(key: np.ndarray, component: np.ndarray, asks: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], least_equal: int, percent: int) -> list[tuple[int, int]]:
    """Verified links of a block, as ``near_links`` settles it. What one set has in common with others is counted for many
    of them at once, first for a few: a link may make the others needless."""
    out, size = [], np.array([len(s) for s in sets], np.int64)
    _, group = np.unique(component, return_inverse=True)
    known, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    begins, mine, tell = ends - size, np.zeros(len(known), bool), np.flatnonzero(~asks)
    for k in np.flatnonzero(asks):
        near = tell[(marks[tell] == marks[k]).sum(axis=1) >= least_equal]
        near = near[group[near] != group[k]]
        if not len(near):
            continue
        mine[shingle[begins[k] : ends[k]]] = True
        few = 8
        while len(near):
            fit = max(1, int(np.searchsorted(np.cumsum(size[near[:few]]), LOOKED_UP, "right")))
            some, near, few = near[:fit], near[fit:], 2 * few
            upto = np.cumsum(size[some])
            at = np.repeat(begins[some] - (upto - size[some]), size[some]) + np.arange(upto[-1])
            both = np.add.reduceat(mine[shingle[at]], upto - size[some], dtype=np.int64)
            for other in some[100 * both >= percent * (size[k] + size[some] - both)]:
                if group[other] != group[k]:
                    out.append((min(key[k], key[other]), max(key[k], key[other])))
                    group[group == group[other]] = group[k]
            near = near[group[near] != group[k]]
        mine[shingle[begins[k] : ends[k]]] = False
    return out


def near_links(scratch: Scratch, reps: DataFrame, sets_for: Callable[[DataFrame], DataFrame], bands: Bands, percent: int, crowd: int = PAIRS_PER_MEMBER) -> DataFrame:
    """a, b: verified links that connect all reps whose sets link through pairs that share a band.

    reps: key (bigint), n_shingles, keys, marks of each distinct non-empty set; rows that repeat a key are equal.
    sets_for gives, for a table of keys, key and shingles of their sets; it is asked for those with candidates only.
    """
    # of its coordinates, a pair at the threshold has ``percent`` in a hundred equal; five deviations fewer are let pass
    share = percent / 100
    least_equal = int(bands.size * share - 5 * (bands.size * share * (1 - share)) ** 0.5)
    members = scratch.save(shared_bands(reps, bands), "members")
    pairs = members.where("key <> centre").select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct()
    # a key that shares bands shares several as a rule: 20 and 32 are asked for
    shared, few = members.select("key").distinct(), members.count() * 4 <= BROADCAST_BYTES
    slim = reps.select("key", "n_shingles", "marks").join(F.broadcast(shared) if few else shared, "key", "left_semi")
    slim = scratch.save(slim.dropDuplicates(["key"]), "slim")
    ends = [slim.select(F.col("key").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("marks").alias(f"m_{x}")) for x in "ab"]
    sized = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    candidates = pairs.join(ends[1], "b").join(ends[0], "a").where(sized).where(alike("m_a", "m_b") >= least_equal).select("a", "b")
    candidates = scratch.save(candidates, "candidates")
    first = scratch.save(verified(scratch, candidates, sets_for, percent), "links-first")

    # what shares a bucket but isn't yet connected; main is the component of most members of a bucket
    component = connect(scratch, first, "part")
    placed = scratch.save(members.join(component, "key", "left").select("band", "key", F.coalesce("component", "key").alias("component")), "placed")
    shares = placed.groupBy("band", "component").agg(F.count("*").alias("m"))
    open_buckets = scratch.save(shares.groupBy("band").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("components")).where("components > 1"), "open")
    rest = placed.join(open_buckets, "band").select("band", "key", "component", "main", (F.col("component") != F.col("main")).alias("minor"))
    rest = scratch.save(rest, "rest")
    minors = rest.where("minor")
    # minor members of a bucket with each other; and with all of the main component, once for all buckets that they share
    among = minors.select(F.col("band").alias("box"), "key", "component")
    ask_main = minors.select(F.col("main").alias("box"), "key", "component").distinct()
    of_main = placed.select(F.col("component").alias("box"), "key", "component").distinct().join(ask_main.select("box").distinct(), "box", "left_semi")
    boxes = blocked(among, among).unionByName(blocked(ask_main, of_main)).join(slim, "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks, one after the other: pairs of different components alike by sketch. A block that has more than a few
        pairs for each of its members gives the members instead, which are settled together."""
        for rows, borders in sorted_groups(batches, 3):
            marks = fixed_width(rows.column(6))
            box, i, j, key, component = (rows.column(k).to_numpy() for k in range(5))
            asks = rows.column(5).to_numpy(zero_copy_only=False)
            out = []
            for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                ask, tell = lo + np.flatnonzero(asks[lo:hi]), lo + np.flatnonzero(~asks[lo:hi])
                if not len(ask) or not len(tell):
                    continue
                x, y, found = marks[ask], marks[tell], []
                for k in range(len(ask)):
                    match = np.flatnonzero(((y == x[k]).sum(axis=1) >= least_equal) & (component[tell] != component[ask[k]]))
                    found.append((np.full(len(match), ask[k]), tell[match]))
                p, q = (np.concatenate(v) for v in zip(*found, strict=True))
                if len(p) <= crowd * (hi - lo):
                    out.append((np.minimum(key[p], key[q]), np.maximum(key[p], key[q]), *[np.zeros(len(p), np.int64)] * 4, np.full(len(p), False), np.full(len(p), True)))
                else:
                    for who, asking in ((np.unique(p), True), (np.unique(q), False)):
                        out.append((key[who], key[who], *[v[who] for v in (box, i, j, component)], np.full(len(who), asking), np.full(len(who), False)))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, kinds, strict=True)], FOUND_NAMES)

    sorted_boxes = boxes.select("box", "i", "j", "key", "component", "asks", "marks").repartition("box", "i", "j").sortWithinPartitions("box", "i", "j")
    flagged = scratch.save(sorted_boxes.mapInArrow(compare, FOUND), "flagged")
    fresh = flagged.where("pair").select("a", "b").distinct().join(candidates, ["a", "b"], "left_anti")
    second = scratch.save(verified(scratch, scratch.save(fresh, "pairs-second"), sets_for, percent), "links-second")
    crowded = flagged.where("not pair").select(F.col("a").alias("key"), "box", "i", "j", "component", "asks")
    tables = ("members", "slim", "candidates", "placed", "open", "rest", "flagged", "pairs-second")
    if crowded.isEmpty():
        scratch.drop(*tables)
        return first.unionByName(second)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        """Exact links of a block between components that no earlier link of it connects: for each that asks those told
        that are alike by sketch, all at once, and of these only such as are still apart."""
        marks = np.frombuffer(b"".join(pdf.marks), np.uint8).reshape(len(pdf), -1)
        sets = [np.asarray(s).view(np.uint64) for s in pdf.shingles]
        out = block_links(pdf.key.to_numpy(), pdf.component.to_numpy(), pdf.asks.to_numpy(bool), marks, sets, least_equal, percent)
        return pd.DataFrame(out, columns=["a", "b"])

    needed = crowded.select("key").distinct()
    shingles = scratch.save(sets_for(scratch.save(needed, "rest-needed")), "rest-sets")
    full = crowded.join(shingles, "key").join(slim.select("key", "marks"), "key")
    third = scratch.save(full.groupBy("box", "i", "j").applyInPandas(settle, "a bigint, b bigint"), "links-third")
    scratch.drop(*tables, "rest-sets")
    return first.unionByName(second).unionByName(third)


def blocked(asks: DataFrame, told: DataFrame) -> DataFrame:
    """Rows (box, i, j, key, component, asks) so that each that asks meets each that is told in its box in one block, of
    at most about CHUNK rows a side. Boxes without both sides fall away."""
    count = lambda df, name: df.groupBy("box").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    sizes = count(asks, "ci").join(count(told, "cj"), "box")
    spot = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = asks.join(sizes, "box").select("box", spot("ci").alias("i"), every("cj").alias("j"), "key", "component", F.lit(True).alias("asks"))
    two = told.join(sizes, "box").select("box", every("ci").alias("i"), spot("cj").alias("j"), "key", "component", F.lit(False).alias("asks"))
    return one.unionByName(two)


FOUND = "a bigint, b bigint, box bigint, i int, j int, component bigint, asks boolean, pair boolean"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def fixed_width(column: pa.Array) -> np.ndarray:
    """Rows of equally long binaries as a matrix of bytes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), -1)


def sorted_groups(batches, columns: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of rows that are equal in the first columns, as a batch and the groups' borders; rows come sorted.
    A group that goes on in the next batch waits for it."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        borders = group_borders(batch, columns)
        rest = batch.slice(borders[-2])
        if len(borders) > 2:
            yield batch.slice(0, borders[-2]), borders[:-1]
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def group_borders(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in range(columns):
        values = batch.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.concatenate((np.flatnonzero(new), [batch.num_rows]))


def alike(x: str, y: str):
    """Equal bytes of two equally long binaries, counted in a vectorised Python function."""

    @F.pandas_udf("int")
    def equal(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="int32")
        p, q = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
        return pd.Series((p == q).sum(axis=1).astype(np.int32))

    return equal(x, y)


def verified(scratch: Scratch, pairs: DataFrame, sets_for: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets pass. Each end's set joins by key; a hot end's rows are split by the adaptive join."""
    needed = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    name = uuid.uuid4().hex[:8]
    sets = scratch.save(sets_for(scratch.save(needed, f"needed-{name}")), f"sets-{name}")
    x, y = (sets.select(F.col("key").alias(e), F.col("shingles").alias(f"s_{e}")) for e in "ab")
    both = F.size(F.array_intersect("s_a", "s_b"))
    rows = pairs.join(y, "b").join(x, "a").withColumn("both", both)
    return rows.where(F.col("both") * 100 >= (F.size("s_a") + F.size("s_b") - F.col("both")) * percent).select("a", "b")
