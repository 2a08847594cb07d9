"""Near duplicates by circulant MinHash.

A document's set are the hashes of its distinct word shingles.  Two random
bijections of 32-bit integers give all coordinates of its signature: the first
scatters the set, and the k-th coordinate is the least value of the second over
the set shifted by k, around the circle of 2**32.  BANDS bands of ROWS
coordinates make buckets.  A pair at similarity 0.8 misses every bucket with a
probability of 3 in a million.

1. Equal sets (by a 128-bit digest) are one class; its smallest id stands for it.
2. Sketches (a byte of each coordinate) tell which members of a bucket are
   likely links.  Of these, in the first bands, a spanning forest is verified on
   the full sets.  So a group of m near copies costs about m checks.
3. Links give components.  In all buckets whose members lie in more than one
   component, every likely pair across components is verified on the full sets,
   inside the task that has the bucket.  A link that could still join two
   components is not missed, whatever the shape of the group.

A pair is looked at in the first band it shares, hence once.  A bucket of more
than TILE members is split into tiles of two parts, each its own task: no task
holds a hot bucket, and no pairs are written.  A likely pair agrees in LIKELY of
the sketch's 96 bytes; at similarity 0.8 77 are expected, with a deviation of 4.

Defined cases: null and empty texts, and those without words, have no shingles
and no links.  A text with fewer words than a shingle has one, its whole
sequence.  Rows that share an id are one node: their links join, and each row is
returned.  Rows with a null id are linked with nothing unless an equal set has
an id.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfline.session import written

from .graph import components
from .joins import listed
from .text import buffers, passes, shingle_sets

BANDS, ROWS = 24, 4
LIKELY = 58
#: Bands whose buckets the first round looks at.
FIRST = 2
TILE = 2000
#: Shingles that are permuted at a time, to stay in a core's cache.
RUN = 1 << 16


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS * ROWS coordinates for each set, none of them empty."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    first = 0
    while first < len(sets):
        last, n = first, 0
        while last < len(sets) and (last == first or n + len(sets[last]) <= RUN):
            n += len(sets[last])
            last += 1
        # The hashes are scattered already: their low half is the first bijection.
        scattered = np.concatenate(sets[first:last]).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[first:last - 1]])]).astype(np.int64)
        moved, spare = np.empty_like(scattered), np.empty_like(scattered)
        for k in range(BANDS * ROWS):
            np.add(scattered, np.uint32(k), out=moved)
            np.multiply(moved, np.uint32(0x9E3779B1), out=moved)
            np.right_shift(moved, np.uint32(15), out=spare)
            np.bitwise_xor(moved, spare, out=moved)
            np.multiply(moved, np.uint32(0x85EBCA77), out=moved)
            out[first:last, k] = np.minimum.reduceat(moved, starts)
        first = last
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band."""
    x = np.full((len(signature), BANDS), 0x9E3779B97F4A7C15, np.uint64)
    for r in range(ROWS):
        x ^= signature[:, r::ROWS]
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
    return x.astype(np.int64)


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest, sketch, bands; the last three null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text"):
                sets = list(shingle_sets(*buffers(part.column(1)), width))
                full = [i for i, s in enumerate(sets) if len(s)]
                signature = signatures([sets[i] for i in full]) if full else np.zeros((0, BANDS * ROWS), np.uint32)
                digests: list = [None] * len(sets)
                sketches, bands = list(digests), list(digests)
                hashes = _bands(signature)
                # A byte of every coordinate, then 32 bits of every band.
                bytes_ = np.hstack([signature.astype(np.uint8), hashes.astype(np.uint32).view(np.uint8)])
                for i, sketch, band in zip(full, bytes_, hashes, strict=True):
                    digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    sketches[i], bands[i] = sketch.tobytes(), band
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "digest", "sketch", "bands"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, sketch binary, bands array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, shingles: the sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(*buffers(part.column(1)), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _verified(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(s.as_py(), np.uint64) for s in batch.column(c)] for c in (2, 3)]
            yes = pa.array([similar(a, b, percent) for a, b in zip(*sets, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(yes)

    return run


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (above := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(above, above)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets, some thousand rows of them at a time; rows come sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 2 * TILE:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [table.column(c).to_numpy() for c in ("band", "bucket", "tile")]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
        if len(cuts):
            cut = int(cuts[-1]) + 1
            yield table.slice(0, cut).combine_chunks().to_batches()[0]
            held = table.slice(cut).combine_chunks().to_batches()
        else:
            held = table.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def likely_pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each bucket (left rows, right rows, agreement) of pairs in different
    components that share no earlier band, the likeliest first."""
    band, bucket, tile, side, component = (
        batch.column(c).to_numpy() for c in ("band", "bucket", "tile", "side", "component"))
    sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(len(band), -1)
    words = np.ascontiguousarray(sketch[:, BANDS * ROWS:]).view(np.uint32)
    sketch = np.ascontiguousarray(sketch[:, :BANDS * ROWS])
    new = np.concatenate([[True], (band[1:] != band[:-1]) | (bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1])])
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    ends = np.append(starts[1:], len(band))[group]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = np.arange(len(band))
    step = 0
    while True:
        step += 1
        rows = rows[rows + step < ends[rows]]
        if not len(rows):
            break
        # In a tile of two parts only pairs across the parts count.
        left = rows[(component[rows] != component[rows + step])
                    & ((side[rows] != side[rows + step]) | (side[rows] < 0))]
        for at in range(0, len(left), 1 << 14):
            i = left[at:at + (1 << 14)]
            j = i + step
            agree = (sketch[i] == sketch[j]).sum(axis=1)
            ok = agree >= LIKELY
            i, j, agree = i[ok], j[ok], agree[ok]
            ok = (words[i] == words[j]).argmax(axis=1) == band[i]
            if ok.any():
                found.append((i[ok], j[ok], agree[ok]))
    if not found:
        return
    i, j, agree = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((j, i, -agree, group[i]))
    i, j, agree = i[order], j[order], agree[order]
    cuts = np.flatnonzero(np.diff(group[i])) + 1
    yield from zip(np.split(i, cuts), np.split(j, cuts), np.split(agree, cuts), strict=True)


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the likely pairs of each bucket of the first bands;
    of the others every row in a likely pair, paired with itself."""
    for batch in _buckets(batches):
        ids, a, b = batch.column("id").to_numpy(), [], []
        component, band = batch.column("component").to_numpy(), batch.column("band").to_numpy()
        for left, right, _ in likely_pairs(batch):
            if band[left[0]] >= FIRST:
                some = ids[np.unique(np.concatenate([left, right]))].tolist()
                a += some
                b += some
                continue
            forest = _Forest()
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                if forest.join(component[i], component[j]):
                    a.append(ids[i])
                    b.append(ids[j])
        yield _pairs(a, b)


def _likely_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that are in some likely pair of their bucket."""
    for batch in _buckets(batches):
        rows = [np.concatenate([i, j]) for i, j, _ in likely_pairs(batch)]
        if rows:
            yield batch.take(pa.array(np.unique(np.concatenate(rows))))


def _links(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The likely pairs that join components and hold on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _buckets(batches):
            ids, component = batch.column("id").to_numpy(), batch.column("component").to_numpy()
            sets, a, b = batch.column("shingles"), [], []
            for left, right, _ in likely_pairs(batch):
                forest = _Forest()
                for i, j in zip(left.tolist(), right.tolist(), strict=True):
                    x, y = forest.root(component[i]), forest.root(component[j])
                    if x != y and similar(*(np.frombuffer(sets[k].as_py(), np.uint64) for k in (i, j)), percent):
                        forest.join(x, y)
                        a.append(ids[i])
                        b.append(ids[j])
            yield _pairs(a, b)

    return run


def _in_buckets(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows dealt to their buckets and, in large ones, to the tiles they are in."""
    parts = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    one = members.join(sizes, ["band", "bucket"]).withColumn("parts", parts).withColumn("own", own)
    # Part p meets part q in tile (p, q); rows of p are on side 0, those of q on side 1.
    tiles = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("tile"), F.lit(-1).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(
            (F.least(F.col("own"), other) * F.col("parts") + F.greatest(F.col("own"), other)).alias("tile"),
            F.when(other == F.col("own"), -1).when(F.col("own") < other, 0).otherwise(1).alias("side"))))
    out = one.withColumn("_t", F.explode(tiles)).select(*members.columns, "_t.tile", "_t.side")
    return out.repartition("band", "bucket", "tile").sortWithinPartitions("band", "bucket", "tile", "id")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs``.

    Documents are linked if 100 * |A and B| >= ``percent`` * |A or B|, for
    ``percent`` of 80 and more; the component is named by its smallest id.
    """
    if percent < 80:
        raise ValueError("the bands are made for similarities of 0.8 and more")
    signs = written(signed(docs, width), "minhash-signs")
    classes = written(signs.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("id")), "minhash-classes")
    # One row per class: rows that repeat id and text would meet each other in every bucket.
    single = signs.join(classes.select(F.col("digest").alias("_digest"), "id"),
                        (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("id"))).dropDuplicates(
        ["digest", "doc_id"])
    places = single.select("id", F.posexplode("bands").alias("band", "bucket"))
    sizes = written(places.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "minhash-sizes")
    # Per class the bands with company, then its sketch goes along with them.
    shared = places.join(sizes, ["band", "bucket"], "left_semi").groupBy("id").agg(
        F.collect_list(F.struct("band", "bucket")).alias("places"))
    members = written(single.select("id", "sketch").join(shared, "id").select(
        "id", "sketch", F.explode("places").alias("p")).select("id", "sketch", "p.band", "p.bucket"), "minhash-members")

    first = _in_buckets(members.withColumn("component", F.col("id")), sizes)
    pairs = written(first.mapInArrow(_forests, "a long, b long"), "minhash-forest")
    involved = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    texts = listed(docs.select("doc_id", "text"), involved, "minhash-involved").distinct()
    sets = written(full_sets(texts, width), "minhash-sets")
    pairs = pairs.where("a <> b")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    links = written(pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(
        _verified(percent), "a long, b long"), "minhash-links")
    joined = components(links)

    told = written(members.join(joined, F.col("id") == F.col("node"), "left").select(
        "id", "sketch", "band", "bucket", F.coalesce("component", "id").alias("component")), "minhash-told")
    open_ = told.groupBy("band", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where(
        "low <> high").select("band", "bucket", "n")
    rest = _in_buckets(told, open_)
    likely = written(rest.mapInArrow(_likely_members, _schema(rest)), "minhash-likely")
    more = likely.join(sets, F.col("id") == F.col("doc_id")).drop("doc_id").repartition(
        "band", "bucket", "tile").sortWithinPartitions("band", "bucket", "tile", "id").mapInArrow(
        _links(percent), "a long, b long")
    joined = components(links.unionByName(written(more, "minhash-more")))

    by_class = classes.join(joined, F.col("id") == F.col("node"), "left").select(
        F.col("digest").alias("_digest"), F.coalesce("component", "id").alias("component"))
    component = F.coalesce("component", "doc_id")
    return signs.join(by_class, F.col("digest") == F.col("_digest"), "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id, null last.

    Rows are told by a number of their own, so rows that repeat an id, and rows
    without one, are compared like any others.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("_node"), F.struct("*").alias("_doc")), "minhash-rows")
    found = written(near_duplicates(rows.select(F.col("_node").alias("doc_id"), "_doc.text"), width, percent).where(
        "n_shingles > 0").select(F.col("doc_id").alias("_node"), "component_id"), "minhash-found")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "_node")
    stays = found.join(rows.select("_node", F.col("_doc.doc_id").alias("id")), "_node").groupBy("component_id").agg(
        F.min(order).alias("best")).select(F.col("best._node").alias("_node"))
    gone = found.select("_node").join(stays, "_node", "left_anti")
    return rows.join(gone, "_node", "left_anti").select("_doc.*")
