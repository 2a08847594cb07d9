"""Ranked lexical search with norm buckets.

A document is a vector of impacts, one for each term; a query is a vector of term
weights, and a score is their inner product, in integers.  Only terms that some
query of a block holds are coordinates, so vectors are short.

1. One pass over the texts keeps each document's length and the counts of the
   block's terms.  Lengths and document frequencies give weights and impacts.
2. Vectors are ordered by their length, longest first (a range shuffle, ties dealt
   by a hash), and lie in buckets of neighbouring lengths.  LEADING of the longest
   are searched first, in few tasks; the k-th place a query has there is its
   threshold.
3. A bucket is skipped for a query whose length times the bucket's greatest length
   is below the threshold (Cauchy-Schwarz).  Inside, the FOCUS heaviest
   coordinates of the query give each document the bound ``q_F p_F + |q_R| |p_R|``
   with the rest R of both; what is below the threshold goes.
4. Survivors are scored again over all coordinates, in 64-bit integers.  A task
   keeps k documents per query and raises its thresholds; a ranked window merges.

Thresholds only ever come from documents that were scored, and bounds allow for
rounding, so no document is lost.  Blocks hold BLOCK_TERMS terms (a longer query
has one of its own): that is what the driver and every task hold, beside one
Arrow batch of vectors.  The texts are read once per block.

Defined cases: a null or empty text, and one without terms, scores nothing and
is not counted.  A query without terms has no results; queries that repeat an id
are asked one by one.  Documents are rows; a null doc_id comes last among equal
scores.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.session import written

#: Distinct terms of a block of queries, about.
BLOCK_TERMS = 1 << 16
LEADING, LEADING_TASKS = 1 << 14, 8
FOCUS = 8
#: Bytes of one text that are cut into terms at a time.
RUN = 1 << 20
#: Bounds are doubles; this share above them covers their rounding.
SLACK = 1e-9

#: Bytes that belong to no term become blanks, A-Z become a-z.
_FOLDED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of ``text`` in order, in lists of bounded size."""
    at = 0
    while at < len(text):
        size = RUN
        while True:
            run = text[at:at + size].translate(_FOLDED)
            end = len(run) if at + size >= len(text) else run.rfind(b" ") + 1
            if end:
                break
            size *= 2  # one term fills the run
        yield run[:end].split()
        at += end


def _asked(queries: DataFrame, item: str, text: str) -> DataFrame:
    """ask, item, terms, block: one row for each query that has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({t for part in terms(x or b"") for t in part}) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], ["ask", "item", "terms"])

    rows = queries.select(F.monotonically_increasing_id().alias("ask"), F.col(f"`{item}`").cast("long").alias("item"),
                          F.col(f"`{text}`").cast("binary").alias("text"))
    asked = written(rows.mapInArrow(run, "ask long, item long, terms array<binary>").where("size(terms) > 0"), "lexical-asks")
    # One small row per query: a running sum deals them to blocks of bounded size.
    before = F.sum("n").over(Window.orderBy("ask").rowsBetween(Window.unboundedPreceding, -1))
    blocks = asked.select("ask", F.size("terms").alias("n")).select(
        "ask", F.floor(F.coalesce(before, F.lit(0)) / BLOCK_TERMS).cast("int").alias("block"))
    return asked.join(blocks, "ask")


def _counted(docs: DataFrame, numbers: dict[bytes, int], id_: str, text: str) -> DataFrame:
    """doc_id, n, coordinates, tfs: all terms counted, those of the block one by one."""
    held = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value.get
        for batch in batches:
            lengths, places, counts = [], [], []
            for x in batch.column(1):
                n, seen = 0, Counter()
                for part in terms(x.as_py() or b""):
                    n += len(part)
                    seen.update(map(number, part))
                seen.pop(None, None)
                lengths.append(n)
                places.append(sorted(seen))
                counts.append([seen[t] for t in places[-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(places, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "coordinates", "tfs"])

    rows = docs.select(F.col(f"`{id_}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, coordinates array<int>, tfs array<long>")


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and the n+1 offsets into them."""
    column = batch.column(name)
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0]:offsets[-1]], offsets - offsets[0]


def _vectors(counted: DataFrame, documents: int, total: int) -> DataFrame:
    """doc_id, coordinates, impacts, length: documents with a term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tf, at = _lists(batch, "tfs")
            # Python integers, as the product may exceed 64 bits.
            m = np.array([50 + 50 * n * documents // total for n in batch.column("n").to_pylist()], np.int64)
            impacts = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, np.diff(at)))
            length = np.sqrt(np.add.reduceat(impacts.astype(np.float64) ** 2, at[:-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("coordinates"),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(impacts, pa.int32())),
                 pa.array(length, pa.float64())], ["doc_id", "coordinates", "impacts", "length"])

    return counted.where("size(coordinates) > 0").mapInArrow(
        run, "doc_id long, coordinates array<int>, impacts array<int>, length double")


@dataclass(frozen=True)
class Query:
    ask: int
    coordinates: np.ndarray  # heaviest first
    weights: np.ndarray
    length: float
    #: Score and id of a place that k documents have reached.
    threshold: tuple[int, int | None] = (1, None)


class Best:
    """The k best (score, id) of a query so far; ``least`` is the score a document must reach."""

    def __init__(self, k: int, threshold: tuple[int, int | None]):
        self.k, (self.least, self.last) = k, threshold
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, id_: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.least
        if self.last is not None:  # of equal scores the larger ids come too late
            good &= (score > self.least) | (~null & (id_ <= self.last))
        if not good.any():
            return
        score, id_, null = (np.concatenate([old, new[good]]) for old, new in (
            (self.score, score), (self.id, id_), (self.null, null)))
        kept = np.lexsort((id_, null, -score))[:self.k]
        self.score, self.id, self.null = score[kept], id_[kept], null[kept]
        if len(kept) == self.k:
            self.least, self.last = int(self.score[-1]), None if self.null[-1] else int(self.id[-1])


def _searched(vectors: DataFrame, queries: list[Query], coordinates: int, k: int) -> DataFrame:
    """ask, doc_id, score: what each task keeps; ``vectors`` come longest first."""
    held = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        best = [Best(k, q.threshold) for q in asked]
        weights = np.zeros(coordinates, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            place, at = _lists(batch, "coordinates")
            impact = _lists(batch, "impacts")[0].astype(np.int64)
            length = batch.column("length").to_numpy()
            null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            id_ = batch.column("doc_id").fill_null(0).to_numpy()
            # The bucket by coordinates: who has one, and with which impact.
            order = np.argsort(place, kind="stable")
            owner = np.repeat(np.arange(len(id_)), np.diff(at))[order]
            by_place, by_impact = place[order], impact[order].astype(np.float64)
            longest, square = float(length.max()), length * length
            for query, top in zip(asked, best, strict=True):
                if query.length * longest * (1 + SLACK) < top.least:
                    continue
                focus = query.coordinates[:FOCUS]
                low, high = np.searchsorted(by_place, focus), np.searchsorted(by_place, focus, side="right")
                product, rest = np.zeros(len(id_)), square.copy()
                for a, b, w in zip(low.tolist(), high.tolist(), query.weights[:FOCUS].tolist(), strict=True):
                    product[owner[a:b]] += w * by_impact[a:b]
                    rest[owner[a:b]] -= by_impact[a:b] ** 2
                left = math.sqrt(float((query.weights[FOCUS:].astype(np.float64) ** 2).sum()))
                bound = product + left * np.sqrt(np.maximum(rest, 0) + SLACK * square)
                alive = np.flatnonzero(bound * (1 + SLACK) >= top.least)
                if not len(alive):
                    continue
                weights[query.coordinates] = query.weights
                sizes = at[alive + 1] - at[alive]
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                values = np.arange(sizes.sum()) + np.repeat(at[alive] - starts, sizes)
                score = np.add.reduceat(weights[place[values]] * impact[values], starts)
                weights[query.coordinates] = 0
                top.add(score, id_[alive], null[alive])
        for query, top in zip(asked, best, strict=True):
            if len(top.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(top.score), query.ask), pa.int64()),
                     pa.array(top.id, pa.int64(), mask=top.null), pa.array(top.score, pa.int64())],
                    ["ask", "doc_id", "score"])

    return vectors.mapInArrow(run, "ask long, doc_id long, score long")


def _longest_first(vectors: DataFrame) -> DataFrame:
    return vectors.repartitionByRange(F.col("length").desc(), F.xxhash64("doc_id", "coordinates")).sortWithinPartitions(
        F.col("length").desc())


def _leading(vectors: DataFrame) -> Column:
    """Which rows are searched first: about LEADING of the longest, however many share a length."""
    rows = vectors.count()
    if rows <= LEADING:
        return F.lit(True)
    cut = vectors.agg(F.percentile_approx("length", F.lit(1 - LEADING / rows), F.lit(10_000))).first()[0]
    longest = F.col("length") >= cut
    share = LEADING / vectors.where(longest).count()
    return longest & (F.pmod(F.xxhash64("doc_id", "coordinates"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ask").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, asked: DataFrame, k: int, id_: str, text: str) -> DataFrame | None:
    asks = [(r["ask"], [bytes(t) for t in r["terms"]]) for r in asked.select("ask", "terms").collect()]
    numbers = {t: i for i, t in enumerate(sorted({t for _, own in asks for t in own}))}
    counted = written(_counted(docs, numbers, id_, text), "lexical-counts")
    documents, total = counted.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    if not documents:
        return None
    # One row per term of the block.
    holders = dict(map(tuple, counted.select(F.explode("coordinates").alias("t")).groupBy("t").count().collect()))
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for t, df in holders.items()}
    queries = []
    for ask, own in asks:
        places = np.array([t for t in (numbers[x] for x in own) if t in weight], np.int64)
        weights = np.array([weight[t] for t in places.tolist()], np.int64)
        order = np.argsort(-weights, kind="stable")
        queries.append(Query(ask, places[order], weights[order],
                             math.sqrt(float((weights.astype(np.float64) ** 2).sum()))))
    vectors = written(_vectors(counted, documents, total), "lexical-vectors")
    first = _leading(vectors)
    # Few tasks, as each keeps k documents per query before any threshold is known.
    leading = written(_searched(_longest_first(vectors.where(first)).coalesce(LEADING_TASKS), queries, len(numbers), k),
                      "lexical-leading")
    # One row per query of the block.
    known = {r["ask"]: (r["score"], r["doc_id"]) for r in _ranked(leading, k).where(F.col("rank") == k).collect()}
    queries = [replace(q, threshold=known.get(q.ask, q.threshold)) for q in queries]
    others = _searched(_longest_first(vectors.where(~first)), queries, len(numbers), k)
    return _ranked(leading.unionByName(others), k)


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for every query the k best documents."""
    asked = written(_asked(queries, item, item_text), "lexical-blocks")
    found = docs.sparkSession.createDataFrame([], "ask long, doc_id long, score long, rank int")
    for (block,) in sorted(map(tuple, asked.select("block").distinct().collect())):
        part = _block(docs, asked.where(F.col("block") == block), k, id_, text)
        if part is not None:
            found = found.unionByName(part)
    return found.join(asked.select("ask", "item"), "ask").select(
        F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
