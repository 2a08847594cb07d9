"""Passages that repeat, byte for byte, by a sorted sparse suffix array.

A byte goes if some LENGTH-byte string that covers it also starts anywhere else.
Comparing the suffixes at all bytes would move the corpus LENGTH times; it is
enough to compare those at anchors.  Every LENGTH-byte window has one: the GRAM
bytes in it whose hash is least, the first of equals.  Equal windows have equal
anchors at equal places, so two windows are only compared if their anchors'
grams are.  Neighbouring windows mostly share an anchor; the run of window
starts that an anchor answers for is one row.

1. Every block of documents lists the grams of its anchors.  A gram that occurs
   once can be in no repeat; the blocks get back those that occur more often.
2. For each anchor of such a gram its suffix goes along with the bytes before it
   that its run needs.  Rows are range-partitioned by their leading gram: Spark
   samples the splitters.  A bucket sorts its windows by two keys, the gram's
   and the window's 64-bit hash, and equal neighbours are repeats.  Equal grams
   never lie in two buckets, so no pair straddles a boundary, but for the
   grams in more than HOT places: these are spread over the buckets, and their
   windows are counted by an aggregate that combines before the shuffle.
3. The blocks get their spans and cut them out.

Copies of whole texts are found first, by two 64-bit hashes and the length; all
their bytes repeat, and one of them stands for all in the comparison.  A very
long text is read in pieces that overlap by LENGTH - 1 bytes.

Defined cases: a null text is empty; a text shorter than LENGTH loses nothing.
Rows that repeat an id and text are texts of their own and lose all.  Rows are
named by doc_id and the text's hashes, so a repeated id does no harm.  Texts are
compared as UTF-8 bytes and a cut may fall inside a character; kept bytes are
bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelfline.session import written

from .text import mix, powers

LENGTH, GRAM = 200, 100
BLOCK_BYTES = 4 << 20
#: Bytes that one pass of numpy takes.
PASS_BYTES = 1 << 18
#: Places of a gram beyond which no task gets all of them.
HOT = 20_000
_draw = np.random.Generator(np.random.PCG64(5))
_BYTE = _draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_draw.integers(1, 2**62, dtype=np.uint64)) * 4 + 1
_BITS = 20
_LOW = np.uint64((1 << _BITS) - 1)
_UP, _DOWN = powers(_BASE, 1 << _BITS), powers(pow(_BASE, -1, 2**64), 1 << _BITS)


def hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each place on."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _UP[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * _DOWN[:n - size + 1])


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, piece starts, the text of each piece, its place in the text).

    Pieces of one text overlap, so that every window lies in exactly one.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def packed() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts = np.concatenate([[0], np.cumsum([len(b) for _, _, b in held])]).astype(np.int64)
        return (np.frombuffer(b"".join(b for _, _, b in held), np.uint8), starts,
                np.array([t for t, _, _ in held]), np.array([p for _, p, _ in held]))

    for i, text in enumerate(texts):
        for at in range(0, len(text) - LENGTH + 1, PASS_BYTES):
            piece = text[at:at + PASS_BYTES + LENGTH - 1]
            if held and size + len(piece) > 2 * PASS_BYTES:
                yield packed()
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield packed()


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first and last window start of the run, hash of the gram) of every anchor."""
    grams = hashes(data, GRAM)
    # The hash without its low bits, then the place: the first of equals is least.
    keys = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width = LENGTH - GRAM + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(keys)] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - LENGTH + 1
    least = np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & _LOW
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    windows = np.flatnonzero(owner[:n] == owner[LENGTH - 1:])
    least = least[windows].astype(np.int64)
    cut = np.flatnonzero((np.diff(least) != 0) | (np.diff(windows) != 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(windows)]]) - 1
    return owner[windows[first]], windows[first], windows[last], grams[least[first]]


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of the blocks' anchors, with their number in the batch."""
    for batch in batches:
        texts = [(t.as_py() or "").encode() for t in batch.column(0)]
        block = batch.column(1).to_numpy()
        for data, starts, text, _ in pieces(texts):
            piece, _, _, grams = anchors(data, starts)
            pairs = np.stack([block[text[piece]], grams.view(np.int64)], axis=1)
            pairs, n = np.unique(pairs, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)], ["block", "gram", "n"])


_ROWS = "bucket long, gram long, block long, doc_id long, h1 long, at long, context binary, hot boolean"


def _suffixes(texts: pa.Table, told: pa.Table, splitters: np.ndarray) -> pa.Table:
    """The anchors of a block whose gram is repeated, with the bytes of their windows.

    ``told``: the block's repeated grams, and rows without a gram for the texts
    that are copies; of these only those that stand for the others count.
    """
    out: dict[str, list] = {k.split()[0]: [] for k in _ROWS.split(", ")}
    is_gram = told.column("gram").is_valid().to_numpy()
    grams = told.column("gram").drop_null().to_numpy()
    hot = told.column("hot").to_numpy()[is_gram].astype(bool)
    order = np.argsort(grams)
    grams, hot = grams[order], hot[order]
    idle = {(d, h) for d, h, s, g in zip(*(told.column(c).to_pylist() for c in ("doc_id", "h1", "stands")),
                                         is_gram.tolist(), strict=True) if not g and not s}
    ids, h1 = texts.column("doc_id").to_pylist(), texts.column("h1").to_pylist()
    block = texts.column("block")[0].as_py() if texts.num_rows else None
    raw = [b"" if (d, h) in idle else (t.as_py() or "").encode()
           for d, h, t in zip(ids, h1, texts.column("text"), strict=True)]
    for data, starts, text, place in pieces(raw):
        piece, first, last, found = anchors(data, starts)
        found = found.view(np.int64)
        spot = np.searchsorted(grams, found)
        spot[spot == len(grams)] = 0
        yes = np.flatnonzero(grams[spot] == found) if len(grams) else np.zeros(0, np.int64)
        for i in yes.tolist():
            p = piece[i]
            out["bucket"].append(int(np.searchsorted(splitters, found[i], side="right")))
            out["gram"].append(int(found[i]))
            out["block"].append(block)
            out["doc_id"].append(ids[text[p]])
            out["h1"].append(h1[text[p]])
            out["at"].append(int(place[p] + first[i] - starts[p]))
            out["context"].append(data[first[i]:last[i] + LENGTH].tobytes())
            out["hot"].append(bool(hot[spot[i]]))
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.table({k.split()[0]: pa.array(out[k.split()[0]], kinds[k.split()[1]]) for k in _ROWS.split(", ")})


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in its context, hash) of every window of the rows."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = (1 << _BITS) // (2 * LENGTH)  # a context is shorter than twice LENGTH
    for at in range(0, batch.num_rows, step):
        contexts = batch.column("context").slice(at, step).to_pylist()
        starts = np.concatenate([[0], np.cumsum([len(c) for c in contexts])]).astype(np.int64)
        window = hashes(np.frombuffer(b"".join(contexts), np.uint8), LENGTH)
        counts = np.diff(starts) - LENGTH + 1
        row = np.repeat(np.arange(len(contexts)), counts)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        found.append((row + at, place, window[starts[row] + place]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _whole_grams(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by gram; about ``rows`` at a time, no gram cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        gram = table.column("gram").to_numpy()
        cuts = np.flatnonzero(gram[1:] != gram[:-1])
        cut = int(cuts[-1]) + 1 if len(cuts) else 0
        if cut:
            yield table.slice(0, cut).combine_chunks().to_batches()[0]
        held = table.slice(cut).combine_chunks().to_batches()
    held = [b for b in held if b.num_rows]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, doc_id, h1, start, stop of repeated runs."""
    for whole in _whole_grams(batches):
        # A gram in HOT places at most has some million windows.
        gram = whole.column("gram").to_numpy()
        ends = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram))
        at = 0
        while at < len(gram):
            end = int(ends[min(len(ends) - 1, np.searchsorted(ends, at + 8192))])
            batch = whole.slice(at, end - at)
            at = end
            row, place, window = _windows(batch)
            own = batch.column("gram").to_numpy()[row]
            order = np.lexsort((window, own))
            same = (window[order][1:] == window[order][:-1]) & (own[order][1:] == own[order][:-1])
            repeated = np.zeros(len(row), bool)
            repeated[order[1:][same]] = True
            repeated[order[:-1][same]] = True
            yes = np.flatnonzero(repeated)
            if not len(yes):
                continue
            cut = np.flatnonzero((np.diff(yes) != 1) | (np.diff(row[yes]) != 0)) + 1
            first, last = yes[np.concatenate([[0], cut])], yes[np.concatenate([cut, [len(yes)]]) - 1]
            rows = pa.array(row[first])
            base = batch.column("at").to_numpy()[row[first]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("block").take(rows), batch.column("doc_id").take(rows), batch.column("h1").take(rows),
                 pa.array(base + place[first]), pa.array(base + place[last] + LENGTH)],
                ["block", "doc_id", "h1", "start", "stop"])


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            some = batch.slice(at, 4096)
            row, place, window = _windows(some)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [some.column("gram").take(rows), pa.array(window.view(np.int64)), some.column("block").take(rows),
                 some.column("doc_id").take(rows), some.column("h1").take(rows),
                 pa.array(some.column("at").to_numpy()[row] + place)],
                ["gram", "window", "block", "doc_id", "h1", "start"])


def merged(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, stops, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _cut(texts: pa.Table, spans: pa.Table) -> pa.Table:
    found: dict[tuple, tuple[list, list]] = {}
    copied = set()
    for id_, h1, a, b in zip(*(spans.column(c).to_pylist() for c in ("doc_id", "h1", "start", "stop")), strict=True):
        if a is None:
            copied.add((id_, h1))
            continue
        own = found.setdefault((id_, h1), ([], []))
        own[0].append(a)
        own[1].append(b)
    out: list[list] = [[], [], [], [], []]
    for id_, h1, text in zip(*(texts.column(c) for c in ("doc_id", "h1", "text")), strict=True):
        id_, h1, raw = id_.as_py(), h1.as_py(), (text.as_py() or "").encode()
        if (id_, h1) in copied:
            runs = [(0, len(raw))]
        else:
            runs = merged(*found.get((id_, h1), ([], [])))
        kept, at = [], 0
        for a, b in runs:
            kept.append(raw[at:a])
            at = b
        kept.append(raw[at:])
        for column, value in zip(out, (id_, len(raw), sum(b - a for a, b in runs), len(runs), b"".join(kept)), strict=True):
            column.append(value)
    return pa.table({"doc_id": pa.array(out[0], pa.int64()), "n_bytes": pa.array(out[1], pa.int64()),
                     "n_removed": pa.array(out[2], pa.int64()), "n_spans": pa.array(out[3], pa.int64()),
                     "kept": pa.array(out[4], pa.binary())})


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array([hashlib.sha256(k.as_py()).hexdigest() for k in batch.column(4)], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h1"),
                       F.xxhash64(F.lit(7), text).alias("h2"), F.octet_length(text).alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "h1", "h2"), F.lit(1 + total // BLOCK_BYTES)))
    # Copies of whole texts: the smallest id stands for them.
    texts = rows.where(F.col("size") >= LENGTH).select("block", "doc_id", "h1", "h2", "size")
    copies = texts.groupBy("h1", "h2", "size").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    copied = written(texts.join(copies, ["h1", "h2", "size"]).groupBy("block", "doc_id", "h1").agg(
        F.max(F.coalesce(F.col("doc_id") == F.col("least"), F.col("least").isNull())).alias("stands")), "repeats-copied")
    rows = rows.select("block", "doc_id", "h1", "text")

    asked = rows.select("text", "block").mapInArrow(_asked, "block long, gram long, n long")
    repeated = written(asked.withColumn("n", F.sum("n").over(Window.partitionBy("gram"))).where("n > 1").select(
        "block", "gram", "n"), "repeats-grams")
    # Splitters are sampled quantiles of the grams' places.
    buckets = int(min(10_000, 1 + repeated.count() // 16_384))
    splitters = repeated.agg(F.percentile_approx("gram", [i / buckets for i in range(1, buckets)] or [0.5])).first()[0]
    splitters = np.array(sorted(set(splitters or [])), np.int64)
    hots = not repeated.where(F.col("n") > hot).isEmpty()
    marks = copied.select("block", "doc_id", "h1", "stands")
    told = repeated.select("block", "gram", (F.col("n") > hot).alias("hot")).unionByName(marks, allowMissingColumns=True)
    contexts = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        lambda left, right: _suffixes(left, right, splitters), _ROWS)
    if hots:
        contexts = written(contexts, "repeats-contexts")
    spans = contexts.where("NOT hot").repartition("bucket").sortWithinPartitions("gram").mapInArrow(
        _spans, "block long, doc_id long, h1 long, start long, stop long")
    if hots:
        windows = written(contexts.where("hot").mapInArrow(
            _hot_windows, "gram long, window long, block long, doc_id long, h1 long, start long"), "repeats-hot")
        twice = windows.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        more = windows.join(twice, ["gram", "window"], "left_semi")
        # Starts that follow one another are one span.
        run = F.col("start") - F.row_number().over(Window.partitionBy("block", "doc_id", "h1").orderBy("start"))
        spans = spans.unionByName(more.select("block", "doc_id", "h1", "start").distinct().withColumn("run", run).groupBy(
            "block", "doc_id", "h1", "run").agg(F.min("start").alias("start"), (F.max("start") + LENGTH).alias("stop")).drop("run"))
    spans = written(spans, "repeats-spans").unionByName(marks, allowMissingColumns=True)
    return rows.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """The operator's result with the SHA-256 of the kept bytes in their place."""
    return remove_repeats(docs).mapInArrow(
        _digested, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
