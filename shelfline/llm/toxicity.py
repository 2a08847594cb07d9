"""Toxicity by two class-conditional Kneser-Ney models.

Per class the probability of a word after another is that of an interpolated
Kneser-Ney bigram.  All counts are continuation counts: a pair counts once for each
word that stands before it, a word once for each that precedes it, so copied passages
do not count again.  A discount is taken from every count, and what it frees goes to
one backoff distribution that both classes share: the continuation counts of all
training texts.  A word rare in both classes thus has the same ratio, whatever its
counts.

    P_class(w | v) = (max(c_class(v w) - D, 0) + freed_class(v) * P_class(w)) / c_class(v)
    P_class(w) = max(n_class(w) - D, 0) / N_class + freed_class * P_shared(w)

A word's ratio is log P_toxic(w | v) - log P_ordinary(w | v).  A document is seen
by its mean ratio, that is its log-likelihoods by its length; by the means of its one,
two and three most toxic words, as over a whole document a few insults drown; and by
the logarithm of its length, as the largest of many is larger.  A logistic curve of
them, and the discount, are fitted on labelled documents that the counts leave out.
In it toxicity never falls with the ratios nor rises with the length, so a long
clean text does not drift into the other class.

Words are runs outside ``[\\x20\\x09-\\x0D]`` in lower case, without the marks EDGES
around them; scoring tells words and pairs by 64-bit hashes, whole batches at a time.  Training takes at most SAMPLE labelled documents of each class, those
with the smallest hashes of their ids, with their whole texts, and no further one
once these exceed SAMPLE_BYTES.  Words and pairs with no more than the least discount
in both classes differ from unseen ones in nothing and are not sent to the tasks; each
other one occurs twice at least, so what is sent is smaller than the sample.  Nothing
else depends on the data's size.  Scoring is one pass over the rows, without a shuffle.

Defined cases: a null or empty text scores like one unseen word.  A label row with a
null counts as none; an id with two labels is toxic if one says so.  Without toxic
training rows every score is 0, with nothing but toxic ones 1; if the training texts
hold no words, 0.  A null id is not held out and not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.session import written

from .text import buffers, edged_words, pair_hashes, passes, runs, word_runs

SAMPLE, SAMPLE_BYTES = 10_000, 64 << 20
DISCOUNTS = (2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0)
#: The means of so many most toxic words of a document are looked at.
MOST = (1, 2, 3)
#: One in so many sampled documents fits the curve, the others are counted.
FITS = 4
EDGES = b".,;:!?\"'()"


def remainder(id_: Column, of: int) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % of


def sampled(labels: DataFrame, learn: Column) -> DataFrame:
    """_id, toxic, fits: the bounded training sample."""
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(
        F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("order", F.xxhash64("_id"))
    pick = lambda kind: known.where(F.col("toxic") == kind).orderBy("order", "_id").limit(SAMPLE)
    return pick(0).unionByName(pick(1)).select("_id", "toxic", (F.pmod("order", F.lit(FITS)) == 0).alias("fits"))


def sampled_rows(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """text, toxic, fits: the sample's texts, up to SAMPLE_BYTES of a class and one document more."""
    rows = written(docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select(
        "_id", "text", F.col("toxic").cast("int"), "fits"), "toxicity-sample")
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_id", "toxic").agg(F.sum(F.coalesce(F.octet_length("text").cast("long"), F.lit(0))).alias("bytes"))
    taken = sizes.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0))).where(F.col("before") < SAMPLE_BYTES)
    return rows.join(F.broadcast(taken.select("_id")), "_id", "left_semi").select("text", "toxic", "fits")


def _words(text: bytes) -> Iterator[list[bytes]]:
    return ([w.strip(EDGES) for w in words] for words in word_runs(text))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """earlier, before, word, toxic: the distinct triples of each run of a text."""
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            tail = [b"", b""]
            for words in _words((text.as_py() or "").encode()):
                line = tail + words
                triples, tail = set(zip(line, line[1:], words, strict=False)), line[-2:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t[k] for t in triples], pa.binary()) for k in range(3)]
                    + [pa.array([toxic] * len(triples), pa.int32())], ["earlier", "before", "word", "toxic"])


def _columns(rows: DataFrame) -> dict:
    """Numbers as numpy arrays, words as Arrow columns; no object for each row on the driver."""
    table = rows.toArrow()
    return {c: table[c] if pa.types.is_binary(table[c].type) or pa.types.is_large_binary(table[c].type)
            else table[c].to_numpy() for c in table.column_names}


class Ratios:
    """log P_toxic / P_ordinary of every word after another, for one discount."""

    def __init__(self, table: dict, grams: dict, totals: dict, discount: float):
        freed = [totals[f"freed_{kind}_{discount:g}"] / max(1, totals[f"n_{kind}"]) for kind in ("ordinary", "toxic")]

        def chances(rows: dict) -> list:
            shared = (rows["shared"] + 0.5) / (totals["n_shared"] + 0.5 * totals["words"])
            return [np.maximum(rows[kind] - discount, 0) / totals[f"n_{kind}"] + f * shared
                    for kind, f in zip(("ordinary", "toxic"), freed, strict=True)]

        chance = chances(table)
        self.unseen = float(np.log(freed[1] / freed[0]))
        ratios = np.log(chance[1] / chance[0]) - self.unseen
        self.words = {w: r for w, r in zip(table["word"].to_pylist(), ratios.tolist(), strict=True) if r}
        both, backs = [], []
        for kind, p in zip(("ordinary", "toxic"), chances(grams), strict=True):
            n = grams[f"before_{kind}"]
            backs.append(np.where(n > 0, grams[f"freed_{kind}_{discount:g}"] / np.maximum(n, 1), 1.0))
            both.append(np.maximum(grams[f"pair_{kind}"] - discount, 0) / np.maximum(n, 1) + backs[-1] * p)
        #: For each state its failure ratio and the ratios of its arcs.
        self.states: dict[bytes, tuple[float, dict[bytes, float]]] = {}
        for v, w, r, back in zip(grams["before"].to_pylist(), grams["word"].to_pylist(), (np.log(both[1] / both[0]) - self.unseen).tolist(),
                                 np.log(backs[1] / backs[0]).tolist(), strict=True):
            self.states.setdefault(v, (back, {}))[1][w] = r

    def _after(self, v: bytes, w: bytes) -> float:
        if (state := self.states.get(v)) is None:
            return self.words.get(w, 0.0)
        ratio = state[1].get(w)
        return state[0] + self.words.get(w, 0.0) if ratio is None else ratio

    def packed(self) -> Packed:
        arcs = [(v, w, r) for v, (_, own) in self.states.items() for w, r in own.items()]
        before, after = (_hashes([arc[k] for arc in arcs]) for k in range(2))
        return Packed(
            Lookup(_hashes(list(self.words)), list(self.words.values())),
            Lookup(_hashes(list(self.states)), [back for back, _ in self.states.values()]),
            Lookup(pair_hashes(before, after), [r for _, _, r in arcs]))


def _hashes(words: list[bytes]) -> np.ndarray:
    """Those that ``edged_words`` gives the same words in a text."""
    texts = pa.array(words, pa.binary())
    found, at = edged_words(*buffers(texts), EDGES)
    out = np.zeros(len(words), np.uint64)  # an empty word's
    some = np.diff(at) > 0
    out[some] = found[at[:-1][some]]
    return out


class Lookup:
    """Numbers by their hashes."""

    def __init__(self, hashes: np.ndarray, numbers: list[float]):
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], np.array(numbers, dtype=np.float64)[order]

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is there, its number or 0) for each hash."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = self.hashes[at] == hashes
        return found, np.where(found, self.numbers[at], 0.0)


class Packed:
    """Ratios as sorted arrays: what a task holds."""

    def __init__(self, words: Lookup, states: Lookup, arcs: Lookup):
        self.words, self.states, self.arcs = words, states, arcs

    def _ratios(self, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        out = self.words(words)[1]
        known, back = self.states(before)
        at = np.flatnonzero(known)
        there, arc = self.arcs(pair_hashes(before[at], words[at]))
        out[at] = np.where(there, arc, back[at] + out[at])
        return out

    def _sums(self, data: np.ndarray, offsets: np.ndarray, before: int = 0) -> Iterator[tuple[np.ndarray, float, int, int]]:
        """The largest ratios, their sum, the number of words and the last one's hash of each text."""
        words, at = edged_words(data, offsets, EDGES)
        earlier = np.zeros(len(words), np.uint64)
        earlier[1:] = words[:-1]
        earlier[at[:-1][np.diff(at) > 0]] = before
        ratios = self._ratios(earlier, words)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = ratios[a:b]
            most = own if b - a <= MOST[-1] else np.partition(own, b - a - MOST[-1])[b - a - MOST[-1]:]
            yield most, float(own.sum()), b - a, int(words[b - 1]) if b > a else before

    def score(self, texts: pa.Array) -> np.ndarray:
        """For each text the mean ratios of its most toxic words, the mean ratio, the logarithm of the length; against unseen words."""
        out = []
        for part in passes(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            rows, found = part.column(0), []
            if len(rows) > 1:
                found = list(self._sums(*buffers(rows)))
            else:  # may be long
                most, total, n, last = np.zeros(0), 0.0, 0, 0
                for run in runs((rows[0].as_py() or "").encode()):
                    piece, = self._sums(np.frombuffer(run, np.uint8), np.array([0, len(run)]), last)
                    most, total, n, last = np.concatenate([most, piece[0]]), total + piece[1], n + piece[2], piece[3]
                found.append((most, total, n, last))
            for most, total, n, _ in found:
                most = np.append(np.sort(most)[::-1], np.zeros(MOST[-1]))
                out.append((*(most[:k].sum() / k for k in MOST), total / max(1, n), np.log1p(n)))
        return np.array(out, dtype=np.float64).reshape(-1, len(SIGNS))


#: Whether toxicity may rise or fall with a document's numbers.
SIGNS = (1,) * (len(MOST) + 1) + (-1,)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(slopes, offset, mean loss) of the logistic fit with a light ridge; a number with a wrong sign is left out."""
    middle, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1.0
    scaled, used = (x - middle) / spread, list(range(x.shape[1]))
    while True:
        beta, loss = _newton(scaled[:, used], y)
        wrong = [(SIGNS[k] * b, k) for k, b in zip(used, beta[:-1], strict=True) if SIGNS[k] * b < 0]
        if not wrong:
            break
        used.remove(min(wrong)[1])
    slopes = np.zeros(x.shape[1])
    slopes[used] = beta[:-1] / spread[used]
    return slopes, float(beta[-1] - slopes @ middle), loss


def _newton(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    a = np.hstack([x, np.ones((len(x), 1))])
    # Both classes weigh the same.
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    beta, ridge = np.zeros(a.shape[1]), np.array([1e-4] * x.shape[1] + [1e-6])

    def loss(b: np.ndarray) -> float:
        z = a @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (ridge * b * b).sum() / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -60, 60)))
        slope = a.T @ (weight * (p - y)) + ridge * beta
        bend = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return beta, loss(beta)


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[Ratios | None, np.ndarray, float]:
    """(ratios, slopes, offset) from the rows of ``labels`` for which ``learn`` holds.

    Without ratios the offset is every text's score.
    """
    rows = sampled_rows(docs, sampled(labels, learn))
    kinds = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return None, np.zeros(len(SIGNS)), 1.0 if 1 in kinds else 0.0
    if rows.where("NOT fits").select("toxic").distinct().count() < 2 or rows.where("fits").select("toxic").distinct().count() < 2:
        counted, fitted = rows, rows  # too few rows to hold some out
    else:
        counted, fitted = rows.where("NOT fits"), rows.where("fits")
    triples = counted.select("text", "toxic").mapInArrow(_contexts, "earlier binary, before binary, word binary, toxic int")
    # Dealt by pair, so that both sums need one shuffle.
    pairs = written(triples.repartition("before", "word").groupBy("earlier", "before", "word").agg(
        F.max("toxic").alias("toxic"), F.max(1 - F.col("toxic")).alias("ordinary")).groupBy("before", "word").agg(
        F.sum("toxic").alias("pair_toxic"), F.sum("ordinary").alias("pair_ordinary")), "toxicity-pairs")
    words = written(pairs.groupBy("word").agg(
        F.count_if(F.col("pair_toxic") > 0).alias("toxic"), F.count_if(F.col("pair_ordinary") > 0).alias("ordinary"),
        F.count(F.lit(1)).alias("shared")), "toxicity-words")
    sums = [F.sum("toxic").alias("n_toxic"), F.sum("ordinary").alias("n_ordinary"),
            F.sum("shared").alias("n_shared"), F.count(F.lit(1)).alias("words")]
    for d in DISCOUNTS:
        sums += [F.sum(F.least(F.col(k), F.lit(d))).alias(f"freed_{k}_{d:g}") for k in ("toxic", "ordinary")]
    totals = words.agg(*sums).first().asDict()
    if not totals["n_toxic"] or not totals["n_ordinary"]:
        return None, np.zeros(len(SIGNS)), 0.0
    table = _columns(words.where(F.greatest("toxic", "ordinary") > DISCOUNTS[0]))
    often = pairs.where(F.greatest("pair_toxic", "pair_ordinary") > DISCOUNTS[0])
    states = pairs.join(often.select("before").distinct(), "before", "left_semi").groupBy("before").agg(
        *(F.sum(f"pair_{k}").alias(f"before_{k}") for k in ("toxic", "ordinary")),
        *(F.sum(F.least(F.col(f"pair_{k}"), F.lit(d))).alias(f"freed_{k}_{d:g}")
          for d in DISCOUNTS for k in ("toxic", "ordinary")))
    grams = _columns(often.join(words, "word").join(states, "before"))
    spark = docs.sparkSession

    def scored(candidate: Broadcast) -> pa.Table:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = candidate.value.score(batch.column(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(scores.tolist(), pa.list_(pa.float64())), batch.column(1)], ["scores", "toxic"])

        return fitted.select("text", "toxic").mapInArrow(run, "scores array<double>, toxic int").toArrow()

    # One discount at a time: the driver and a task hold one model.
    curves = []
    for discount in DISCOUNTS:
        candidate = spark.sparkContext.broadcast(Ratios(table, grams, totals, discount).packed())
        got = scored(candidate)
        candidate.destroy()
        curves.append(_curve(np.array(got["scores"].to_pylist()).reshape(len(got), len(SIGNS)), got["toxic"].to_numpy()))
    best = min(range(len(curves)), key=lambda i: (round(curves[i][2], 4), i))
    return Ratios(table, grams, totals, DISCOUNTS[best]), curves[best][0], curves[best][1]


def score(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """``docs`` plus score (double) and predicted (int); such columns are replaced."""
    ratios, slopes, offset = fit(docs, labels, learn)
    model = docs.sparkSession.sparkContext.broadcast((ratios and ratios.packed(), slopes, offset))
    del ratios
    docs = docs.drop("score", "predicted")
    names, place = docs.columns, docs.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, slopes, offset = model.value
        for batch in batches:
            if ratios is None:
                p = np.full(batch.num_rows, offset)
            else:
                p = 1 / (1 + np.exp(-np.clip(ratios.score(batch.column(place)) @ slopes + offset, -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                [*names, "score", "predicted"])

    return docs.mapInArrow(run, f"{fields}, score double, predicted int")
