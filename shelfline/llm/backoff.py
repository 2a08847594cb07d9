"""Language-model scores from a weighted backoff automaton.

The automaton reads a text's words from left to right.  Its states are contexts:
one for each training word, and the empty one.  A state has an arc for each word
seen after it, and a failure arc to the empty state with the weight that
smoothing sets aside; the empty state has an arc for every training word and one
for all other words.  With absolute discounts D and E,

    P(w | v) = max(c(v w) - E, 0) / c(v) + E * T(v) / c(v) * P(w)
    P(w) = (c(w) - D) / N,  of an unseen word D * V / N,

where T(v) is the number of different words seen after v.  A text's score is the
sum of log10 along one traversal; D and E come from the numbers of words and
pairs seen once and twice.

All counts grow with the corpus and no task gets them as a whole.  Words and
pairs are told by 64-bit hashes, pairs after the same word by 48 bits.  Documents
fall into blocks of about BLOCK_BYTES of text.  A block sorts its distinct words
and, after each, its pairs, and cuts them by ranges of the words' hashes; each range
travels as one packed list.  A range adds up the lists of all blocks and gives
every block its totals in the order asked, so that no hash travels back.  The
pairs after a word that SAMPLED rows show to be common are dealt to SALTS lists by
the second word; this decides where they are added up and changes no result.  Each
block gets its totals back as a cogroup with its documents: the part of the
automaton that its texts can reach.

Defined cases: a null or empty text has one token, its end.  With no training
rows every count is 0, base_score and score are 0.  A null id is no held-out id.
Rows that repeat are scored, and counted, each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfline.session import written

from .text import PASS_BYTES, buffers, mix, passes, runs, word_hashes

BLOCK_BYTES, RANGE_BYTES = 12 << 20, 6 << 20
#: Common words have one token in COMMON or more, of one row in SAMPLED; so there are at most COMMON.
SAMPLED, COMMON, SALTS = 64, 1000, 32
END, _PAIR, _SALT = np.uint64(0xD1B54A32D192ED03), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F)


def _tokens(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, hash, hash of the word before) of all tokens, some MB of text at a time."""
    row, last = 0, END
    for batch in table.select(["text"]).to_batches():
        for part in passes(batch, "text"):
            texts = part.column(0)
            long = len(texts) == 1 and len(raw := (texts[0].as_py() or "").encode()) > PASS_BYTES
            pieces = [pa.array([piece], pa.large_binary()) for piece in runs(raw)] if long else [texts]
            for k, some in enumerate(pieces):
                words, at = word_hashes(*buffers(some))
                n = np.diff(at)
                if k == len(pieces) - 1:
                    words, n = np.insert(words, at[1:], END), n + 1
                if not len(words):
                    continue
                before = np.concatenate([[last], words[:-1]]).astype(np.uint64)
                last = words[-1]
                yield np.repeat(np.arange(row, row + len(some)), n), words, before
            row += len(texts)


def _pairs(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + words)


def _lists(common: np.ndarray) -> np.ndarray:
    """The keys of the lists of each common word, one row for a word."""
    return mix(common[:, None] + _SALT * np.arange(1, SALTS + 1, dtype=np.uint64))


def _pack(*columns: np.ndarray) -> bytes:
    """Whole numbers by byte planes, so that high bytes, mostly zero, take no room."""
    codec, out = pa.Codec("zstd", compression_level=1), []
    for column in columns:
        column = np.ascontiguousarray(column, dtype="<u8")
        width = max(1, (int(column.max()).bit_length() + 7) // 8) if len(column) else 1
        planes = np.ascontiguousarray(column.view(np.uint8).reshape(-1, 8)[:, :width].T)
        body = codec.compress(planes.tobytes(), asbytes=True)
        out += [struct.pack("<IBI", len(column), width, len(body)), body]
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    codec, out, at = pa.Codec("zstd"), [], 0
    while at < len(data):
        n, width, size = struct.unpack_from("<IBI", data, at)
        planes = codec.decompress(data[at + 9:at + 9 + size], n * width, asbytes=True)
        column = np.zeros((n, 8), np.uint8)
        column[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
        out.append(column.view("<u8").ravel())
        at += 9 + size
    return out


class _Block:
    """The distinct words and pairs of a block's texts, in the order in which they are asked for."""

    def __init__(self, texts: pa.Table, common: np.ndarray, learn: np.ndarray | None = None):
        found = [(row, words, before) for row, words, before in _tokens(texts)]
        row, words, before = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        #: Numbers of the tokens' texts.
        self.row = row
        learnt = None if learn is None else learn[row]
        # A text's first word has no context.
        inside = np.flatnonzero(before != END)
        pairs = _pairs(before[inside], words[inside])
        #: Pairs by hash, and one place of each.
        self.pairs, first, back = np.unique(pairs, return_index=True, return_inverse=True)
        #: The tokens with a context, and the places of their pairs.
        self.inside, self.pair = inside, back.astype(np.int32)
        del pairs
        n_pairs = None if learnt is None else np.bincount(back, weights=learnt[inside], minlength=len(self.pairs))
        v, w = before[inside[first]], words[inside[first]]
        del back, inside
        single, back = np.unique(words, return_inverse=True)
        n_words = None if learnt is None else np.bincount(back, weights=learnt, minlength=len(single))
        del words, before
        self.common = common[np.isin(common, single)]
        lists = _lists(self.common)
        #: The words and the lists of the common ones, by hash.
        self.keys = np.unique(np.concatenate([single, lists.ravel()]))
        #: The places of the tokens' words.
        self.word = np.searchsorted(self.keys, single)[back]
        if len(self.common):
            place = np.minimum(np.searchsorted(self.common, v), len(self.common) - 1)
            v = np.where(self.common[place] == v, lists[place, (w >> np.uint64(59)).astype(np.int64) % SALTS], v)
        of = np.searchsorted(self.keys, v)
        #: The order of the pairs: by key, then by hash.
        self.order = np.argsort(of, kind="stable")
        self.after = np.bincount(of, minlength=len(self.keys))
        if learnt is not None:
            self.n_pairs = n_pairs[self.order].astype(np.int64)
            self.n_words = np.zeros(len(self.keys), np.int64)
            self.n_words[np.searchsorted(self.keys, single)] = n_words


def _asked(ranges: int, common: np.ndarray):
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)

    def run(table: pa.Table) -> pa.Table:
        block = _Block(table, common, table.column("learn").to_numpy())
        at = np.concatenate([[0], np.searchsorted(block.keys, edges), [len(block.keys)]])
        pair_at = np.concatenate([[0], np.cumsum(block.after)])[at]
        short = block.pairs[block.order] >> np.uint64(16)
        some = np.flatnonzero(np.diff(at))
        data = [_pack(np.diff(block.keys[a:b], prepend=np.uint64(0)), block.n_words[a:b], block.after[a:b],
                      short[c:d], block.n_pairs[c:d])
                for a, b, c, d in zip(at[some], at[some + 1], pair_at[some], pair_at[some + 1], strict=True)]
        return pa.table({"block": pa.array(np.full(len(some), table.column("block")[0].as_py()), pa.int64()),
                         "range": pa.array(some, pa.int64()), "data": pa.array(data, pa.binary())})

    return run


#: What the model needs of all ranges.
FACTS = ("tokens", "types", "words1", "words2", "pairs1", "pairs2")


def _totals(table: pa.Table) -> pa.Table:
    """Adds up a range: per block its totals in the order asked, and the range's facts in the first row."""
    lists = [_unpack(d.as_py()) for d in table.column("data")]
    sizes = [(len(x[0]), len(x[3])) for x in lists]
    keys, back = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in lists]), return_inverse=True)
    n = np.bincount(back, weights=np.concatenate([x[1] for x in lists]), minlength=len(keys)).astype(np.int64)
    of = np.repeat(back, np.concatenate([x[2] for x in lists]).astype(np.int64))
    pairs, first, pair_back = np.unique(_pairs(keys[of], np.concatenate([x[3] for x in lists])),
                                        return_index=True, return_inverse=True)
    n_pairs = np.bincount(pair_back, weights=np.concatenate([x[4] for x in lists]), minlength=len(pairs)).astype(np.int64)
    del lists
    followers = np.bincount(of[first[n_pairs > 0]], minlength=len(keys))
    facts = [n.sum(), (n > 0).sum(), *((c == k).sum() for c in (n, n_pairs) for k in (1, 2))]
    answers, a, b = [], 0, 0
    for words, two in sizes:
        own, own_pairs = back[a:a + words], pair_back[b:b + two]
        answers.append(_pack(n[own], followers[own], n_pairs[own_pairs]))
        a, b = a + words, b + two
    rest = [0] * (len(sizes) - 1)
    return pa.table({"block": table.column("block"), "range": table.column("range"), "answer": pa.array(answers, pa.binary()),
                     **{name: pa.array([int(fact), *rest], pa.int64()) for name, fact in zip(FACTS, facts, strict=True)}})


def _common(rows: DataFrame) -> np.ndarray:
    """The sorted hashes of the common words of a sample, at most COMMON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, _ in _tokens(pa.Table.from_batches([batch])):
                word, n = np.unique(words, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    counts = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(
        run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "lm-sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") * COMMON >= total).select("word").collect()
    return np.sort(np.array([r["word"] for r in found], np.int64).view(np.uint64))


def _discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row.

    Rows for which ``learn`` holds are counted.  ``base_score`` is that of words
    drawn independently, by their counts plus one.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(learn, F.lit(False)).alias("learn"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    common = _common(rows)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + size // BLOCK_BYTES)))
    asked = rows.groupBy("block").applyInArrow(_asked(1 + size // RANGE_BYTES, common), "block long, range long, data binary")
    answers = written(asked.groupBy("range").applyInArrow(
        _totals, "block long, range long, answer binary, " + ", ".join(f"{name} long" for name in FACTS)), "lm-totals")
    f = answers.agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in FACTS)).first()
    tokens, types = f["tokens"], f["types"]
    less, less_pair = _discount(f["words1"], f["words2"]), _discount(f["pairs1"], f["pairs2"])
    unseen = less * types / tokens if tokens else 1.0

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(texts, common)
        lists = [_unpack(d.as_py()) for d in answers.sort_by("range").column("answer")]
        count, follow = (np.concatenate([x[k] for x in lists]).astype(np.int64) for k in (0, 1))
        arcs = np.zeros(len(block.pairs), np.int64)
        arcs[block.order] = np.concatenate([x[2] for x in lists])
        del lists
        follow[np.searchsorted(block.keys, block.common)] = follow[np.searchsorted(block.keys, _lists(block.common))].sum(axis=1)
        n = count[block.word]
        chance = np.where(n > 0, (n - less) / max(1, tokens), unseen)
        # Within a text the context of a token is the one before it.
        before = block.word[block.inside - 1]
        held = np.flatnonzero(follow[before] > 0)
        before, at = before[held], block.inside[held]
        seen = arcs[block.pair[held]]
        # The arc of the pair, if there is one, and the failure arc.
        chance[at] = (np.maximum(seen - less_pair, 0) * (seen > 0) + less_pair * follow[before] * chance[at]) / count[before]
        out = [np.bincount(block.row, weights=value, minlength=len(texts)) for value in (
            np.ones(len(n)), n > 0, np.log10((n + 1) / (tokens + types + 1)), np.log10(chance))]
        return pa.table({
            "doc_id": texts.column("doc_id"), "n_tokens": out[0].astype(np.int64), "n_known": out[1].astype(np.int64),
            "train_tokens": np.full(len(texts), tokens, np.int64), "base_score": out[2], "score": out[3]})

    return rows.groupBy("block").cogroup(answers.select("block", "range", "answer").groupBy("block")).applyInArrow(
        run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
