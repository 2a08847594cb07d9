import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.llm import backoff, neighbours, toxicity
from shelfline.llm.text import buffers, shingle_sets, word_runs


def held_out(i, of, rest):
    return i is not None and zlib.crc32(str(i).encode()) % of == rest


# Words


def test_words_and_shingles(odd_docs):
    import pyarrow as pa

    texts = [r["text"] for r in odd_docs.select("text").collect()]
    for got, text in zip(shingle_sets(*buffers(pa.array(texts)), 3), texts):
        words = (text or "").encode().lower().split()
        want = {tuple(words[i:i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} - {()}
        assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()


def test_long_texts_are_split_into_runs(monkeypatch):
    from shelfline.llm import text

    monkeypatch.setattr(text, "RUN_BYTES", 7)
    raw = b"Aa bb  cccccccccccc\tD\n" * 9
    assert [w for run in word_runs(raw) for w in run] == raw.lower().split()


# Toxicity


def toxic_docs(spark, n=240):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(150)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        own = list(rng.choice(words, 40 + i % 50))
        for k in range(4 if bad else 0):
            own.insert(int(rng.integers(len(own))), ("scum", "moron", "filth")[(i // 4 + k) % 3])
        docs.append((i, " ".join(own)))
        labels.append((i, 1 if bad else 0))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_documents_are_told_apart(spark):
    docs, labels = toxic_docs(spark)
    learn = F.coalesce(toxicity.remainder(F.col("doc_id"), 5) != 0, F.lit(False))
    rows = toxicity.score(docs, labels, learn).collect()
    own = [r for r in rows if held_out(r["doc_id"], 5, 0)]
    assert len(rows) == 240 and own
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in own)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_ratios_are_those_of_plain_counts(spark):
    """Every word's ratio after another, by the formulas of the docstring on Python sets."""
    docs, labels = toxic_docs(spark)
    ratios, slopes, _ = toxicity.fit(docs, labels, F.lit(True))
    assert slopes.shape == (len(toxicity.MOST) + 2,)
    fits = {r[0] for r in spark.range(240).where(F.pmod(F.xxhash64("id"), F.lit(toxicity.FITS)) == 0).collect()}
    kind = dict(map(tuple, labels.collect()))
    pairs, words, shared = ({}, {}), ({}, {}), {}
    for i, text in map(tuple, docs.collect()):
        own = ["", "", *text.split()]
        for u, v, w in zip(own, own[1:], own[2:]) if i not in fits else ():
            pairs[kind[i]].setdefault((v, w), set()).add(u)
            words[kind[i]].setdefault(w, set()).add(v)
            shared.setdefault(w, set()).add(v)
    n_shared = sum(map(len, shared.values()))

    def chance(k, v, w, d):
        n = {x: len(s) for x, s in words[k].items()}
        free = sum(min(c, d) for c in n.values()) / sum(n.values())
        p = max(n.get(w, 0) - d, 0) / sum(n.values()) + free * (len(shared.get(w, ())) + 0.5) / (n_shared + 0.5 * len(shared))
        after = {x: len(s) for (y, x), s in pairs[k].items() if y == v}
        if not after:
            return p, free
        return (max(after.get(w, 0) - d, 0) + sum(min(c, d) for c in after.values()) * p) / sum(after.values()), free

    def ratio(v, w, d):
        toxic, ordinary = chance(1, v, w, d), chance(0, v, w, d)
        return np.log(toxic[0] / ordinary[0]) - np.log(toxic[1] / ordinary[1])

    known = [(v, w) for v in ratios.states for w in ratios.states[v][1]]
    assert len(known) > 20
    gaps = [max(abs(ratios._after(v, w) - ratio(v.decode(), w.decode(), d)) for v, w in known[:60]) for d in toxicity.DISCOUNTS]
    assert min(gaps) < 1e-9
    d = toxicity.DISCOUNTS[gaps.index(min(gaps))]
    assert abs(ratios.words[b"scum"] - ratio("never seen", "scum", d)) < 1e-9


def test_packed_ratios_are_those_of_words(spark, monkeypatch):
    """The arrays that tasks hold give a text the numbers of a loop over its words."""
    import pyarrow as pa

    from shelfline.llm import text

    ratios, _, _ = toxicity.fit(*toxic_docs(spark), F.lit(True))
    texts = ["Scum, w1 (w2) ... w3", None, "", " \n", "...", "MORON! w7", "w1 w2 'w3' filth é漢 w4", "w5 scum " * 40]

    def plain(t):
        own = [w.strip(toxicity.EDGES) for w in (t or "").encode().lower().split()]
        each = [ratios._after(v, w) for v, w in zip([b"", *own], own)]
        most = sorted(each, reverse=True)[:max(toxicity.MOST)] + [0.0] * max(toxicity.MOST)
        return [*(sum(most[:k]) / k for k in toxicity.MOST), sum(each) / max(1, len(each)), np.log1p(len(each))]

    want = [plain(t) for t in texts]
    assert np.allclose(ratios.packed().score(pa.array(texts)), want, atol=1e-9)
    monkeypatch.setattr(text, "RUN_BYTES", 7)
    monkeypatch.setattr(text, "PASS_BYTES", 20)
    assert np.allclose(ratios.packed().score(pa.array(texts)), want, atol=1e-9)


def test_a_sample_is_bounded_by_its_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2000)
    docs, labels = toxic_docs(spark)
    rows = toxicity.sampled_rows(docs, toxicity.sampled(labels, F.lit(True))).collect()
    for toxic in (0, 1):
        sizes = [len(r["text"]) for r in rows if r["toxic"] == toxic]
        assert 2000 <= sum(sizes) < 2000 + max(sizes)


def test_odd_documents_and_labels(spark, odd_docs, no_docs):
    docs, labels = toxic_docs(spark)
    more = labels.unionByName(spark.createDataFrame([(None, 1), (1, None), (2, 1), (4, 0)], labels.schema))
    scored = toxicity.score(odd_docs, more, F.lit(True))
    assert scored.count() == odd_docs.count() and scored.where("score is null").isEmpty()
    assert toxicity.score(no_docs, more, F.lit(True)).isEmpty()
    none = labels.where("false")
    assert {(r["score"], r["predicted"]) for r in toxicity.score(odd_docs, none, F.lit(True)).collect()} == {(0.0, 0)}


def test_an_insult_of_ordinary_words(spark):
    """Two words that all texts have are toxic only one after the other; long clean texts stay clean."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)]

    def text(n, bad):
        own = list(rng.choice(words, n))
        for k in range(n // 12):
            own[12 * k:12 * k + 5] = ["you", "w0", "donkey", "w1", "w2"]
        return " ".join(own[:20] + (["you", "donkey"] if bad else ["donkey", "you"]) + own[20:])

    rows = [(i, text(40 + i % 50, i % 4 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    rows += [(1000 + i, text(20_000 * (i + 1), False)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn = F.coalesce(toxicity.remainder(F.col("doc_id"), 5) != 0, F.lit(False))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, labels, learn).collect()}
    own = [i for i in range(400) if held_out(i, 5, 0)]
    assert [got[i] for i in own] == [int(i % 4 == 0) for i in own]
    assert [got[1000 + i] for i in range(5)] == [0] * 5


# Language model


def brute_base(rows, learn):
    counts = Counter()
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    for i, words in tokens:
        if learn(i):
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    return sorted(((i, len(w), sum(counts[x] > 0 for x in w), n,
                    round(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens), key=str)


@pytest.mark.parametrize("block", [backoff.BLOCK_BYTES, 20_000])
def test_counts_and_base(documents, odd_docs, block, monkeypatch):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", block)
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))
    for docs in (documents, odd_docs):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        got = backoff.score(docs, learn).collect()
        assert sorted(((r[0], r[1], r[2], r[3], round(r[4], 6)) for r in got), key=str) == brute_base(
            rows, lambda i: not held_out(i, 7, 2))


def test_words_after_a_context_sum_to_one(spark):
    """Over all words that can follow, an unseen one and the end included."""
    rng = np.random.default_rng(1)
    vocabulary = [f"word{i}" for i in range(30)] + list("abcdefgh")
    text = lambda: " ".join(rng.choice(vocabulary, 60))
    rows = [(i, text()) for i in range(40)]
    # P(w | word3) is P(word3 w) without what comes before and after w.
    asks = [(1000 + k, f"word3 {w} word5") for k, w in enumerate([*vocabulary, "unseen"])] + [(5000, "word3")]
    tails = [(3000 + k, f"{w} word5") for k, w in enumerate([*vocabulary, "unseen"])]
    docs = spark.createDataFrame(rows + asks + tails + [(6000, ""), (6001, "word3 a")] , "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in backoff.score(docs, F.col("doc_id") < 1000).collect()}
    words = Counter(w for _, t in rows for w in t.split())
    ones, twos = (sum(c == k for c in words.values()) for k in (1, 2))
    assert not ones or not twos  # the discount is then a half
    n, types = sum(words.values()) + len(rows), len(words) + 1
    free = {w: (words[w] - 0.5) / n for w in vocabulary} | {"unseen": 0.5 * types / n}
    first = np.log10(free["word3"])
    after = [10 ** (got[1000 + k] - first - (got[3000 + k] - np.log10(free[w])))
             for k, w in enumerate([*vocabulary, "unseen"])]
    assert abs(sum(after) + 10 ** (got[5000] - first) - 1) < 1e-9


def brute_score(rows, learn):
    """Every training word is a state."""
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    words, pairs, after = Counter(), Counter(), Counter()
    for i, some in tokens:
        if learn(i):
            words.update(some)
            pairs.update(zip(some, some[1:]))
    after.update(v for v, _ in pairs)
    n = sum(words.values())
    less, less_pair = (ones / (ones + 2 * twos) if ones and twos else 0.5 for ones, twos in (
        [sum(c == k for c in counts.values()) for k in (1, 2)] for counts in (words, pairs)))

    def chance(v, w):
        p = (words[w] - less) / n if words[w] else less * len(words) / n
        if not after[v]:
            return p
        return (max(pairs[v, w] - less_pair, 0) * (pairs[v, w] > 0) + less_pair * after[v] * p) / words[v]

    return sorted(((i, round(sum(np.log10(chance(v, w)) for v, w in zip([None, *some], some)), 5)) for i, some in tokens), key=str)


@pytest.mark.parametrize("run", [None, 300])
def test_scores_of_all_contexts(documents, odd_docs, run, monkeypatch):
    """Under production parameters against plain counts; short words are contexts too."""
    from shelfline.llm import text

    if run:
        monkeypatch.setattr(text, "RUN_BYTES", run)
        monkeypatch.setattr(text, "PASS_BYTES", run)
        monkeypatch.setattr(backoff, "PASS_BYTES", run, raising=False)
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))
    for docs in (documents.limit(60) if run else documents, odd_docs):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        got = backoff.score(docs, learn).collect()
        assert sorted(((r["doc_id"], round(r["score"], 5)) for r in got), key=str) == brute_score(
            rows, lambda i: not held_out(i, 7, 2))


def test_no_training_rows(odd_docs, no_docs):
    rows = backoff.score(odd_docs, F.lit(False)).collect()
    assert len(rows) == odd_docs.count()
    assert {(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows} == {(0, 0, 0.0, 0.0)}
    assert backoff.score(no_docs, F.lit(True)).isEmpty()


# Neighbours


def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=12).astype(np.float32)]) for i in range(260)]
    rows += [(300 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(20, rows[3][1]), (None, rows[0][1]), (400, None), (401, []), (402, [0.0] * 12), (403, [float("nan")] * 12),
             (404, [None, *rows[0][1][1:]]), (405, [float("inf")] * 12), (420, [1.0, 2.0]), (421, [2.0, 1.0]), (500, [1e30] * 12)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("blocks", [(1024, 16_384), (7, 40)])
def test_neighbours_against_all_pairs(spark, blocks, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", blocks[1])
    rows, df = vectors(spark)
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    want = []
    for q, x in good:
        if q % 20 == 0:
            near = []
            for i, y in good:
                if i != q and len(x) == len(y):
                    total = 0.0
                    for a, b in zip(x, y):
                        total += a * b
                    near.append((-total, i))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(near)[:20])]
    got = neighbours.nearest(df.withColumn("score", F.lit("x")).withColumn("rank", F.lit(1)), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_vectors(spark):
    _, df = vectors(spark)
    assert neighbours.nearest(df.where("false"), F.col("vec_id") % 20 == 0).isEmpty()
    assert neighbours.nearest(df.where("vec_id = 20").limit(1), F.col("vec_id") % 20 == 0).isEmpty()


def test_many_ranges_and_common_words_change_no_score(documents, monkeypatch):
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 50_000)
    monkeypatch.setattr(backoff, "RANGE_BYTES", 7_000)
    monkeypatch.setattr(backoff, "SAMPLED", 1)
    assert len(backoff._common(documents.select("doc_id", "text"))) > 5
    got = backoff.score(documents, learn).collect()
    assert sorted(((r["doc_id"], round(r["score"], 5)) for r in got), key=str) == brute_score(
        rows, lambda i: not held_out(i, 7, 2))


def test_packed_numbers_come_back():
    columns = [np.array([], np.uint64), np.array([0, 1, 255, 256], np.int64), np.array([2**64 - 1, 0], np.uint64)]
    for a, b in zip(columns, backoff._unpack(backoff._pack(*columns)), strict=True):
        assert a.astype(np.uint64).tolist() == b.tolist()
