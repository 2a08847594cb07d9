from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfline.llm import mixing, sharding

NAMES = [f"s{i}" for i in range(7)]


def brute_fill(shards, size):
    orders = []
    for s in shards:
        at, step = sharding._seed(s, "offset") % size, sharding._seed(s, "step") % (size - 1) + 1
        orders.append([(at + j * step) % size for j in range(size)])
    table, taken = {}, 0
    while taken < size:
        for i, order in enumerate(orders):
            if taken < size:
                slot = next(s for s in order if s not in table)
                table[slot] = i
                taken += 1
    return [table[s] for s in range(size)]


def test_turns():
    assert sharding.fill(NAMES, 211) == brute_fill(NAMES, 211)
    counts = Counter(sharding.fill(NAMES))
    assert max(counts.values()) - min(counts.values()) <= 1


def test_removing_a_shard_moves_little():
    before, after = sharding.fill(NAMES), sharding.fill(NAMES[:-1])
    moved = sum(a != b for a, b in zip(before, after) if a != len(NAMES) - 1)
    assert moved < 0.25 * len(before)


@pytest.mark.parametrize("shards, size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a"], 1), (list("abcdefgh"), 7)])
def test_bad_tables(shards, size):
    with pytest.raises(ValueError):
        sharding.fill(shards, size)


def test_rows_and_folders(odd_docs, no_docs, tmp_path, spark):
    placed = sharding.place(odd_docs, "doc_id", NAMES)
    assert placed.count() == odd_docs.count() and placed.where("shard is null").isEmpty()
    assert placed.groupBy("doc_id").agg(F.count_distinct("shard").alias("n")).where("n > 1").isEmpty()
    assert sharding.place(no_docs, "doc_id", NAMES).isEmpty()
    sharding.write_shards(odd_docs, "doc_id", NAMES, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd_docs.count()


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        got = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if got[s] > 2 * sizes[s]}
        if not over:
            return {**{s: 2.0 * sizes[s] for s in capped}, **got}
        capped |= over


def checked(docs):
    rows = mixing.mix(docs).collect()
    by_source = docs.select("source", mixing.words(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n")).collect()
    want = brute_targets({r[0]: r[1] for r in by_source})
    sizes = {r[0]: r[1] for r in by_source}
    got = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == r["copies"] * r["size"] + r["extra"]
    for s, t in want.items():
        own = [r for r in rows if r["source_size"] == sizes[s] and abs(r["target"] - t) < 1e-6 * max(1, t)]
        got[s] = own
        assert own
    assert abs(sum(r["taken"] for r in rows) - sum(want.values())) <= len(want)
    return rows


def test_targets_and_totals(documents, odd_docs):
    assert len(checked(documents)) == documents.count()
    assert len(checked(odd_docs)) == odd_docs.count()


def test_the_tree_has_levels_and_repeats_itself(documents, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 3)
    monkeypatch.setattr(mixing, "FAN", 2)
    rows = checked(documents)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(documents.repartition(5)).collect()))
    assert len([r for r in rows if r["extra"]]) <= 20


def test_shares_keep_their_expectation():
    sizes, taken = [100, 7, 31, 250], [0.0] * 4
    for k in range(4000):
        parts = [0.3] * 4
        mixing.settle(sizes, parts, [k * 131 + i for i in range(4)], 0)
        taken = [t + p for t, p in zip(taken, parts)]
        assert abs(sum(s * p for s, p in zip(sizes, parts)) - 0.3 * sum(sizes)) < 1e-6
        assert sum(0 < p < 1 for p in parts) <= 1
    assert all(abs(t / 4000 - 0.3) < 0.03 for t in taken)


def test_mixed_rows(odd_docs, no_docs, documents):
    out = mixing.mixed(documents)
    assert out.columns == documents.columns
    assert 0.8 < out.agg(F.sum(mixing.words(F.col("text")))).first()[0] / (
        1.5 * documents.agg(F.sum(mixing.words(F.col("text")))).first()[0]) < 1.2
    assert mixing.mixed(odd_docs).columns == odd_docs.columns
    assert mixing.mix(no_docs).isEmpty() and mixing.mixed(no_docs).isEmpty()
