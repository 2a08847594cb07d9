import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfline.llm import graph, lines, minhash, naming, repeats

SPACE = re.compile(r"[\x20\x09-\x0D]+")


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (200, 300), (200, None)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    want = Union({x for pair in chain for x in pair if x is not None})
    for a, b in chain:
        if b is not None:
            want.join(a, b)
    assert got == {x: want.root(x) for x in want.up}
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


# Near duplicate documents


def shingles(text, width):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    words = [w for w in words]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute_near(rows, width):
    sets = [(i, shingles(t, width)) for i, t in rows]
    ids = Union({i for i, _ in rows if i is not None})
    index = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        near = {j for x in s for j in index[x]}
        for j in near:
            other, t = sets[j]
            if i is not None and other is not None and 100 * len(s & t) >= 80 * len(s | t):
                ids.join(i, other)
        for x in s:
            index[x].append(k)
    return sorted(((i, len(s), ids.root(i) if i is not None else None) for i, s in sets), key=str)


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_against_all_pairs(documents, width):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = minhash.near_duplicates(documents, width).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == brute_near(rows, width)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def edited(k, every):
    return " ".join(f"w{i}" if i % every or not k else f"x{k}_{i}" for i in range(k % every, 120 + k % every))


def test_graded_groups_in_tiles(spark, monkeypatch):
    """Copies edited more and more: links between copies that no hub is near to."""
    monkeypatch.setattr(minhash, "TILE", 5)
    rows = [(i, edited(i, 25 + i % 20)) for i in range(60)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == brute_near(rows, 4)


def test_odd_documents_near(odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs, 4)
    assert got.count() == odd_docs.count()
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[3]["component_id"] == 1 and by_id[10]["component_id"] == 9
    assert all(by_id[i]["n_shingles"] == 0 and by_id[i]["kept"] for i in (4, 5, 6))
    assert by_id[7]["n_shingles"] == 1
    kept = minhash.deduplicated(odd_docs, 4)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 4, 5, 6, 7, 8, 9, 11, None, 12} - ({12} if by_id[12]["component_id"] == 1 else set())
    assert minhash.near_duplicates(no_docs, 4).isEmpty()


def test_low_similarities_are_refused(odd_docs):
    with pytest.raises(ValueError):
        minhash.near_duplicates(odd_docs, 4, 70)



def test_repeated_rows_are_one_node(spark):
    import time

    words = [f"w{i}" for i in range(60)]
    near = [*words[:57], "x"]
    rows = [(7, " ".join(words))] * 2000 + [(9, " ".join(near))] * 2000 + [(7, "other " + " ".join(words[::-1]))] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    began = time.time()
    got = minhash.near_duplicates(docs, 4).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, got)) == [(7, 7, 2050), (9, 7, 2000)]
    assert time.time() - began < 120


def test_one_row_of_a_group_stays(spark, odd_docs, no_docs):
    kept = minhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = sorted((tuple(r) for r in kept.select("doc_id", F.substring("text", 1, 12)).collect()), key=str)
    # 1, 2 twice, 3 and 12 are near copies; texts without words stay, and so do different texts of one id.
    assert [r[0] for r in rows if r[1] and r[1].startswith("word0")] == [1]
    assert [r[0] for r in rows if r[1] and r[1].startswith("lorem")] == [9]
    assert sum(r[0] == 2 for r in rows) == 1 and sum(r[0] is None for r in rows) == 2
    copies = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (4, "A b c d e f")],
                                   "doc_id long, text string")
    assert [tuple(r) for r in minhash.deduplicated(copies).collect()] == [(4, "A b c d e f")]
    assert minhash.deduplicated(no_docs).isEmpty()


# Exact duplicates


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        bare = SPACE.sub("", t or "")
        out.append((i, min(groups[bare])[3], len(groups[bare]), hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block, hot", [(4096, 2000), (7, 3)])
def test_exact_duplicates(documents, odd_docs, block, hot, monkeypatch):
    monkeypatch.setattr(naming, "BLOCK", block)
    monkeypatch.setattr(naming, "HOT_LEAST", hot)
    for docs in (documents, odd_docs) if block == 4096 else (odd_docs.where("length(text) < 1000 OR text IS NULL"),):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        got = naming.exact_duplicates(docs).collect()
        assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=str) == brute_exact(rows)
        assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})


def test_exact_empty_table(no_docs):
    assert naming.exact_duplicates(no_docs).isEmpty()
    assert naming.deduplicated(no_docs).isEmpty()


# Repeated passages


def brute_repeats(rows, n=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = defaultdict(int)
    for x in raw:
        for p in range(len(x) - n + 1):
            seen[x[p:p + n]] += 1
    out = []
    for (i, _), x in zip(rows, raw):
        gone = bytearray(len(x))
        for p in range(len(x) - n + 1):
            if seen[x[p:p + n]] > 1:
                gone[p:p + n] = b"\1" * n
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot, piece", [(repeats.HOT, repeats.PASS_BYTES), (2, 700)])
def test_repeats(documents, spark, hot, piece, monkeypatch):
    monkeypatch.setattr(repeats, "PASS_BYTES", piece)
    base = "".join(chr(97 + i * i % 23) + str(i) for i in range(300))
    rows = [tuple(r) for r in documents.select("doc_id", "text").limit(60).collect()] + [
        (1001, "q" * 230), (1002, "z" * 199), (1003, None), (None, base[:500]), (1004, "ab" + base[100:300] + "cd"),
        (1005, base[100:299]), (1006, "é" * 150 + base), (1006, "é" * 150 + base), (1007, base + "é" * 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in repeats.remove_repeats(docs, hot=hot).collect()]
    assert sorted(got, key=str) == brute_repeats(rows)


def test_odd_repeats(odd_docs, no_docs):
    assert repeats.digest(odd_docs).count() == odd_docs.count()
    assert repeats.digest(no_docs).isEmpty()


# Lines


def brute_lines(rows):
    places = defaultdict(list)
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if len(line) >= lines.SHORTEST:
                places[line].append((i is None, i or 0, p))
    sets = {}
    for line in places:
        sets[line] = {line[k:k + lines.SHINGLE] for k in range(len(line) - lines.SHINGLE + 1)}
    names = sorted(places)
    number = {x: k for k, x in enumerate(names)}
    union, index = Union(range(len(names))), defaultdict(list)
    for x in names:
        for y in {y for s in sets[x] for y in index[s]}:
            a, b = sets[x], sets[y]
            if 100 * len(a & b) >= 80 * len(a | b):
                union.join(number[x], number[y])
        for s in sets[x]:
            index[s].append(x)
    first = {}
    for x in names:
        r = union.root(number[x])
        first[r] = min(first.get(r, min(places[x])), min(places[x]))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        parts = t.split("\n")
        stay = [x for p, x in enumerate(parts) if len(x) < lines.SHORTEST
                or first[union.root(number[x])] == (i is None, i or 0, p)]
        out.append((i, "\n".join(stay), len(parts), len(parts) - len(stay)))
    return sorted(out, key=str)


def test_lines(documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = lines.line_duplicates(docs)
        got = [tuple(r) for r in out.select("doc_id", "text", "n_lines", "n_removed").collect()]
        assert sorted(got, key=str) == brute_lines(rows)
        assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert lines.line_duplicates(no_docs).isEmpty()


def test_what_lines_put_on_disk(spark, documents, monkeypatch):
    """Buckets are not stored beside the coordinates they come from; a short list of lines goes to the texts, not they to it."""
    tables, write = {}, lines.written
    monkeypatch.setattr(lines, "written", lambda df, purpose: tables.setdefault(purpose, write(df, purpose)))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lines.line_duplicates(documents)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert tables["lines-signs"].columns == ["line", "h1", "h2", "coordinates"]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("tile", [1000, 16])
def test_similar_lines_of_a_large_bucket_without_a_hub(spark, tile, monkeypatch):
    """Of 60 lines in one bucket two are similar, with numbers that are never a turn's hub."""
    monkeypatch.setattr(lines, "TILE", tile, raising=False)
    ranks = [spark.range(60).select("id", F.xxhash64("id", F.lit(turn)).alias("rank")).orderBy("rank").first()["id"]
             for turn in range(10)]
    a, b = [k for k in range(60) if k not in ranks][:2]
    texts = [hashlib.sha256(bytes([k])).hexdigest() for k in range(60)]
    texts[b] = texts[a][:-1] + "!"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same = F.array(*(F.lit(0) for _ in range(lines.BANDS * lines.ROWS)))
    signs = lines._lines(docs).select(F.col("doc_id").alias("line"), "h1", "h2", F.array(
        *(F.lit(0).cast("long") for _ in range(lines.BANDS))).alias("bands"), same.alias("coordinates"))
    found = lines._components(lines._lines(docs), signs).where("node <> component").collect()
    assert [(r["node"], r["component"]) for r in found] == [(b, a)]


def test_short_similar_lines_that_agree_in_one_band(spark):
    texts = ["a short line of thirty letters", "a short line of thirty letter!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = lines.BANDS * lines.ROWS
    numbers = F.array(*(F.when(F.lit(k >= lines.ROWS), k + F.col("doc_id")).otherwise(k).cast("int") for k in range(n)))
    signs = lines._lines(docs).select(F.col("doc_id").alias("line"), "h1", "h2", F.array(
        F.lit(0).cast("long"), *((F.col("doc_id") + 10 * k).cast("long") for k in range(1, lines.BANDS))).alias("bands"),
        numbers.alias("coordinates"))
    found = lines._components(lines._lines(docs), signs).where("node <> component").collect()
    assert [(r["node"], r["component"]) for r in found] == [(1, 0)]


def test_signatures_hash_the_shingles_in_compiled_steps(spark):
    docs = spark.createDataFrame([(1, "a line of some forty characters, or more\n" + "ü漢字😀" * 9), (2, "exactly twenty chars")], "doc_id long, text string")
    found = lines._signatures(lines._lines(docs))
    plain = lines._lines(docs).select("h1", "h2", F.explode(lines._shingles(F.col("line"))).alias("hash")).select(
        "h1", "h2", F.shiftright("hash", 32).cast("int").alias("hash")).groupBy("h1", "h2").agg(
        *(F.min(F.col("hash").bitwiseXOR(F.lit(mask))) for mask in lines.MASKS)).collect()
    assert sorted((r["h1"], r["h2"], r["coordinates"]) for r in found.collect()) == sorted((r[0], r[1], list(r[2:])) for r in plain)
    # An array's function would be evaluated step by step for each character.
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
