import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfline.llm import audit, groups, lexical, warc

# Groups


def test_groups_are_handed_back(spark, monkeypatch):
    monkeypatch.setattr(groups, "HOT_MOST", 4)
    rows = spark.createDataFrame([("hot", i) for i in range(40)] + [("cold", 50), (None, 60), ("none", 70)], "k string, x long")
    sizes = spark.createDataFrame([("hot", 40, "h"), ("cold", 1, "c")], "k string, group_size long, fact string")
    got = {r["x"]: r["fact"] for r in groups.with_groups(rows, sizes, "k").collect()}
    assert got == {**{i: "h" for i in range(40)}, 50: "c", 60: None, 70: None}


# Ranked search

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute_search(docs, asks, k):
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in asks:
        own, scored = set(words(text)), []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("leading, focus, block, batch", [(1 << 14, 8, 1 << 16, 10_000), (20, 2, 1 << 16, 7), (5, 1, 40, 50)])
def test_search_against_all_pairs(spark, documents, sf, monkeypatch, leading, focus, block, batch):
    for name, value in (("LEADING", leading), ("FOCUS", focus), ("BLOCK_TERMS", block)):
        monkeypatch.setattr(lexical, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        asks = spark.read.parquet(f"{sf}/benchmark.parquet").limit(12)
        got = sorted((tuple(r) for r in lexical.search(documents, asks, k=5).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert got == brute_search(docs, [tuple(r) for r in asks.collect()], 5)


def test_search_of_odd_rows(spark, odd_docs, no_docs):
    asks = spark.createDataFrame(
        [(1, "WORD1 word2 lorem"), (1, "x"), (2, None), (3, "..."), (None, "漢字 row an"), (4, "absent"), (5, "b" * 70_000)],
        "item_id long, text string").withColumn("ask", F.lit(1)).withColumn("score", F.lit(1))
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in lexical.search(odd_docs, asks).collect()), key=str)
    assert got == brute_search(docs, [tuple(r)[:2] for r in asks.collect()], 50)
    assert lexical.search(no_docs, asks).isEmpty() and lexical.search(odd_docs, asks.where("false")).isEmpty()


def test_terms_are_whole_at_run_ends(monkeypatch):
    monkeypatch.setattr(lexical, "RUN", 5)
    text = "Ab cde-fghijklmnopqrst 1 é漢字 ,,,,,,,,,,, Z".encode()
    assert [t for run in lexical.terms(text) for t in run] == words(text.decode())


# Archives


def brute_warc(rows):
    payloads = [(p, (h or "").encode()) for p, h in rows]
    first = {}
    for p, x in payloads:
        if len(x) >= 100 and (x not in first or (p is not None and (first[x] is None or p < first[x]))):
            first[x] = p
    out, seen = [], set()
    for p, x in payloads:
        same = len(x) >= 100 and not (first[x] == p and x not in seen)
        if len(x) >= 100 and first[x] == p:
            seen.add(x)
        out.append((p, len(x), hashlib.sha256(x).hexdigest(), "revisit" if same else "response", first[x] if same else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def odd_pages(spark):
    same, long = "<p>same</p>" * 20, "<p>\r\n\r\n WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 3000
    rows = [(5, "http://a/1", same), (3, "http://a/2", same), (9, "http://a/ 3\r\nX: y", same), (3, "http://a/2", same),
            (None, None, same), (1, "", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "ü", long),
            (8, "u", long), (10, "u", long + "\r\n"), (11, "u", long + "\r\n\r"), (12, "u", "x" * 99), (13, "u", "x" * 99),
            (14, "u", "é" * 50), (15, "u", "é" * 50), (None, "u", "only null " * 20), (None, "v", "only null " * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("row", "payload", "record_type", "value", "file"):
        pages = pages.withColumn(name, F.lit(7))
    return pages


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_archives_round_trip(spark, odd_pages, tmp_path):
    rows = [tuple(r) for r in odd_pages.select("page_id", "html").collect()]
    path = str(tmp_path / "archives")
    warc.write(warc.from_pages(odd_pages.repartition(3)), path)
    got = warc.resolved(spark, path)
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=str) == brute_warc(rows)
    assert got.where("page_id = 9").first()["url"] == "http://a/%203%0D%0AX:%20y"
    # Payloads come back byte for byte, each once.
    payloads = [bytes(r[0]).decode() for r in warc.records(spark, path).where("record_type = 'response'").select("payload").collect()]
    assert sorted(payloads) == sorted([h or "" for _, h in rows if len((h or "").encode()) < 100]
                                      + list({h for _, h in rows if len((h or "").encode()) >= 100}))
    # Written anew, the archives say the same.
    again = str(tmp_path / "again")
    warc.write(warc.from_archives(spark, path), again)
    assert sorted((tuple(r) for r in warc.resolved(spark, again).select(COLUMNS).collect()), key=str) == brute_warc(rows)


def test_archives_of_pages(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages = pages.unionByName(pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 10_000))
    path = str(tmp_path / "archives")
    warc.write(warc.from_pages(pages), path)
    rows = [tuple(r) for r in pages.select("page_id", "html").collect()]
    assert sorted((tuple(r) for r in warc.resolved(spark, path).select(COLUMNS).collect()), key=str) == brute_warc(rows)


def test_no_pages(spark, odd_pages, tmp_path):
    path = str(tmp_path / "archives")
    warc.write(warc.from_pages(odd_pages.where("false")), path)
    assert warc.resolved(spark, path).isEmpty()


def test_foreign_and_broken_archives(spark, tmp_path):
    import gzip

    def record(kind, id_, block, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{id_}>", *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    whole = [record("warcinfo", "w", b"software: x\r\n"), record("response", "r1", b"\xff\x00 raw", "X-Page-ID: 1"),
             record("revisit", "v1", b"", "X-Page-ID: 2", "WARC-Refers-To: <r1>"),
             record("revisit", "v2", b"", "X-Page-ID: 3", "WARC-Refers-To: <gone>", "WARC-Payload-Digest: sha256:ab")]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in whole))
    (tmp_path / "a" / "y.warc").write_bytes(record("response", "r9", b"plain", "X-Page-ID: 9"))
    got = {r["page_id"]: tuple(r)[1:] for r in warc.resolved(spark, str(tmp_path / "a")).select(COLUMNS).collect()}
    raw = hashlib.sha256(b"\xff\x00 raw").hexdigest()
    assert got == {1: (6, raw, "response", None), 2: (6, raw, "revisit", 1), 3: (None, "ab", "revisit", None),
                   9: (5, hashlib.sha256(b"plain").hexdigest(), "response", None)}
    for name, content in (("cut", whole[1][:-9]), ("wrong", whole[1] + b"something else\r\n\r\n"),
                          ("digest", record("response", "r", b"x", "WARC-Payload-Digest: sha256:" + "0" * 64))):
        (tmp_path / f"{name}.warc").write_bytes(content)
        with pytest.raises(Exception, match="not whole|no record begins|does not fit"):
            warc.records(spark, str(tmp_path / f"{name}.warc")).collect()


# Audit


def test_lists_against_sets():
    draw = random.Random(3)
    for _ in range(300):
        lists = [sorted(draw.sample(range(60), draw.randrange(0, 40))) for _ in range(draw.randrange(0, 5))]
        whole = audit.union(lists)
        assert whole == sorted(set().union(*lists))
        own = sorted(draw.sample(range(60), draw.randrange(0, 40)))
        assert audit.parted(own, whole) == (sorted(set(own) - set(whole)), sorted(set(own) & set(whole)))
        at = draw.randrange(0, len(own) + 1)
        assert audit.gallop(own, at, 30) == max(at, sum(x < 30 for x in own))


def brute_audit(docs, labels):
    marks = {}
    for i, quality, toxic in labels:
        good, bad = marks.get(i, (0, 0))
        marks[i] = (good | (quality == 1), bad | (toxic == 1))
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    facts = []
    for i, text, lang in docs:
        t = text or ""
        own = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        facts.append((lang or "", {
            "A": len(own) < 200, "B": 100 * len(set(own)) < 50 * len(own),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": re.search("[#$%&*|]", t) is not None,
            "E": t in least and (i is None or least[t] < i)}, marks.get(i, (0, 0)) if i is not None else (0, 0)))
    out = []
    for part in {p for p, _, _ in facts}:
        own, rows = [f for f in facts if f[0] == part], []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [f for f in left if f[1][name]]
                left = [f for f in left if not f[1][name]]
                fails = [f for f in own if f[1][name]]
                rows.append((part, "".join(order), step, len(left), len(gone), len(fails) - len(gone),
                             sum(sum(f[1].values()) == 1 for f in fails), sum(f[2][0] for f in gone), sum(f[2][1] for f in gone)))
        total = Counter()
        for r in rows:
            total[r[1][r[2] - 1]] += r[4]
        out += [(*r, total[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


@pytest.mark.parametrize("size", [1 << 16, 8])
def test_audit_against_sets(spark, documents, sf, monkeypatch, size):
    monkeypatch.setattr(audit, "RANGE", size)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = sorted(tuple(r) for r in audit.audit(documents, labels).collect())
    docs = [tuple(r) for r in documents.select("doc_id", "text", "lang").collect()]
    assert got == brute_audit(docs, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_audit_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (2, 1, None), (None, 1, 1), (4, 0, 0), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = sorted(tuple(r) for r in audit.audit(odd_docs, labels).collect())
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text", "lang").collect()]
    assert got == brute_audit(docs, [tuple(r)[:3] for r in labels.collect()])
    assert audit.audit(no_docs, labels).isEmpty()
