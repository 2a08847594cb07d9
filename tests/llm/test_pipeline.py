import __spark_entry__ as entry
import corpus_pipeline
from shelfline.llm import queries


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}
    assert "pipeline" in names and set(queries.QUERIES) <= names
    assert set(entry.oracle_sql()) <= names
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "lines", "minhash", "mixing", "bpe"]


def test_stages_by_hand(spark, sf, documents):
    """Every stage against the plain reading of its rule, on what the one before kept."""
    from test_duplicates import brute_lines, brute_near

    clean, lines, near, mixed, last = (stage for _, stage in corpus_pipeline.STAGES)
    kept = clean(spark, documents, sf).cache()
    assert kept.columns == documents.columns and 0 < kept.count() <= documents.count()
    rows = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    parted = lines(spark, kept, sf).cache()
    want = {i: t for i, t, _, _ in brute_lines(rows)}
    assert {r["doc_id"]: r["text"] for r in parted.collect()} == want
    assert parted.columns == documents.columns
    assert all(r["n_chars"] == len(r["text"]) for r in parted.collect())
    single = near(spark, parted, sf).cache()
    groups = {i: c for i, _, c in brute_near(list(want.items()), 5)}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, c in groups.items() if i == c)
    taken = mixed(spark, single, sf).cache()
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    assert taken.columns == documents.columns
    assert all(texts[r["doc_id"]] == r["text"] for r in taken.collect())
    assert last(spark, taken, sf).count() == taken.count()
    for df in (kept, parted, single, taken):
        df.unpersist()
