"""The registered queries of this package: each applies one operator, with its
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .workers import found_by_workers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = found_by_workers(function)
    return function


@_query
def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.digest(_table(spark, folder, "documents"),
                      public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)


#: Shards of the registered placement.
SHARDS = [f"shard-{i:02d}" for i in range(48)]


@_query
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from . import sharding

    return sharding.place(_table(spark, folder, "documents").select("doc_id"), "doc_id", SHARDS)


def _sharding_sql() -> str:
    from . import sharding

    slot = f"('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {sharding.TABLE_SIZE}"
    return (f"WITH held AS (SELECT {sharding.fill(SHARDS)} AS shards) "
            f"SELECT doc_id, {slot} AS slot, shards[{slot} + 1]::INTEGER AS shard FROM documents, held")


SQL["op2_sharding"] = _sharding_sql()


@_query
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from . import mixing

    return mixing.mix(_table(spark, folder, "documents"))


@_query
def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    from . import neighbours

    return neighbours.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


SQL["op9_neighbours"] = """
WITH rows AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM rows q JOIN rows c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@_query
def op6_exact(spark: SparkSession, folder: str) -> DataFrame:
    from . import naming

    return naming.exact_duplicates(_table(spark, folder, "documents"))


SQL["op6_exact"] = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
ranked AS (
  SELECT doc_id, bare,
         first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY bare) AS group_size FROM texts)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM ranked
"""


@_query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from . import toxicity

    held_out = F.coalesce(toxicity.remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = toxicity.score(_table(spark, folder, "documents").select("doc_id", "text"),
                            _table(spark, folder, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@_query
def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(_table(spark, folder, "documents"), width=4, percent=80)


@_query
def op8_backoff(spark: SparkSession, folder: str) -> DataFrame:
    from . import backoff

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scored = backoff.score(_table(spark, folder, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


@_query
def op10_lines(spark: SparkSession, folder: str) -> DataFrame:
    from . import lines

    return lines.line_duplicates(_table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.length("text").alias("n_kept"), F.sha2("text", 256).alias("kept_sha256"))


@_query
def op5_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    from . import repeats

    return repeats.digest(_table(spark, folder, "documents"))


@_query
def op11_lexical(spark: SparkSession, folder: str) -> DataFrame:
    from . import lexical

    return lexical.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), k=50)


SQL["op11_lexical"] = r"""
WITH terms AS (
  SELECT row, doc_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
counts AS (SELECT row, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT row, sum(tf)::BIGINT AS n FROM counts GROUP BY row),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, whole GROUP BY term),
asked AS (
  SELECT DISTINCT ask, item_id, term FROM (
    SELECT ask, item_id, unnest(regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS ask, item_id, text FROM benchmark))),
scored AS (
  SELECT ask, item_id, row, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (row), whole
  GROUP BY ask, item_id, row, doc_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY ask ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@_query
def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    from shelfline.session import shared_folder

    from . import warc

    path = shared_folder(spark, "archives")
    warc.write(warc.from_pages(_table(spark, folder, "pages")), path)
    return warc.resolved(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op12_warc"] = """
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM rows)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM firsts
"""


@_query
def op13_audit(spark: SparkSession, folder: str) -> DataFrame:
    from . import audit

    return audit.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


SQL["op13_audit"] = r"""
WITH marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
texts AS (
  SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS t, coalesce(good, 0) AS good,
         coalesce(m.toxic, 0) AS toxic,
         list_filter(string_split_regex(coalesce(d.text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents d LEFT JOIN marks m USING (doc_id)),
failed AS (
  SELECT part, good, toxic,
         [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
          100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
          coalesce(min(doc_id) OVER (PARTITION BY t) < coalesce(doc_id, 9223372036854775807), false)] AS f
  FROM texts),
facts AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f),
five AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM five a, five b, five c, five d, five e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, i AS step, o[i] AS own, o[1:i - 1] AS before FROM orders, five),
counted AS (
  SELECT part, o, step, own,
         sum(CASE WHEN earlier OR f[own] THEN 0 ELSE n END) AS kept,
         sum(CASE WHEN f[own] AND NOT earlier THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN f[own] AND earlier THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN f[own] AND len(list_filter(f, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN f[own] AND NOT earlier THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN f[own] AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, len(list_filter(before, lambda b: f[b])) > 0 AS earlier FROM steps, facts)
  GROUP BY part, o, step, own)
SELECT part, array_to_string([substr('ABCDE', x, 1) for x in o], '') AS filter_order, CAST(step AS INTEGER) AS step,
       kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
