"""The queries of the corpus operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licences import scan

    return scan(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.langid import held_out, identify

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, docs.where(~held_out()))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.passages import kept_words

    return kept_words(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mixed

    return mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.topk import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0 AND len(q.x) = len(c.x)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import STATS, judged

    return judged(_table(spark, sf_dir, "documents"), ["doc_id"]).select("doc.doc_id", *STATS, "base_failed", "kept", "distance")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
starts AS (SELECT row, doc_id, words, CAST(unnest(range(1, len(words) - 18)) AS INT) AS i FROM d WHERE len(words) >= 20),
seen AS (SELECT row, i, row_number() OVER (PARTITION BY array_to_string(words[i : i + 19], ' ') ORDER BY doc_id NULLS FIRST, row, i) AS r FROM starts),
gone AS (SELECT DISTINCT row, i + k AS place FROM seen, range(0, 20) AS o(k) WHERE r > 1),
lost AS (SELECT row, list(place) AS places FROM gone GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(words, lambda w, k: places IS NULL OR NOT list_contains(places, k)), ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (row)
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import archived

    return archived(_table(spark, sf_dir, "pages")).drop("url", "html")


OP10_SQL = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS b FROM sized),
firsts AS (SELECT html, min(page_id) AS first FROM sized GROUP BY html)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(0, 5),
    lambda j: CAST(substr(b, CAST(i * 5 + j + 1 AS INT), 1) AS INT) * CAST(pow(2, 4 - j) AS INT))) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM bits JOIN firsts USING (html)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_mixing": op1_mixing, "op2_topk": op2_topk, "op3_quality": op3_quality, "op4_toxicity": op4_toxicity, "op5_simhash": op5_simhash, "op6_licences": op6_licences, "op7_packing": op7_packing, "op8_language": op8_language, "op9_passages": op9_passages, "op10_warc": op10_warc}
ORACLES: dict[str, str] = {"op2_topk": OP2_SQL, "op9_passages": OP9_SQL, "op10_warc": OP10_SQL}
