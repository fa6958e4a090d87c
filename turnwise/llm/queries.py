"""The driver queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.llm import warc

    return warc.digest(warc.round_trip(table(spark, sf_dir, "pages")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.llm import bpe

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), path, split_pattern()), path)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.llm import vectors

    return vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.llm import media

    return media.digest(media.read_media(media.to_media(table(spark, sf_dir, "documents"))))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.llm import substrings

    return substrings.digest(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.llm import token_counts

    separator = 50256  # a fixed value of the vocabulary: its end-of-text token
    files = token_counts.write_token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), split_pattern(), separator)
    return token_counts.document_tokens(files, separator)


def op7_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.llm import minhash

    return minhash.digest(minhash.near_duplicates(table(spark, sf_dir, "documents")))


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), split_pattern())


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.llm import pii

    return pii.digest(pii.scan_pii(table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_index": op1_warc_index,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_media_columns": op4_media_columns,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_token_counts": op6_token_counts,
        "op7_minhash_forest": op7_minhash_forest,
        "op8_mixture_packing": op8_mixture_packing,
        "op9_pii": op9_pii,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_index": OP1, "op3_embedding_dedup": OP3, "op5_substring_dedup": OP5, "op7_minhash_forest": OP7}


OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, min(page_id) AS first_id FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM q LEFT JOIN m USING (payload_digest)
"""

OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""

OP5 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
k AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 49), ' ') AS gram FROM s),
m AS (SELECT gram, min(doc_id) AS first_id FROM k GROUP BY gram),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM k JOIN m USING (gram) WHERE first_id < doc_id),
r AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(words, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""

OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
),
i AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS gram FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s AS a JOIN s AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c ON w.doc_id = c.a LEFT JOIN n ON w.doc_id = n.doc_id
"""
