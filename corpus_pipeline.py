"""The corpus pipeline: toxicity, MinHash near-dedup, substring dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns the columns of ``docs``
(whatever they are), but for the last, which returns pieces. ``n_chars``, if there, follows the text.

Defined results: null and empty texts pass all stages (packing gives them their end token); null ids are never duplicates;
rows that repeat an id stay or go together; without labels of both classes nothing counts as toxic unless the share of
toxic labels is one half or more; an empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import minhash, packing, pii, substrings, toxicity
from turnwise.llm.common import written
from turnwise.llm.queries import split_pattern, table, tokenizer_file

#: The stages can't be written as SQL; tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def _length_follows(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rest = tuple(c for c in docs.columns if c != "doc_id")
    names = {c: f"_c{i}" for i, c in enumerate(rest)}
    hidden = docs.select("doc_id", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    scored = toxicity.score(hidden, index, text_col=names["text"], carry=tuple(names.values()))
    return scored.where("predicted = 0").select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    found = minhash.near_duplicates(docs)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeats of 50 words that a smaller id has go; other texts stay as they are."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {c: f"_r{i}" for i, c in enumerate(rest)}
    hidden = docs.select("doc_id", F.col("text").alias("_t"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    cut = substrings.remove_repeats(hidden, text_col="_t", carry=tuple(names.values()), as_is=True)
    out = cut.select("doc_id", F.col("kept_text").alias("text"), *[F.col(n).alias(c) for c, n in names.items()])
    return _length_follows(out).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind in brackets."""
    return _length_follows(pii.redact_pii(docs, length_col=None))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, mixed by source."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), split_pattern())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("personal_data", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
