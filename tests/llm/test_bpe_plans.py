"""Plans of operator 2: the driver keeps their descriptions, so tables of literals must not be written out in them."""

import base64
import hashlib

from pyspark.sql import functions as F
from turnwise.llm import bpe
from turnwise.llm.queries import split_pattern, tokenizer_file


def test_plans_do_not_spell_out_the_literals(spark):
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    texts = ["", None, "plain words, 日本語 and brûlée\n\n  12345", "x" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = bpe.digest(bpe.encode(docs, path, split_pattern()), path)
    rows = {r.doc_id: r for r in out.collect()}
    assert all(rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts))
    query = out._jdf.queryExecution()
    assert len(query.executedPlan().toString()) < 100_000 and len(query.toString()) < 200_000


def test_literals_hold_their_values(spark):
    numbers, names = [0, 1 << 62, 7], ["", "ff", ""]
    row = spark.range(1).select(bpe._literal(numbers, "bigint").alias("n"), bpe._literal(names, "string").alias("s"), F.get(bpe._literal([5], "int"), F.lit(1)).alias("none")).first()
    assert row.n == numbers and row.s == names and row.none is None


def test_decoding_meets_every_token(spark):
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    ids = sorted(tokens)
    row = spark.createDataFrame([(ids,)], "ids array<int>").select(bpe.decode_ids(F.col("ids"), path).alias("b")).first()
    assert bytes(row.b) == b"".join(tokens[i] for i in ids)
