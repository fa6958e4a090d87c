"""Operator 6. Token counts by a separator scan of flat token files.

``write_token_files`` turns texts into flat files of token ids, each document ended by the end-of-document id, with no
index. ``count_tokens`` finds the separators of each block by one vectorised comparison, then stitches documents that run
over block edges by a prefix scan over block summaries (a row a block: tokens, separators, tokens behind the last
separator); token data never moves. A file is as many blocks as it needs; a document may span any number of blocks.

Defined results: a null or empty text is a document of no tokens; tokens behind the last separator of a file are one more
document; an empty file has none; blocks hold whole tokens; rows that repeat an id are documents of their own; columns
not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.bpe import TokenIds
from turnwise.llm.common import columns, short_batches, text_batches, written

#: Bytes of a block: a multiple of four.
BLOCK = 1 << 20


def write_token_files(docs: DataFrame, path: str, pattern: str, separator: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(file, block, data, ids): blocks of flat files of little-endian unsigned 16-bit ids, a file for each partition.

    ``ids`` names the documents that begin in the block, in order; the scan doesn't read it.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, number, held, names = TaskContext.get().partitionId(), 0, bytearray(), []
        tokenizer = TokenIds.of(path, pattern)

        def row(data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int32()), pa.array([data], pa.binary()), pa.array([names], pa.list_(pa.int64()))], names=["file", "block", "data", "ids"])

        for ids, texts in text_batches(batches, 1 << 20):
            tokens, bounds = tokenizer.encode(texts)
            ended = np.insert(tokens, bounds[1:], separator).astype("<u2").tobytes()
            begin = 2 * (bounds[:-1] + np.arange(len(ids))) + len(held)
            held += ended
            done, cut = 0, 0
            while len(held) - cut >= block:
                upto = int(np.searchsorted(begin, cut + block))
                names += ids[done:upto]
                yield row(bytes(held[cut : cut + block]))
                number, names, done, cut = number + 1, [], upto, cut + block
            names += ids[done:]
            del held[:cut]
        if held:
            yield row(bytes(held))

    made = columns(docs, id_col, text_col).select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, "file int, block int, data binary, ids array<bigint>")
    return written(made, "token-files")


def count_tokens(files: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens, begins): the tokens of each document, separators not counted, by its place in its file."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(2).to_pylist():
                x = np.frombuffer(data, f"<u{width}")
                at = np.flatnonzero(x == separator)
                ends = np.diff(np.concatenate([[-1], at])) - 1
                rows.append((len(x), len(at), len(x) - 1 - int(at[-1]) if len(at) else len(x), ends))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["file", "block", "n", "seps", "tail", "ends"])

    scanned = files.select("file", "block", "data").mapInArrow(scan, "file int, block int, n bigint, seps bigint, tail bigint, ends array<bigint>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    edges = scanned.withColumn("start", start)
    edges = edges.select("file", "block", "seps", "tail", "n", "ends", "start", F.when(F.col("seps") > 0, F.col("start") + F.col("n") - F.col("tail")).alias("cut"))
    edges = edges.select("*", F.coalesce(F.sum("seps").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("cut").over(before), F.lit(0)).alias("open"))
    ended = edges.select("file", "first", (F.col("start") - F.col("open")).alias("carried"), F.posexplode("ends").alias("i", "here"))
    ended = ended.select("file", (F.col("first") + F.col("i")).alias("ordinal"), (F.col("here") + F.when(F.col("i") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"))
    last = edges.groupBy("file").agg(F.sum("seps").alias("ordinal"), (F.sum("n") - F.coalesce(F.max("cut"), F.lit(0))).alias("n_tokens")).where("n_tokens > 0")
    return ended.unionByName(last)


def document_tokens(files: DataFrame, separator: int, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens) of each document, named by the order in which the files were written."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = files.select("file", "block", "ids").withColumn("first", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)))
    names = names.select("file", "first", F.posexplode("ids").alias("i", id_col)).select("file", (F.col("first") + F.col("i")).alias("ordinal"), id_col)
    return count_tokens(files, separator).join(names, ["file", "ordinal"]).select(id_col, "n_tokens")
