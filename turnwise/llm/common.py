"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_M = np.uint64
#: Only glibc has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Rows of an Arrow batch at most; whole texts can be long, so batches of them stay short.
ARROW_ROWS = 512


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short, so that a batch of long texts fits in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000") or 10000) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only where none is set, as in tests."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        known = "file://" + tempfile.mkdtemp(prefix="turnwise-")
        spark.conf.set("spark.checkpoint.dir", known)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(known)
    return known


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    import uuid

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/turnwise/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder; survives the loss of executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the input, 0 if it has none; only sets numbers of partitions, never what is computed."""
    est = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return est if est < 1 << 60 else 0


def partitions_for(df: DataFrame, target: int) -> int:
    """Partitions of about ``target`` input bytes, at least the session's shuffle partitions."""
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, floor, math.ceil(size_in_bytes(df) / target))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, whatever else the table has."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Bits of an id filter: 4 MB, whatever the number of ids.
FILTER_BITS = 1 << 25


def id_filter(ids: DataFrame, name: str) -> np.ndarray:
    """A Bloom filter of fixed size over a bigint column; it may let other ids pass, so a join has to follow it."""
    h = F.xxhash64(F.col(name))
    places = F.array(h.bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftrightunsigned(h, 25).bitwiseAND(F.lit(FILTER_BITS - 1)))
    words = ids.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which xxhash64 values the filter lets pass."""
    ok = np.ones(len(hashes), bool)
    h = hashes.view(np.uint64)
    for p in (h & _M(FILTER_BITS - 1), (h >> _M(25)) & _M(FILTER_BITS - 1)):
        ok &= ((bits[(p >> _M(6)).astype(np.int64)].view(np.uint64) >> (p & _M(63))) & _M(1)).astype(bool)
    return ok


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """(first column, second column as UTF-8 bytes) in slices of about ``limit`` bytes; null text is empty."""
    ids, texts, size = [], [], 0
    for batch in batches:
        column = batch.column(1)
        if not pa.types.is_binary(column.type):
            column = column.cast(pa.binary())
        for i, t in zip(batch.column(0).to_pylist(), column.to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or b"")
            size += len(texts[-1])
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def arrow_rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


# ---------------------------------------------------------------- hashing of words and windows


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on uint64."""
    x = x ^ (x >> _M(30))  # a new array; the rest is in place
    x *= _M(0xBF58476D1CE4E5B9)
    x ^= x >> _M(27)
    x *= _M(0x94D049BB133111EB)
    x ^= x >> _M(31)
    return x


def _cumulated(r: int, n: int) -> np.ndarray:
    base = np.full(n, r % (1 << 64), _M)
    base[0] = 1
    return np.cumprod(base, dtype=_M)


class Powers:
    """r^i and r^-i modulo 2^64; the first ``KEPT`` are kept, more are products of two."""

    KEPT = 1 << 16

    def __init__(self, r: int) -> None:
        self.bases = r, pow(r, -1, 1 << 64)
        self.kept = tuple(_cumulated(b, self.KEPT) for b in self.bases)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= self.KEPT:
            return self.kept
        steps = [_cumulated(pow(b, self.KEPT, 1 << 64), -(-n // self.KEPT)) for b in self.bases]
        up, down = [(s[:, None] * k).reshape(-1) for s, k in zip(steps, self.kept, strict=True)]
        return up, down


_WORDS = Powers(0xD1342543DE82EF95)
_CHECK = Powers(0xAF251AF3B0F025B5)
#: The key of the digests of words: one for all tasks and runs, so that retries agree.
_KEY = b"turnwise words"


class Digests(dict):
    """word -> the place of its 128-bit keyed digest; a task remembers words up to ``LIMIT`` and then starts anew."""

    LIMIT, LONGEST = 400_000, 64

    def __init__(self) -> None:
        self.data = bytearray()

    def forget(self) -> None:
        self.clear()
        self.data = bytearray()

    def of(self, words: list[bytes]) -> np.ndarray:
        """(words, 2) uint64: both halves of the digests."""
        if len(self.data) >> 4 > self.LIMIT:
            self.forget()
        at = list(map(self.get, words))
        if None in at:
            keyed, made, n = hashlib.blake2b(digest_size=16, key=_KEY), [], len(self.data) >> 4
            for i, (word, known) in enumerate(zip(words, at, strict=True)):
                if known is None and (known := self.get(word)) is None:
                    digest = keyed.copy()
                    digest.update(word)
                    made.append(digest.digest())
                    known, n = n, n + 1
                    if len(word) <= self.LONGEST:
                        self[word] = known
                at[i] = known
            self.data += b"".join(made)
        at = np.array(at, np.int64)
        return np.frombuffer(bytes(self.data), "<u8").reshape(-1, 2)[at]


_DIGESTS = Digests()


def give_back() -> None:
    """Return to the system what is free or only remembered: words, unused Arrow buffers, the C library's free pages."""
    _DIGESTS.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with memory given back before and after: a Python worker outlives its tasks and takes those of all stages."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return clean


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (between spaces and bytes 9 to 13) of all texts: (first and second half of their digests, index of the text).

    Words stay bytes of one buffer; only the distinct ones become objects, to be looked up.
    """
    data = b" ".join([b"", *texts, b""])
    letters = np.frombuffer(data.lower() if lower else data, np.uint8)
    space = _SPACE[letters]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, size = edges[::2], edges[1::2] - edges[::2]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(letters[~space])]).dictionary_encode()
    found = _DIGESTS.of(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
    ends = np.cumsum([1 + len(t) for t in texts], dtype=np.int64)
    return found[:, 0], found[:, 1], np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, ends), prepend=0))


def grouped(wide: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order in which equal pairs of a hash and its check stand together, the first place of each such group)."""
    order = np.argsort(wide)
    w, c = wide[order], check[order]
    same = w[1:] == w[:-1]
    if (same & (c[1:] != c[:-1])).any():  # two windows share a hash of 64 bits
        order = np.lexsort((check, wide))
        w, c = wide[order], check[order]
        same = (w[1:] == w[:-1]) & (c[1:] == c[:-1])
    return order, np.flatnonzero(np.concatenate([[True], ~same]))


def places_of(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """``np.searchsorted(among, values)``, with the values in their order, so that memory is read in one direction."""
    order = np.argsort(values)
    out = np.empty(len(values), np.int64)
    out[order] = np.searchsorted(among, values[order])
    return out


def windows_of(hashes: np.ndarray, text: np.ndarray, width: int, check: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(first words of the windows of ``width`` words inside one text, their 64-bit hashes)."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, _M)
    up, down = (_CHECK if check else _WORDS).upto(n + 1)
    with np.errstate(over="ignore"):
        acc = np.zeros(n + 1, _M)
        np.cumsum(hashes * up[:n], out=acc[1:])
        del up
        first = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
        sums = acc[first + width]
        sums -= acc[first]
        sums *= down[first]
        del acc, down
        return first, mix(sums)
