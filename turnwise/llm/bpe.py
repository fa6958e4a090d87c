"""Operator 2. Byte-level BPE encoding and decoding.

Texts are split by the public pattern. The distinct pieces of the whole corpus, as byte arrays, are encoded once each by
Spark higher-order functions that fold ranked merges with a literal rank map; ids are then gathered for every occurrence.
Decoding looks each id up in a literal array of binary pieces (as hex) and concatenates them.

How it is spread: a task deals its texts into chunks of about ``CHUNK`` bytes and keeps, for each text, the numbers of its
pieces in the chunk. A chunk sends each of its distinct pieces once, in packed rows, to the task that the piece's checksum
names; that task folds what it has not met and answers each chunk. So a frequent piece is one entry for each chunk, there
are never more packed rows than distinct pieces, and no text, only the compressed numbers of its pieces, is shuffled.

The rank map is a literal of displaced rows: the shift of the left id plus the right id is a slot, which holds left id and
rank, so a lookup is two array reads. A literal Spark map would be searched entry by entry.
Pieces of more than ``FOLD_BYTES`` bytes take the same merges by a heap in Python, since the fold is quadratic in the length.

Defined results: a null or empty text has no ids; the ids' digest is then that of no bytes; repeated rows give repeated
results; null ids of rows are passed on; other columns of the table are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from turnwise.llm.common import columns, partitions_for, short_batches, text_batches

FOLD_BYTES = 48
#: Bytes of text in a chunk, about, and of its slices.
CHUNK, SLICE = 20 << 20, 2 << 20
#: Pieces that a folding task remembers at most; then it starts anew.
REMEMBER = 600_000
_EMPTY = 1 << 62
_NONE = 65536


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def rank_map(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(shifts, slots): the merging pairs of ids as displaced rows.

    The row of id a is laid over one slot array from shift a on, so that no two pairs (a, b) share a slot; the slot of a pair
    holds a * 65536 + rank.
    """
    ranks = load_ranks(path)
    if max(ranks.values()) >= _NONE - 1:
        raise ValueError("the rank map takes vocabularies of up to 65,535 entries")
    rows: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                rows[a].append((b, rank))
    n, width = sum(map(len, rows.values())), max(ranks.values()) + 1
    shifts, rng = np.zeros(width, np.int64), np.random.default_rng(len(ranks))
    slots = np.full(4 * n + width, _EMPTY, np.int64)
    for a, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        columns_, values = np.array([b for b, _ in row]), np.array([r for _, r in row])
        for _ in range(2000):
            tried = rng.integers(4 * n, size=64)
            if len(good := tried[(slots[tried[:, None] + columns_] == _EMPTY).all(1)]):
                d = int(good[0])
                break
        else:
            raise ValueError("the rank map has no room")
        shifts[a] = d
        slots[columns_ + d] = a * 65536 + values
    return shifts, slots


def _literal(values, kind: str) -> Column:
    """A literal array in Spark's binary form, folded once from the split of one string over a local table, without a job.

    Plans name it in a few characters. An array of objects is written out in every description of a plan, and the driver keeps
    many of those.
    """
    from pyspark.sql.classic.column import Column as ClassicColumn

    spark = SparkSession.active()
    made = spark.sql("SELECT * FROM VALUES (1)").select(F.split(F.lit(" ".join(map(str, values))), " ").cast(f"array<{kind}>"))
    array = made._jdf.queryExecution().executedPlan().executeCollect()[0].getArray(0)
    sql = spark._jvm.org.apache.spark.sql
    return ClassicColumn(sql.classic.ExpressionUtils.column(sql.catalyst.expressions.Literal(array, made._jdf.schema().apply(0).dataType())))


def fold_merges(pieces: Column, path: str) -> Column:
    """array<array<smallint>> (bytes of pieces) -> array<array<int>> (token ids), by folding ranked merges."""
    ranks = load_ranks(path)
    shift, table = rank_map(path)
    single, shifts, slots = _literal([ranks[bytes([i])] for i in range(256)], "int"), _literal(shift.tolist(), "int"), _literal(table.tolist(), "bigint")

    def bound(value: Column, body) -> Column:
        """``body`` of a value that is computed once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def step(ids: Column, _: Column) -> Column:
        """Merge the first pair of the least rank. Behind the last id there is none, and ``array_min`` passes over nulls."""
        known = F.transform(ids, lambda x, i: F.get(slots, F.get(shifts, x) + F.get(ids, i + F.lit(1))).bitwiseXOR(F.shiftleft(x.cast("bigint"), 16)))

        def merged(ranks_: Column, best: Column) -> Column:
            return bound(F.array_position(ranks_, best).cast("int"), lambda at: F.filter(F.transform(ids, lambda x, i: F.when(i == at - F.lit(1), best.cast("int")).otherwise(x)), lambda x, i: i != at))

        # another pair's slot differs in its upper bits, so what it gives is no rank
        return bound(known, lambda ranks_: bound(F.array_min(ranks_), lambda best: F.when(best < F.lit(_NONE), merged(ranks_, best)).otherwise(ids)))

    return F.transform(pieces, lambda piece: F.aggregate(F.slice(piece, F.lit(2), F.size(piece)), F.transform(piece, lambda b: F.get(single, b.cast("int"))), step))


def decode_ids(ids: Column, path: str) -> Column:
    """array<int> of token ids -> the binary text."""
    ranks = load_ranks(path)
    hexes = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        hexes[rank] = token.hex()
    vocabulary = _literal(hexes, "string")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(vocabulary, i)), ""))


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long piece, with a heap: n log n."""
    n = len(piece)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or not alive[j := end[i]] or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers by planes of bytes: the mostly empty upper ones compress to nothing."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


def _packed(pieces: list[bytes]) -> bytes:
    return len(pieces).to_bytes(4, "little") + _planes(np.fromiter(map(len, pieces), np.int64, len(pieces))) + b"".join(pieces)


def _unpacked(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    bounds = (np.concatenate([[0], np.cumsum(_from_planes(data[4 : 4 + 4 * n]))]) + 4 + 4 * n).tolist() if n else [0]
    return [data[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def _split(docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """Slices of texts: chunk, ids, for each text the numbers of its pieces in the chunk, and the pieces new to the chunk from number ``base`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import zstandard
        from pyspark import TaskContext

        find, shrink = regex.compile(pattern).findall, zstandard.ZstdCompressor(level=1).compress
        chunk, size = TaskContext.get().partitionId() << 24, 0
        known: dict[str, int] = defaultdict()
        known.default_factory = known.__len__  # a new piece gets the next number
        for ids, texts in text_batches(batches, SLICE):
            if size >= CHUNK:
                known.clear()
                chunk, size = chunk + 1, 0
            size += sum(map(len, texts))
            had, numbers, bounds = len(known), [], [0]
            for t in texts:
                numbers.extend(map(known.__getitem__, find(t.decode())))
                bounds.append(len(numbers))
            new = [p.encode() for p in islice(known, had, None)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([had], pa.int32()), pa.array([ids], pa.list_(id_type)), pa.array([shrink(np.array(numbers, "<i4").tobytes())], pa.binary()), pa.array([np.array(bounds, "<i8").tobytes()], pa.binary()), pa.array([shrink(_packed(new))], pa.binary())],
                names=["chunk", "base", "ids", "numbers", "bounds", "pieces"],
            )

    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    return columns(docs, id_col, text_col).mapInArrow(run, f"chunk bigint, base int, ids array<{kind.simpleString()}>, numbers binary, bounds binary, pieces binary")


def _by_bucket(slices, buckets: int) -> dict[int, tuple[list[int], list[bytes]]]:
    """bucket -> (numbers, pieces) of a chunk's (first number, pieces)."""
    by: dict[int, tuple[list[int], list[bytes]]] = {}
    for base, pieces in slices:
        for i, p in enumerate(pieces, base):
            numbers, held = by.setdefault(zlib.crc32(p) % buckets, ([], []))
            numbers.append(i)
            held.append(p)
    return by


def _folded(dealt: DataFrame, path: str, parts: int, buckets: int) -> DataFrame:
    """(chunk, bucket, first, sizes, tokens): the ids of the distinct pieces of each chunk and bucket, by their numbers from ``first`` on.

    Each piece of the corpus is folded once.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        grow = zstandard.ZstdDecompressor().decompress
        for b in batches:
            held: dict[int, list[tuple[int, list[bytes]]]] = {}
            for chunk, base, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(5).to_pylist(), strict=True):
                held.setdefault(chunk, []).append((base, _unpacked(grow(packed))))
            for chunk, slices in held.items():
                by = _by_bucket(sorted(slices, key=lambda s: s[0]), buckets)
                yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([chunk] * len(by), pa.int64()), pa.array([n[0] for n, _ in by.values()], pa.int32()), pa.array([_packed(p) for _, p in by.values()], pa.binary())], names=["bucket", "chunk", "first", "pieces"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The packed rows with places among the pieces met in this task, and the pieces not met before."""
        known: dict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        for b in batches:
            for row in range(b.num_rows):
                fresh = len(known) > REMEMBER
                if fresh:
                    known.clear()
                had = len(known)
                places = np.array(list(map(known.__getitem__, _unpacked(b.column(3)[row].as_py()))), "<i4")
                new = list(islice(known, had, None))
                short = [p if len(p) <= FOLD_BYTES else b"" for p in new]
                flat = np.frombuffer(b"".join(short), np.uint8).astype(np.int16)
                inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in short])]), pa.int32()), pa.array(flat, pa.int16()))
                pieces = pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), inner)
                longs = {had + i: p for i, p in enumerate(new) if len(p) > FOLD_BYTES}
                yield pa.RecordBatch.from_arrays([b.column(1).slice(row, 1), b.column(0).slice(row, 1), b.column(2).slice(row, 1), pa.array([places.tobytes()], pa.binary()), pa.array([fresh]), pa.array([list(longs)], pa.list_(pa.int32())), pa.array([list(longs.values())], pa.list_(pa.binary())), pieces], names=["chunk", "bucket", "first", "places", "fresh", "long_at", "longs", "pieces"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        flat, first, used, count = np.zeros(1 << 20, np.uint16), np.zeros(0, np.int64), 0, np.zeros(0, np.int64)
        for b in batches:
            for row in range(b.num_rows):
                if b.column(4)[row].as_py():
                    first, count, used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
                pieces = b.column(7)[row].values
                new = np.diff(pieces.offsets.to_numpy()).astype(np.int64)
                values = pieces.flatten().to_numpy().astype(np.uint16)
                longs = [(at - len(count), merge_long(p, ranks)) for at, p in zip(b.column(5)[row].as_py(), b.column(6)[row].as_py(), strict=True)]
                starts = np.cumsum(new) - new + used
                for at, ids in longs:
                    starts[at], new[at] = used + len(values), len(ids)
                    values = np.concatenate([values, np.array(ids, np.uint16)])
                if used + len(values) > len(flat):
                    flat = np.concatenate([flat[:used], np.zeros(max(len(flat), len(values)), np.uint16)])
                flat[used : used + len(values)] = values
                used += len(values)
                first, count = np.concatenate([first, starts]), np.concatenate([count, new])
                places = np.frombuffer(b.column(3)[row].as_py(), "<i4")
                tokens, ends = _gathered(flat, first, count, places)
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(row, 1) for c in range(3)], pa.array([_planes(np.diff(ends))], pa.binary()), pa.array([tokens.astype("<u2").tobytes()], pa.binary())], names=["chunk", "bucket", "first", "sizes", "tokens"])

    sent = dealt.mapInArrow(send, "bucket int, chunk bigint, first int, pieces binary").repartition(parts, "bucket")
    met = sent.mapInArrow(distinct, "chunk bigint, bucket int, first int, places binary, fresh boolean, long_at array<int>, longs array<binary>, pieces array<array<smallint>>")
    folded = met.select("chunk", "bucket", "first", "places", "fresh", "long_at", "longs", fold_merges(F.col("pieces"), path).alias("pieces"))
    return folded.mapInArrow(answer, "chunk bigint, bucket int, first int, sizes binary, tokens binary")


def _gathered(flat: np.ndarray, first: np.ndarray, count: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs (first, count) of ``flat`` that ``which`` names, one behind the other, and their bounds."""
    sizes = count[which]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(first[which] - ends[:-1], sizes) + np.arange(ends[-1])], ends


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids array<int>, ids_sha256) per row."""
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    parts = min(partitions_for(docs, 16 << 20), 20_000)
    buckets = 6 * parts  # so that tasks get about as many
    dealt = _split(docs, id_col, text_col, pattern).repartition(parts, "chunk")
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_sha256", T.StringType())])

    def gather(_key: tuple, slices: pa.Table, answers: pa.Table) -> pa.Table:
        import zstandard

        grow = zstandard.ZstdDecompressor().decompress
        pieces = sorted((base, _unpacked(grow(x))) for base, x in zip(slices.column("base").to_pylist(), slices.column("pieces").to_pylist(), strict=True))
        by = {k: np.array(n) for k, (n, _) in _by_bucket(pieces, buckets).items()}
        total = sum(len(p) for _, p in pieces)
        first, count, flat, used = np.zeros(total, np.int64), np.zeros(total, np.int64), [np.zeros(0, "<u2")], 0
        for bucket, number, sizes, tokens in zip(*[answers.column(c).to_pylist() for c in ("bucket", "first", "sizes", "tokens")], strict=True):
            sizes, numbers = _from_planes(sizes), by[bucket]
            at = numbers[(i := int(np.searchsorted(numbers, number))) : i + len(sizes)]
            first[at], count[at] = np.cumsum(sizes) - sizes + used, sizes
            flat.append(np.frombuffer(tokens, "<u2"))
            used += len(flat[-1])
        flat = np.concatenate(flat)
        made = []
        for row in range(slices.num_rows):
            numbers, bounds = np.frombuffer(grow(slices.column("numbers")[row].as_py()), "<i4"), np.frombuffer(slices.column("bounds")[row].as_py(), "<i8")
            tokens, ends = _gathered(flat, first, count, numbers)
            cut, wide = ends[bounds], tokens.astype("<u4").tobytes()
            shas = [hashlib.sha256(wide[4 * x : 4 * y]).hexdigest() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            made.append(pa.RecordBatch.from_arrays([slices.column("ids")[row].values, pa.array(np.diff(cut), pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(tokens, pa.int32())), pa.array(shas, pa.string())], names=[id_col, "n_tokens", "ids", "ids_sha256"]))
        return pa.Table.from_batches(made)

    return dealt.groupBy("chunk").cogroup(_folded(dealt, path, parts, buckets).repartition(parts, "chunk").groupBy("chunk")).applyInArrow(gather, schema)


def digest(encoded: DataFrame, path: str) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(decode_ids(F.col("ids"), path), 256).alias("decoded_sha256"))


# ---------------------------------------------------------------- ids by a tokenizer file, for token counts and packing


class TokenIds:
    """Ids of whole texts by a ``tokenizers`` file of a byte-level BPE without added tokens.

    The file's vocabulary, whose ids are the ranks of its merges, drives the rank engine of tiktoken: the ids are the same at
    about a fifth of the CPU time and memory. Each worker compares both on a probe text and raises if they differ.
    """

    PROBE = "The   quick brûlée's 12345 \u65e5\u672c\u8a9e\u3000\U0001f600 don't\r\n\n\t_x__ <|endoftext|> e\u0301\u00a0\u00a0z  "
    _made: dict[tuple[str, str], TokenIds] = {}

    def __init__(self, path: str, pattern: str) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the printable letters that stand for bytes: printable Latin-1 as itself, the others from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"added tokens that strip or need word ends: {path}")
        self.added = added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # the longest literal first
        self.literals = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.size = len(spec["model"]["vocab"])
        self.ranks, self.pattern = ranks, pattern
        self.engine = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        plain_ids = t.encode(self.PROBE, add_special_tokens=False).ids
        t.encode_special_tokens = False
        if plain_ids != self.engine.encode_ordinary(self.PROBE) or t.encode(self.PROBE, add_special_tokens=False).ids != self.one_with_added(self.PROBE):
            raise ValueError(f"not a byte-level BPE with ids in the order of merges: {path}")

    @classmethod
    def of(cls, path: str, pattern: str) -> TokenIds:
        """The worker's one instance for a file."""
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def encode(self, texts: list[bytes], added: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, bounds of each text); with ``added``, literals of added tokens get their ids."""
        one = self.one_with_added if added else self.one
        parts = [np.array(one(t.decode()), np.int32) for t in texts]
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def one_with_added(self, text: str) -> list[int]:
        """As ``tokenizers`` at its defaults: texts are split at the added tokens first."""
        if self.literals is None or not self.literals.search(text):
            return self.one(text)
        return [i for p in self.literals.split(text) if p for i in ([self.added[p]] if p in self.added else self.one(p))]

    def one(self, text: str) -> list[int]:
        try:
            return self.engine.encode_ordinary(text)
        except BaseException as e:  # a run of very many white spaces exhausts the engine's stack
            if type(e).__name__ != "PanicException":
                raise
            import regex

            return [i for p in regex.findall(self.pattern, text) for i in merge_long(p.encode(), self.ranks)]
