"""Operator 8. Mixture-controlled packing by deficit round-robin.

Documents queue by source. Every window (a sequence of 1024 tokens) draws from the queues by deficit round-robin: a queue
earns its share of the window and is served the whole tokens it has earned; single tokens that are left go to the largest
deficits, and what a queue got too much or too little is carried to the next window. The queue that is served first
goes round. The target proportions are those of the sources in the corpus, so every window holds each source's share to
within a token or two, all queues end together and only the last sequence can be short.

How it is spread: the order of windows is cut into blocks. A binary tree of the queues' totals tells how many tokens of each
queue lie before any block, so a block starts with the deficits that the blocks before it leave, without running them, and
ends with those that the next one starts with. Any task can work out the schedule of any block from the totals of the
queues, hence tokens need not be shuffled: a document only needs its place in its queue, a prefix sum over the totals of
parts (broadcast up to ``MAX_BROADCAST`` rows, joined beyond). Queues are in the order of a hash of the whole row, and a part is a
range of hashes, so the pieces depend on the rows alone, not on how the table is stored or on the number of parts.
With more than ``MAX_QUEUES`` sources a window would be cut into scraps, so they share queues, and a shared
queue is itself dealt from its sources by a deficit round-robin, in as many levels as it takes; so every source keeps its
deficit. Sources beyond that number go by a 64-bit hash of the name; its totals (16 bytes a source) are known to each task.

Defined results: a null or empty text is one separator token; a null source is a source of its own; rows that repeat an id
are packed one by one; an empty table gives no pieces; columns not named are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from turnwise.llm.bpe import TokenIds
from turnwise.llm.common import partitions_for, short_batches, text_batches, tidied, written

WINDOW, BLOCK_WINDOWS, MAX_QUEUES = 1024, 256, 64
#: Servings of blocks that a task remembers.
REMEMBER = 1 << 20
#: Rows of 24 bytes that are broadcast at most.
MAX_BROADCAST = 500_000
#: Parts at most.
MAX_PARTS = 20_000


class Schedule:
    """Which tokens of which queue lie where; a function of the queues' totals alone."""

    def __init__(self, totals: list[int], window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> None:
        self.window, self.block_windows = window, block_windows
        self.totals, self.all = totals, sum(totals)
        self.blocks = -(-self.all // (window * block_windows))
        self.splits: dict[tuple[int, int], list[int]] = {}
        self.made: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.servings = 0

    def left(self, lo: int, hi: int, totals: list[int]) -> list[int]:
        """The share of the left half of blocks [lo, hi): proportional, in whole tokens, largest remainders first."""
        if (got := self.splits.get((lo, hi))) is None:
            all_, cap = sum(totals), ((lo + hi) // 2 - lo) * self.window * self.block_windows
            got = [t * cap // all_ for t in totals]
            rest = sorted(range(len(totals)), key=lambda q: (-(totals[q] * cap % all_), q))
            for q in rest[: cap - sum(got)]:
                got[q] += 1
            self.splits[lo, hi] = got
        return got

    def find(self, queue: int, place: int) -> tuple[int, int, list[int], list[int]]:
        """(block, place in the queue's tokens of the block, the block's tokens of each queue, and those before it)."""
        lo, hi, totals, before = 0, self.blocks, self.totals, [0] * len(self.totals)
        while hi - lo > 1:
            mid, left = (lo + hi) // 2, self.left(lo, hi, totals)
            if place < left[queue]:
                hi, totals = mid, left
            else:
                place -= left[queue]
                lo, totals, before = mid, [t - x for t, x in zip(totals, left, strict=True)], [b + x for b, x in zip(before, left, strict=True)]
        return lo, place, totals, before

    def block(self, number: int, totals: list[int], before: list[int]) -> list[tuple[np.ndarray, ...]]:
        """For each queue: starts within its share of the block, windows, offsets and lengths of its servings."""
        if number in self.made:
            return self.made[number]
        if self.servings > REMEMBER:
            self.made.clear()
            self.servings = 0
        queues, rest = len(totals), sum(totals)
        # deficits in parts of a token (of ``all``), as the blocks before leave them
        done = sum(before)
        deficit = np.array([t * done - b * self.all for t, b in zip(self.totals, before, strict=True)], np.int64)
        earn, left, served = np.array(self.totals, np.int64), np.array(totals, np.int64), []
        while rest:
            space = min(self.window, rest)
            rest -= space
            deficit += earn * space
            take = np.clip(deficit // self.all, 0, left)
            while more := space - int(take.sum()):  # a token each to the largest deficits, or from the smallest
                able = np.flatnonzero(take < left if more > 0 else take > 0)
                owed = (deficit - take * self.all)[able]
                chosen = able[np.argsort(-owed if more > 0 else owed, kind="stable")[: abs(more)]]
                take[chosen] += 1 if more > 0 else -1
            deficit -= take * self.all
            left -= take
            served.append(take)
        take = np.array(served).reshape(-1, queues)
        windows = number * self.block_windows + np.arange(len(take))
        # the queue that is served first goes round
        turn = (np.arange(queues) + windows[:, None]) % queues
        turned = np.take_along_axis(take, turn, 1)
        offsets = np.zeros_like(take)
        np.put_along_axis(offsets, turn, np.cumsum(turned, 1) - turned, 1)
        starts = np.cumsum(take, 0) - take
        out = []
        for q in range(queues):
            w = np.flatnonzero(take[:, q])
            out.append((starts[w, q], windows[w], offsets[w, q], take[w, q]))
            self.servings += len(w)
        self.made[number] = out
        return out

    def pieces(self, queue: int, place: int, length: int) -> list[tuple[int, int, int, int]]:
        """(start in the document, length, window, offset) of the pieces of a document at a place of its queue."""
        out, done = [], 0
        while done < length:
            number, at, totals, before = self.find(queue, place + done)
            starts, windows, offsets, sizes = self.block(number, totals, before)[queue]
            i = int(np.searchsorted(starts, at, "right")) - 1
            while done < length and i < len(starts):
                skip = at - int(starts[i])
                n = min(int(sizes[i]) - skip, length - done)
                out.append((done, n, int(windows[i]), int(offsets[i]) + skip))
                done, at, i = done + n, at + n, i + 1
        return out


class Mixture:
    """Schedules in levels: where sources share a queue, a schedule of their own gives the order of its tokens."""

    def __init__(self, totals: list[int], most: int = MAX_QUEUES) -> None:
        self.most = most
        self.shared = [totals[q::most] for q in range(most)] if len(totals) > most else None
        self.schedule = Schedule([sum(t) for t in self.shared] if self.shared else totals)
        self.below: dict[int, Mixture] = {}

    def queue(self, source: int) -> int:
        return source % self.most if self.shared else source

    def pieces(self, source: int, place: int, length: int) -> list[tuple[int, int, int, int]]:
        """As those of ``Schedule``, by the number of a source."""
        if not self.shared:
            return self.schedule.pieces(source, place, length)
        q = self.queue(source)
        if q not in self.below:
            self.below[q] = Mixture(self.shared[q], self.most)
        inner, out = self.below[q], []
        for start, n, window, offset in inner.pieces(source // self.most, place, length):
            at = window * inner.schedule.window + offset
            out.extend((start + s, m, w, o) for s, m, w, o in self.schedule.pieces(q, at, n))
        return out


def tokenize(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, source_col: str, end: int, most: int = MAX_QUEUES) -> DataFrame:
    """A written table (part, queue, before, id, n, ids): tokens with the end token, and the source's tokens before in this part."""
    parts = min(partitions_for(docs, 16 << 20), MAX_PARTS)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("")).alias("source"))
    names = sorted(r.source for r in rows.select("source").distinct().limit(most + 1).collect())
    queues = {s: i for i, s in enumerate(names)} if len(names) <= most else None
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    rows = rows.withColumn("h", F.xxhash64("id", "source", "text"))
    rows = rows.withColumn("part", F.shiftright((F.shiftright("h", 32) + F.lit(1 << 31)) * F.lit(parts), 32).cast("int"))
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "h", "id").select("id", "text", "source", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = TokenIds.of(path, pattern)
        before: dict[tuple[int, int], int] = {}

        def pairs() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column(0), b.column(2), b.column(3)], ["id", "source", "part"]), b.column(1)], names=["key", "text"])

        for keys, texts in text_batches(pairs(), 1 << 20):
            tokens, bounds = tokenizer.encode(texts, added=True)
            tokens = np.insert(tokens, bounds[1:], end)
            bounds = bounds + np.arange(len(bounds))
            which = [queues[k["source"]] if queues else int.from_bytes(hashlib.blake2b(k["source"].encode(), digest_size=8).digest(), "little", signed=True) for k in keys]
            ahead = []
            of = [k["part"] for k in keys]
            for at, n in zip(zip(of, which, strict=True), np.diff(bounds).tolist(), strict=True):
                ahead.append(before.get(at, 0))
                before[at] = ahead[-1] + n
            data = tokens.astype("<u2" if tokenizer.size <= 65536 else "<u4")
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(which, pa.int64()), pa.array(ahead, pa.int64()), pa.array([k["id"] for k in keys], id_type), pa.array(np.diff(bounds), pa.int64()), pa.array([data[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())], names=["part", "queue", "before", "id", "n", "ids"])

    return written(rows.mapInArrow(tidied(run), f"part int, queue bigint, before bigint, id {kind}, n bigint, ids binary"), "tokens")


def pack(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", end: int = 0, with_ids: bool = False, max_queues: int = MAX_QUEUES) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, then the ids if asked for."""
    short_batches(docs.sparkSession)
    tokens = tokenize(docs, path, pattern, id_col, text_col, source_col, end, max_queues)
    sums = written(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "sums")
    found = sums.groupBy("queue").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).orderBy("queue").toArrow()
    names, totals = found.column("queue").to_numpy(), found.column("n").to_numpy()
    ahead = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("queue").alias("_q"), F.col("part").alias("_p"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    if sum(found.column("rows").to_pylist()) <= MAX_BROADCAST:  # a row for each task and queue; beyond that the tokens move to them
        bases = F.broadcast(bases)
    placed = tokens.join(bases, (F.col("queue") == F.col("_q")) & (F.col("part") == F.col("_p"))).select("id", "queue", (F.col("base") + F.col("before")).alias("place"), "n", "ids")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Mixture(totals.tolist(), max_queues)
        for b in batches:
            row, cols, parts = [], [], []
            sources = np.searchsorted(names, b.column(1).to_numpy()).tolist()
            for i, (q, place, n, ids) in enumerate(zip(sources, *[b.column(c).to_pylist() for c in range(2, 5)], strict=True)):
                data = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()
                for start, length, window, offset in schedule.pieces(q, place, n):
                    piece = data[4 * start : 4 * (start + length)]
                    row.append(i)
                    cols.append((start, length, zlib.crc32(piece), n, window, offset))
                    if with_ids:
                        parts.append(piece)
            c = np.array(cols, np.int64).reshape(-1, 6)
            at = pa.array(np.array(row, np.int64))
            queue = pa.array([schedule.queue(q) for q in sources], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *[pa.array(c[:, j]) for j in range(6)], queue.take(at), *([pa.array(parts, pa.binary())] if with_ids else [])], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", *(["ids"] if with_ids else [])])

    return placed.mapInArrow(tidied(run), f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, queue int" + ", ids binary" * with_ids)
