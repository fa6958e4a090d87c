"""Operator 5. Substring dedup by fixed-block anchors.

Reference blocks are the non-overlapping blocks of 25 words of every document. A repeat of 50 words holds at least one
whole reference block of the other document, so probing the blocks with every rolling window of 25 words meets each
repeat. Hits are extended: every window of 50 words around a hit is looked up among all windows extended from hits, the
smallest document that has it is found, and consecutive windows join into maximal exact repeats.

How it is spread: documents are dealt into chunks by a hash. A chunk sends each bucket of the hash space one packed row
with its distinct window hashes (a pre-aggregation: a passage shared by a third of all documents is one entry per chunk),
the bucket answers each chunk with one packed row. No row is made per window or per pair, no key meets in one task more
than once per chunk, and nothing is broadcast or collected. Two such rounds (anchors, then windows of 50 words) are one
plan; the exchange of the texts is reused by both, and a lost executor only costs a rerun of its tasks.

Anchor probes are compared by at least 40 bits, which only adds candidates; windows of 50 words by 64 bits made of one
half and 32 bits made of the other half of the 128-bit keyed digests of their words.

Defined results: a null or empty text has no words; the words of a null id count as those of the largest id; rows that
repeat an id are one document for the comparison of ids and remove nothing from each other; ids are integers; columns
not named are not read, columns named in ``carry`` are passed on; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.llm.common import columns, grouped, partitions_for, places_of, size_in_bytes, windows_of, words_of

_M = np.uint64
_LAST = np.iinfo(np.int64).max
#: Bytes of text whose words are looked up at once.
SLICE = 4 << 20


def _words(table: pa.Table):
    texts = [t or b"" for t in table.column("_text").cast(pa.binary()).to_pylist()]
    ids = table.column("_id").cast(pa.int64()).fill_null(_LAST).to_numpy()
    # a slice at a time: its distinct words become objects
    hashes, second, text, first, size = [np.zeros(0, _M)], [np.zeros(0, _M)], [np.zeros(0, np.int64)], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE or i + 1 == len(texts):
            h, other, owner = words_of(texts[first : i + 1])
            hashes.append(h)
            second.append(other)
            text.append(owner + first)
            first, size = i + 1, 0
    return texts, ids, np.concatenate(hashes), np.concatenate(second), np.concatenate(text)


def _pack(keys: np.ndarray, flags: np.ndarray) -> bytes:
    """Keys of 38 bits and two flags as five bytes each."""
    return (keys & _M(0xFFFFFFFF)).astype("<u4").tobytes() + (((keys >> _M(32)) & _M(63)).astype(np.uint8) | (flags << 6).astype(np.uint8)).tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 5
    top = np.frombuffer(data, np.uint8, n, 4 * n)
    return np.frombuffer(data, "<u4", n).astype(_M) | ((top & 63).astype(_M) << _M(32)), top >> 6


def _by_bucket(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds) of sorted hashes, by their upper bits."""
    bucket = (hashes >> _M(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.diff(bucket)) + 1
    return bucket[np.concatenate([[0], at])], np.concatenate([[0], at, [len(hashes)]])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("data", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
_SENT_DDL, _ANSWER_DDL = "bucket int, chunk int, data binary", "chunk int, bucket int, data binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), width: int = 50, chunk_bytes: int = 4 << 20, max_partitions: int = 20_000, as_is: bool = False) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_text (kept words joined by a space), repeats (word ranges), then ``carry``.

    With ``as_is`` a text that loses nothing is given as it was (null too).

    A word goes if a window of ``width`` consecutive words that covers it also starts in a document with a smaller id.
    """
    block = width // 2
    size = partitions_for(docs, 4 * chunk_bytes)
    parts = min(size, max_partitions)
    chunks = max(2 * parts, math.ceil(size_in_bytes(docs) / chunk_bytes))
    bits = max(4, math.ceil(math.log2(2 * parts)))  # buckets and chunks by the number of tasks: a packed row for each pair of them
    kept = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)]
    dealt = columns(docs, id_col, text_col, *[c for c in carry if c not in (id_col, text_col)]).select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), *kept)
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("_id", "_text"), F.lit(chunks)).cast("int")).repartition(parts, "chunk")

    def probe(key: tuple, table: pa.Table) -> pa.Table:
        """Distinct rolling windows of a chunk, with flags: 1 it is a reference block, 2 several documents have it."""
        _, ids, hashes, _, text = _words(table)
        first, h = windows_of(hashes, text, block)
        if not len(h):
            return _rows(_SENT, [])
        begin = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1])
        anchor = (first - begin[np.searchsorted(begin, first, "right") - 1]) % block == 0
        doc = ids[text[first]]
        order = np.argsort(h)
        h, anchor, doc = h[order], anchor[order], doc[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        at = np.flatnonzero(new)
        several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
        flags = np.logical_or.reduceat(anchor, at).astype(np.uint8) | (several.astype(np.uint8) << 1)
        h = h[at]
        low = h >> _M(64 - bits - 38)
        buckets, bounds = _by_bucket(h, bits)
        return _rows(_SENT, [(b, key[0].as_py(), _pack(low[x:y], flags[x:y])) for b, x, y in zip(buckets.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])

    def hits(key: tuple, table: pa.Table) -> pa.Table:
        """Of a bucket: the windows that are a reference block somewhere and stand in two documents, for each chunk."""
        got = [_unpack(d) for d in table.column("data").to_pylist()]
        who = table.column("chunk").to_numpy()
        keys, flags = np.concatenate([k for k, _ in got]), np.concatenate([f for _, f in got])
        bounds = np.concatenate([[0], np.cumsum([len(k) for k, _ in got])])
        order = np.argsort(keys)
        sorted_keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
        flag = np.bitwise_or.reduceat(flags[order], at)
        count = np.diff(np.concatenate([at, [len(keys)]]))
        good = np.zeros(len(keys), bool)
        good[order] = np.repeat((flag & 1 > 0) & ((flag & 2 > 0) | (count > 1)), count)
        rows = []
        for i, (k, _) in enumerate(got):
            g = good[bounds[i] : bounds[i + 1]]
            if g.any():
                rows.append((int(who[i]), key[0].as_py(), _pack(k[g], np.zeros(int(g.sum()), np.uint8))))
        return _rows(_ANSWER, rows)

    def extend(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        """Windows of the full width around hits: distinct, with the smallest document of the chunk."""
        if not answers.num_rows or not table.num_rows:
            return _rows(_SENT, [])
        _, ids, hashes, second, text = _words(table)
        hit = np.concatenate([_unpack(d)[0] | (_M(b) << _M(38)) for b, d in zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True)])
        hit.sort()
        first, low = windows_of(hashes, text, block)
        low >>= _M(64 - bits - 38)
        found = hit[np.minimum(places_of(low, hit), len(hit) - 1)] == low
        total = np.zeros(len(hashes) + 1, np.int32)
        total[first[found] + 1] = 1
        del first, low, found  # arrays by word go as soon as they may: a chunk has a million words
        np.cumsum(total, out=total)
        start, wide = windows_of(hashes, text, width)
        near = total[start + width - block + 1] > total[start]
        start, wide = start[near], wide[near]
        del hashes, total
        check = windows_of(second, text, width, check=True)[1][near].astype("<u4")
        del second, near
        if not len(wide):
            return _rows(_SENT, [])
        doc = ids[text[start]]
        order, at = grouped(wide, check)
        doc = np.minimum.reduceat(doc[order], at)
        wide, check = wide[order[at]], check[order[at]]
        names, index = np.unique(doc, return_inverse=True)
        index = index.astype("<u2" if len(names) < 65536 else "<u4")
        buckets, bounds = _by_bucket(wide, bits)
        rows = []
        for b, x, y in zip(buckets.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            used, small = np.unique(index[x:y], return_inverse=True)
            small = small.astype("<u2" if len(used) < 65536 else "<u4")
            rows.append((b, key[0].as_py(), np.array([y - x, len(used)], "<u4").tobytes() + wide[x:y].astype("<u8").tobytes() + check[x:y].tobytes() + names[used].astype("<i8").tobytes() + small.tobytes()))
        return _rows(_SENT, rows)

    def smallest(key: tuple, table: pa.Table) -> pa.Table:
        """Of a bucket: for each chunk the windows that a smaller document of another chunk has."""
        wide, check, doc, bounds = [], [], [], [0]
        for d in table.column("data").to_pylist():
            n, m = np.frombuffer(d, "<u4", 2).tolist()
            wide.append(np.frombuffer(d, "<u8", n, 8))
            check.append(np.frombuffer(d, "<u4", n, 8 + 8 * n))
            names = np.frombuffer(d, "<i8", m, 8 + 12 * n)
            doc.append(names[np.frombuffer(d, "<u2" if m < 65536 else "<u4", n, 8 + 12 * n + 8 * m)])
            bounds.append(bounds[-1] + n)
        who = table.column("chunk").to_pylist()
        wide, check, doc = np.concatenate(wide), np.concatenate(check), np.concatenate(doc)
        order, at = grouped(wide, check)
        least = np.minimum.reduceat(doc[order], at)
        lost = np.zeros(len(wide), bool)
        lost[order] = np.repeat(least, np.diff(np.concatenate([at, [len(order)]]))) < doc[order]
        rows = []
        for i, chunk in enumerate(who):
            g = np.flatnonzero(lost[bounds[i] : bounds[i + 1]]) + bounds[i]
            if len(g):
                rows.append((chunk, key[0].as_py(), wide[g].astype("<u8").tobytes() + check[g].astype("<u4").tobytes()))
        return _rows(_ANSWER, rows)

    out_schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("repeats", T.ArrayType(T.ArrayType(T.LongType()))), *[docs.schema[c] for c in carry]])

    def cut(_key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        """Maximal repeats from the covering windows, and the text without them."""
        texts, ids, hashes, second, text = _words(table)
        start, wide = windows_of(hashes, text, width)
        check = windows_of(second, text, width, check=True)[1].astype("<u4")
        n = len(hashes)
        del hashes, second
        gone = np.zeros(len(wide), bool)
        if len(wide):
            doc = ids[text[start]]
            order, at = grouped(wide, check)
            d = doc[order]
            gone[order] = np.repeat(np.minimum.reduceat(d, at), np.diff(np.concatenate([at, [len(d)]]))) < d
            del doc, order, d, at
            if answers.num_rows:
                parts_ = [(np.frombuffer(x, "<u8", len(x) // 12), np.frombuffer(x, "<u4", len(x) // 12, len(x) // 12 * 8)) for x in answers.column("data").to_pylist()]
                far, far_check = np.concatenate([p for p, _ in parts_]), np.concatenate([p for _, p in parts_])
                by = np.argsort(far, kind="stable")
                far, far_check = far[by], far_check[by]
                place = places_of(wide, far)
                for shift in range(int(np.bincount(np.searchsorted(far, far)).max())):  # more than one step only if two windows share a hash of 64 bits
                    i = np.minimum(place + shift, len(far) - 1)
                    gone |= (far[i] == wide) & (far_check[i] == check)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, start[gone], 1)
        np.add.at(edge, start[gone] + width, -1)
        covered = np.cumsum(edge)[:-1] > 0
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        total = np.concatenate([[0], np.cumsum(covered)])
        removed = total[bounds[1:]] - total[bounds[:-1]]
        kept_text, repeats = [], []
        known = table.column("_text").is_valid().to_pylist()
        for i, t in enumerate(texts):
            if not removed[i]:
                kept_text.append((t if known[i] else None) if as_is else b" ".join(t.split()))
                repeats.append([])
                continue
            words = t.split()
            mask = covered[bounds[i] : bounds[i + 1]]
            kept_text.append(b" ".join(words[j] for j in np.flatnonzero(~mask).tolist()))
            flips = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
            repeats.append(flips.reshape(-1, 2).tolist())
        made = [table.column("_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_text, pa.binary()).cast(pa.string()), pa.array(repeats, pa.list_(pa.list_(pa.int64()))), *[table.column(f"_c{i}") for i in range(len(carry))]]
        return pa.table(made, names=[f.name for f in out_schema])

    def answered(sent: DataFrame, resolve) -> DataFrame:
        return sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(resolve, _ANSWER_DDL).repartition(parts, "chunk")

    near = answered(dealt.groupBy("chunk").applyInArrow(probe, _SENT_DDL), hits)
    wide = answered(dealt.groupBy("chunk").cogroup(near.groupBy("chunk")).applyInArrow(extend, _SENT_DDL), smallest)
    return dealt.groupBy("chunk").cogroup(wide.groupBy("chunk")).applyInArrow(cut, out_schema)


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute(rows: list[tuple[int, str | None]], width: int = 50) -> dict[int, tuple[int, int, bytes]]:
    """By a dictionary of all windows, for tests: id -> (words, removed, kept text)."""
    words = {i: (t or "").encode().split() for i, t in rows}
    least: dict[tuple, int] = {}
    for i, w in words.items():
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            least[k] = min(least.get(k, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - width + 1):
            if least[tuple(w[s : s + width])] < i:
                gone.update(range(s, s + width))
        out[i] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone))
    return out
