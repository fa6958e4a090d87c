"""Operator 7. MinHash near-dedup by an LSH forest.

Every distinct shingle set gets a signature of 128 minhash values (a byte of each is kept). Thirty-two orders sort the
signatures, each rotated by four more values; rows with a common prefix of at least four values lie in one region and are
candidates. A first pass connects most of them cheaply: a region of up to ``WHOLE`` rows is compared whole; in a larger one
a row meets the ``WHOLE`` rows on either side, those with the longest common prefixes, of which it keeps the ``NEAR`` best,
and the hubs of its region, the rows most like a sample of it (such as the text that near copies were made of). Candidates
whose signatures agree in too few places (more than five standard deviations below 0.75) are left out; all others are
confirmed on full shingle sets, unless both are already connected by confirmed links, which changes no component.

A second pass settles every region that the first one did not compare whole, of any size, if it is not of one component:
its rows of different components whose signatures agree are joined into crowds, and all rows of a crowd that are of
different components are compared on full sets. So the first pass decides on time, not on results: at a similarity of
0.75 a pair shares no prefix of four in any order with a probability of 5e-6.

How it is spread: equal sets are one class from the start, so exact copies cost one row each. Regions are cut by range
partitions of the sorted orders, so no region, however large, has to fit in a task. Only rows that share a prefix with
another row enter the orders; that filter sends one row per prefix and task. Confirming goes in two rounds: the best candidate
of each row, then every candidate that joins two components. Regions and crowds of the second pass are cut into blocks,
and blocks meet in pairs of blocks, but for two of the largest component; what leaves a task is one link a row, never
its pairs. That work grows with the rows outside the largest component of a region times its size: many texts of one
template that are all just below the threshold are its worst case. Components come from stars over written tables. What is
broadcast is a filter of fixed size that keeps texts without candidates from moving.

Words are compared by 128-bit keyed digests, shingles by 64 bits made of those.

Defined results: a null or empty text has an empty set and is linked with nothing; a text of fewer than five words has its
whole sequence as the one shingle; rows without an id are linked with nothing and kept; rows that repeat an id are one
document; A to Z are lower-cased, other letters are not; columns not named are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import columns, id_filter, may_hold, mix, partitions_for, short_batches, text_batches, tidied, windows_of, words_of, written
from turnwise.llm.graph import components

WIDTH = 5
VALUES, ORDERS, DEPTH = 128, 32, 4
WHOLE, NEAR = 24, 3
#: Hubs of a larger region: the rows that agree most with a sample of it.
HUBS, SAMPLE = 2, 64
#: Rows of a block of the second pass, and bytes of its shingle sets, about.
PAIRED, PAIRED_BYTES = 1024, 16 << 20
#: Columns of a slab when sets are compared as a matrix.
SLAB = 4096
#: Places of two signatures that agree, at least: 128 * 0.75 less five standard deviations.
AGREE = 71
_M = np.uint64
_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)[:, None]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    hashes, _, text = words_of(texts, lower=True)
    first, h = windows_of(hashes, text, WIDTH)
    bounds = np.searchsorted(text[first], np.arange(len(texts) + 1))
    words = np.searchsorted(text, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        if (n := int(words[i + 1] - words[i])) >= WIDTH:
            out.append(np.unique(h[bounds[i] : bounds[i + 1]]))
        elif n:
            whole = windows_of(hashes[words[i] : words[i + 1]], np.zeros(n, np.int64), n)[1]
            out.append(mix(whole + _M(n)))
        else:
            out.append(np.zeros(0, _M))
    return out


def signature(s: np.ndarray) -> bytes:
    """A byte of each of 128 minhash values."""
    low = (s & _M(0xFFFFFFFF)).astype(np.uint32)
    least = np.full((VALUES, 1), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 1024):
        least = np.minimum(least, (low[None, i : i + 1024] * _MUL + _ADD).min(1, keepdims=True))
    v = least[:, 0]
    return ((v * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, key, sig): the set's size, a 128-bit digest (null if empty) and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches, 1 << 20):
            sets = shingle_sets(texts)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), pa.array([signature(s) if len(s) else None for s in sets], pa.binary())], names=["id", "n_shingles", "key", "sig"])

    return columns(docs, id_col, text_col).select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(tidied(run), "id bigint, n_shingles bigint, key binary, sig binary")


def _regions(sigs: np.ndarray) -> np.ndarray:
    """(rows, orders) keys of the regions: the order, then the least prefix."""
    value = np.zeros((len(sigs), ORDERS), np.int64)
    for d in range(DEPTH):
        value = (value << 8) | sigs[:, d::DEPTH][:, :ORDERS]
    return value | (np.arange(ORDERS, dtype=np.int64) << 32)


def _prefixes(sigs: np.ndarray) -> np.ndarray:
    """The same keys, spread over the hash space."""
    with np.errstate(over="ignore"):
        return mix(_regions(sigs).astype(_M)) >> _M(1)


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, VALUES)


def with_company(reps: DataFrame, parts: int) -> DataFrame:
    """(rep, mask): the orders in which another row has the same prefix. A task sends one row for each prefix it has."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sigs = [], []

        def flush() -> pa.RecordBatch:
            who, keys = np.concatenate(ids), _prefixes(np.concatenate(sigs))
            n = len(who)
            rep, order, key = np.repeat(who, ORDERS), np.tile(np.arange(ORDERS), n), keys.ravel()
            by = np.argsort(key, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
            count = np.diff(np.concatenate([at, [len(by)]]))
            mask = np.zeros(n, np.int64)
            shared = np.zeros(len(by), bool)
            shared[by] = np.repeat(count > 1, count)
            np.bitwise_or.at(mask, np.flatnonzero(shared) // ORDERS, np.int64(1) << order[shared])
            own = np.flatnonzero(mask)
            one = by[at]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key[one].astype(np.int64), -1 - (mix(who[own].astype(_M)) >> _M(1)).astype(np.int64)])), pa.array(np.concatenate([rep[one], who[own]])), pa.array(np.concatenate([np.int64(1) << order[one], mask[own]])), pa.array(np.concatenate([np.zeros(len(one), bool), np.ones(len(own), bool)]))],
                names=["prefix", "rep", "mask", "sure"],
            )

        for b in batches:
            if b.num_rows:
                ids.append(b.column(0).to_numpy())
                sigs.append(_sigs(b.column(1)))
            if sum(map(len, ids)) >= 100_000:
                yield flush()
                ids, sigs = [], []
        if ids:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(batches, pa.schema([("prefix", pa.int64()), ("rep", pa.int64()), ("mask", pa.int64()), ("sure", pa.bool_())]))
        if got.num_rows:
            key, rep, mask, sure = (got.column(i).to_numpy() for i in range(4))
            _, index, count = np.unique(key, return_inverse=True, return_counts=True)
            good = sure | (count[index] > 1)
            rep, mask = rep[good], mask[good]
            names, index = np.unique(rep, return_inverse=True)
            out = np.zeros(len(names), np.int64)
            np.bitwise_or.at(out, index, mask)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(out)], names=["rep", "mask"])

    sent = reps.select("rep", "sig").mapInArrow(send, "prefix bigint, rep bigint, mask bigint, sure boolean")
    return sent.repartition(parts, "prefix").mapInArrow(meet, "rep bigint, mask bigint").groupBy("rep").agg(F.expr("bit_or(mask)").alias("mask"))


def neighbours(masked: DataFrame, parts: int) -> DataFrame:
    """(a, b, agree): candidate pairs a < b from the sorted orders of (rep, sig, mask).

    Rows with an agreement of -1 are no pairs: a is the key of a region that may not have been compared whole.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sigs, who, mask = _sigs(b.column(1)), b.column(0).to_numpy(), b.column(2).to_numpy()
            for t in range(ORDERS):
                i = np.flatnonzero((mask >> t) & 1)
                if len(i):
                    turned = np.roll(sigs[i], -DEPTH * t, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), t, np.int32)), pa.array([x.tobytes() for x in turned], pa.binary()), pa.array(who[i])], names=["t", "ordered", "rep"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted; the hubs and the tail of the region at a block's end are carried to the next block."""

        def solve(prefix: np.ndarray, sig: np.ndarray, who: np.ndarray, old: int, whole: bool) -> Iterator[tuple[np.ndarray, ...]]:
            """(rows, rows, agreement) of candidates with a row from ``old`` on; then the rows to carry."""
            n = len(prefix)
            at = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            size = np.diff(np.concatenate([at, [n]]))
            # a region with a carried part is larger than what is here
            parted = (size > WHOLE) | ((np.arange(len(size)) == 0) & whole)
            large = np.repeat(parted, size)
            found: list[tuple[np.ndarray, ...]] = []

            def agreeing(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
                parts = [(sig[x[k : k + 100_000]] == sig[y[k : k + 100_000]]).sum(1) for k in range(0, len(x), 100_000)]
                agree = np.concatenate([np.zeros(0, np.int64), *parts])
                ok = agree >= AGREE
                return x[ok], y[ok], agree[ok]

            for d in range(1, min(WHOLE + 1, n)):
                i = np.flatnonzero(prefix[:-d] == prefix[d:])
                found.append(agreeing(i[i + d >= old], i[i + d >= old] + d))
            x, y, agree = (np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in range(3))
            small = ~large[x]
            yield x[small], y[small], agree[small]
            # of a large region each row keeps the best few of its neighbours
            x, y, agree = x[~small], y[~small], agree[~small]
            row, other, value = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([agree, agree])
            by = np.lexsort((other, -value, row))
            row, other, value = row[by], other[by], value[by]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
            place = np.arange(len(row)) - np.repeat(first, np.diff(np.concatenate([first, [len(row)]])))
            yield row[place < NEAR], other[place < NEAR], value[place < NEAR]
            hubs = np.zeros(0, np.int64)
            for s, m in zip(at.tolist(), size.tolist(), strict=True):
                if not large[s]:
                    hubs = np.zeros(0, np.int64)
                    continue
                sample = sig[s + np.unique(np.linspace(0, m - 1, min(SAMPLE, m)).astype(np.int64))]
                total = np.concatenate([(sig[k : min(k + 512, s + m), None, :] == sample[None]).sum((1, 2)) for k in range(s, s + m, 512)])
                hubs = s + np.argsort(-total, kind="stable")[:HUBS]
                for h in hubs.tolist():
                    r = np.arange(s, s + m)
                    r = r[(r != h) & ((r >= old) | (h >= old))]
                    yield agreeing(np.full(len(r), h), r)
            last = int(at[-1])
            tail = np.arange(max(last, n - WHOLE), n)
            stay = np.union1d(hubs[hubs >= last], tail)
            yield prefix[at[parted]], np.array([n - last > len(stay) or (whole and last == 0)]), stay

        keep: tuple | None = None
        held: list[tuple[np.ndarray, ...]] = []

        def unsettled(keys: np.ndarray) -> pa.RecordBatch:
            none = np.full(len(keys), -1)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int32())], names=["a", "b", "agree"])

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal keep, held
            parts = ([keep[:3]] if keep is not None else []) + held
            old, whole = (len(keep[0]), keep[3]) if keep is not None else (0, False)
            prefix, sig, who = (np.concatenate([p[k] for p in parts]) for k in range(3))
            *out, (open_, cut, stay) = solve(prefix, sig, who, old, whole)
            yield unsettled(open_)
            for x, y, agree in out:
                x, y, agree = x[who[x] != who[y]], y[who[x] != who[y]], agree[who[x] != who[y]]
                a, c = who[x], who[y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c)), pa.array(agree.astype(np.int32))], names=["a", "b", "agree"])
            keep, held = (prefix[stay], sig[stay], who[stay], bool(cut[0])), []

        for b in batches:
            if not b.num_rows:
                continue
            sig = _sigs(b.column(1))
            prefix = b.column(0).to_numpy().astype(np.int64) << 32
            for d in range(DEPTH):
                prefix = prefix | (sig[:, d].astype(np.int64) << (24 - 8 * d))
            if keep is None and not held:
                yield unsettled(prefix[:1])  # its region may have begun in the partition before
            end = prefix[-1:]
            held.append((prefix, sig, b.column(2).to_numpy()))
            if sum(len(h[0]) for h in held) >= 8192:
                yield from block()
        if held:
            yield from block()
        if keep is not None:
            yield unsettled(end)

    rows = masked.mapInArrow(spread, "t int, ordered binary, rep bigint")
    return rows.repartitionByRange(parts, "t", "ordered", "rep").sortWithinPartitions("t", "ordered", "rep").mapInArrow(compare, "a bigint, b bigint, agree int").groupBy("a", "b").agg(F.max("agree").alias("agree"))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows is connected with."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, label[i], least)
        np.minimum.at(after, label[j], least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _agreeing(group: np.ndarray, same: np.ndarray, own: np.ndarray, component: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of consecutive equal groups, of different components, whose signatures agree; in slabs.

    Where not ``same``, a group holds two blocks (``own``) and only pairs across them count.
    """
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([at, [len(group)]]))

    def tested(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (component[x] != component[y]) & (same[x] | (own[x] != own[y]))
        x, y = x[ok], y[ok]
        ok = np.concatenate([np.zeros(0, bool), *[(sig[x[k : k + 100_000]] == sig[y[k : k + 100_000]]).sum(1) >= AGREE for k in range(0, len(x), 100_000)]])
        return x[ok], y[ok]

    few = np.repeat(size <= WHOLE, size)
    for d in range(1, min(WHOLE, len(group))):
        x = np.flatnonzero((group[:-d] == group[d:]) & few[:-d])
        if len(x):
            yield tested(x, x + d)
    for s, m in zip(at[size > WHOLE].tolist(), size[size > WHOLE].tolist(), strict=True):
        for k in range(s, s + m, 64):
            x, y = np.meshgrid(np.arange(k, min(k + 64, s + m)), np.arange(k + 1, s + m), indexing="ij")
            yield tested(x[x < y], y[x < y])


def in_blocks(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """Rows (key, component, rep, ...) dealt to pairs of blocks (i, j) of their key, with the block they are of (own).

    Keys of one component are left out. The largest component of a key has blocks of its own, which don't meet each other.
    """
    sizes = rows.groupBy(key, "component").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    sizes = sizes.groupBy(key).agg(F.count(F.lit(1)).alias("several"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "w", "component")).alias("main")).where("several > 1")

    def blocks(n, w):
        return F.ceil(F.greatest(n / PAIRED, w / PAIRED_BYTES)).cast("int")

    sizes = sizes.select(F.col(key).alias("_k"), F.col("main.component").alias("_main"), blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("_rest"), blocks(F.col("main.n"), F.col("main.w")).alias("_most"))
    rows = rows.join(sizes, F.col(key) == F.col("_k"))
    main = F.col("component") == F.col("_main")
    rows = rows.withColumn("own", F.when(main, F.col("_rest") + F.pmod(F.xxhash64("rep"), F.col("_most"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("_rest"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(main, F.col("_rest")).otherwise(F.col("_rest") + F.col("_most")) - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("_k", "_main", "_rest", "_most", "other")


def _by_groups(batches: Iterator[pa.RecordBatch], rows: int, size: int, solve) -> Iterator[pa.RecordBatch]:
    """Call ``solve(group numbers, batch)`` on whole groups of sorted rows (key, i, j, ...), of about ``rows`` rows or ``size`` bytes at once."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        table = pa.Table.from_batches(held).combine_chunks()
        key, i, j = (table.column(c).to_numpy() for c in range(3))
        group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))])
        done = table.num_rows if last else int(np.searchsorted(group, group[-1]))
        if done:
            yield from solve(group[:done], table.slice(0, done).combine_chunks())
        held = [] if last else table.slice(done).to_batches()

    for b in batches:
        if b.num_rows:
            held.append(b)
            if sum(h.num_rows for h in held) >= rows or sum(h.nbytes for h in held) >= size:
                yield from cut(False)
    if held:
        yield from cut(True)


_LINK = ["u", "v"]


def _link_batch(who: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """One link a row: to the first row it is connected with."""
    root = _roots(len(who), x, y)
    moved = np.flatnonzero(root != np.arange(len(who)))
    return pa.RecordBatch.from_arrays([pa.array(who[moved], pa.int64()), pa.array(who[root[moved]], pa.int64())], names=_LINK)


def crowds(masked: DataFrame, labels: DataFrame, open_: DataFrame, parts: int) -> DataFrame:
    """(u, v): links that join rows of different components (node, component) in a region (key) whose signatures agree."""
    known = masked.join(labels.withColumnRenamed("node", "_n"), F.col("rep") == F.col("_n"), "left").select("rep", F.coalesce("component", "rep").alias("component"), "sig", "mask")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys, mask = _regions(_sigs(b.column(2))), b.column(3).to_numpy()
                there = ((mask[:, None] >> np.arange(ORDERS)) & 1).astype(bool)
                bounds = np.concatenate([[0], np.cumsum(there.sum(1))])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys[there]))], names=["rep", "component", "sig", "keys"])

    def compare(group: np.ndarray, t: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j, own, component, who = (t.column(c).to_numpy() for c in range(1, 6))
        pairs = list(_agreeing(group, i == j, own, component, _sigs(t.column(6))))
        x, y = (np.concatenate([np.zeros(0, np.int64), *[p[k] for p in pairs]]) for k in range(2))
        yield _link_batch(who, x, y)

    rows = known.mapInArrow(spread, "rep bigint, component bigint, sig binary, keys array<bigint>").select("rep", "component", "sig", F.explode("keys").alias("key"))
    rows = written(rows.join(open_, "key", "left_semi").select("key", "rep", "component", "sig"), "regions")
    met = in_blocks(rows.withColumn("weight", F.lit(0)), "key", "weight").select("key", "i", "j", "own", "component", "rep", "sig")
    dealt = met.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(lambda b: _by_groups(b, 4096, 64 << 20, compare), "u bigint, v bigint").where("u <> v").distinct()


def _counts(a: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, as a product of matrices over the members that two sets share."""
    members = np.concatenate(a)
    _, column, times = np.unique(members, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(a)), [len(s) for s in a])
    shared = times[column] > 1
    row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    out = np.zeros((len(a), len(a)), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, SLAB):
        x, y = np.searchsorted(column, [c, c + SLAB])
        slab = np.zeros((len(a), SLAB), np.float32)
        slab[row[x:y], column[x:y] - c] = 1
        out += slab @ slab.T
    return out


def confirm_crowds(rows: DataFrame, parts: int) -> DataFrame:
    """(u, v): links confirmed on full sets between rows (crowd, rep, component, sig, packed, weight) of different components."""

    def run(group: np.ndarray, t: pa.Table) -> Iterator[pa.RecordBatch]:
        import zstandard

        d = zstandard.ZstdDecompressor()
        at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist()
        for s, e in zip(at, [*at[1:], len(group)], strict=True):
            part = t.slice(s, e - s).combine_chunks()
            i, j, own, component, who = (part.column(c).to_numpy() for c in range(1, 6))
            pairs = list(_agreeing(group[s:e], i == j, own, component, _sigs(part.column(6))))
            x, y = (np.concatenate([np.zeros(0, np.int64), *[p[k] for p in pairs]]) for k in range(2))
            if not len(x):
                continue
            used, small = np.unique(np.concatenate([x, y]), return_inverse=True)
            sets = [shingle_sets([d.decompress(p)])[0] for p in part.column(7).take(pa.array(used)).to_pylist()]
            size = np.array([len(v) for v in sets])
            a, b = small[: len(x)], small[len(x) :]
            if len(x) > 8 * len(used):  # a crowd: all pairs at once
                both = _counts(sets)[a, b].astype(np.int64)
            else:
                both = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(a.tolist(), b.tolist(), strict=True)])
            linked = 100 * both >= 75 * (size[a] + size[b] - both)
            yield _link_batch(who[used], a[linked], b[linked])

    dealt = in_blocks(rows, "crowd", "weight").select("crowd", "i", "j", "own", "component", "rep", "sig", "packed").repartition(parts, "crowd", "i", "j").sortWithinPartitions("crowd", "i", "j")
    return dealt.mapInArrow(lambda b: _by_groups(b, 4096, 64 << 20, run), "u bigint, v bigint").where("u <> v")


def pack_texts(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(rep, packed): compressed texts of the wanted ids (rep), to be sent to the pairs.

    A filter of fixed size leaves most other texts where they are; the join then leaves out the rest.
    """
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            b = b.filter(pa.array(may_hold(shared.value, b.column(2).to_numpy())))
            for ids, texts in text_batches(iter([b]), 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([c.compress(t) for t in texts], pa.binary())], names=["rep", "packed"])

    rows = columns(docs, id_col, text_col).select(F.col(id_col).cast("bigint").alias("rep"), F.col(text_col).alias("text")).where("rep IS NOT NULL")
    packed = rows.withColumn("h", F.xxhash64("rep")).mapInArrow(tidied(run), "rep bigint, packed binary")
    # of a repeated id one text is compared
    return packed.join(wanted, "rep", "left_semi").groupBy("rep").agg(F.min("packed").alias("packed"))


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked) for each pair: 100 * intersection >= 75 * union, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        d = zstandard.ZstdDecompressor()
        last: tuple | None = None
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                ids = b.column(0).to_pylist()
                packed = b.column(2).to_pylist()
                fresh = [j for j, a in enumerate(ids) if (j == 0 and (last is None or last[0] != a)) or (j and ids[j - 1] != a)]
                own = shingle_sets([d.decompress(packed[j]) for j in fresh])
                others = shingle_sets([d.decompress(p) for p in b.column(3).to_pylist()])
                linked, at = [], dict(zip(fresh, own, strict=True))
                for j, a in enumerate(ids):
                    if j in at:
                        last = (a, at[j])
                    both = len(np.intersect1d(last[1], others[j], assume_unique=True))
                    linked.append(100 * both >= 75 * (len(last[1]) + len(others[j]) - both))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked)], names=["a", "b", "linked"])

    half = pairs.select("a", "b").join(texts.select(F.col("rep").alias("b"), F.col("packed").alias("pb")), "b")
    return half.join(texts.select(F.col("rep").alias("a"), F.col("packed").alias("pa")), "a").select("a", "b", "pa", "pb").mapInArrow(tidied(run), "a bigint, b bigint, linked boolean")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row."""
    spark = docs.sparkSession
    short_batches(spark)
    parts = min(partitions_for(docs, 16 << 20), 20_000)
    sets = written(sketch(docs, id_col, text_col), "sketches")
    reps = sets.where("id IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = written(reps, "classes")
    company = with_company(classes, parts).withColumnRenamed("rep", "_r")
    masked = written(classes.join(company, F.col("rep") == F.col("_r")).select("rep", "sig", "mask", (8 * F.col("n_shingles")).alias("weight")), "company")
    met = written(neighbours(masked, parts), "pairs")
    pairs = met.where("agree >= 0")

    def texts_of(wanted: DataFrame) -> DataFrame:
        return written(pack_texts(docs, id_col, text_col, wanted), "texts")

    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    labels = written(components_by_rounds(pairs, texts_of(written(ends, "wanted"))), "labels")
    # whatever the sorted neighbours and hubs left apart
    links = written(crowds(masked.select("rep", "sig", "mask"), labels, met.where("agree < 0").select(F.col("a").alias("key")), parts), "crowds")
    if not links.isEmpty():
        crowd = written(components(links).select(F.col("node").alias("rep"), F.col("component").alias("crowd")), "crowd")
        rows = crowd.join(masked.select("rep", "sig", "weight"), "rep").join(texts_of(crowd.select("rep")), "rep")
        rows = rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        more = written(confirm_crowds(rows, parts), "checked")
        labels = components(more.unionByName(labels.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    member = classes.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    kind = docs.schema[id_col].dataType
    return sets.select("id", "n_shingles", "key").join(member, "key", "left").select(
        F.col("id").cast(kind).alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).cast(kind).alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept")
    )


def components_by_rounds(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) of the confirmed links; pairs whose ends the first round connects are not confirmed."""
    both = pairs.select(F.col("a").alias("x"), "a", "b", "agree").unionByName(pairs.select(F.col("b").alias("x"), "a", "b", "agree"))
    best = F.max_by(F.struct("a", "b"), F.struct(F.col("agree"), -F.col("a"), -F.col("b")))
    chosen = both.groupBy("x").agg(best.alias("p")).select("p.a", "p.b").distinct()
    first = written(confirm(chosen, texts), "checked")
    labels = written(components(first.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))), "labels")
    left = pairs.join(first, ["a", "b"], "left_anti")
    left = left.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    left = left.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb").select("a", "b")
    rest = written(confirm(left, texts), "checked")
    links = rest.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return components(links.unionByName(labels.select(F.col("node").alias("u"), F.col("component").alias("v"))))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def brute(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """id -> (set size, component) from all pairs of plain sets, for tests."""
    sets = {}
    for i, t in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holds: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for g in s:
            holds.setdefault(g, []).append(i)
    seen = {(a, b) for v in holds.values() for a in v for b in v if a < b}
    for a, b in seen:
        n = len(sets[a] & sets[b])
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}
