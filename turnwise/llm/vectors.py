"""Operator 3. Embedding near-dedup by a pivot-permutation index.

Reference points (pivots) are chosen from a bounded, hash-ordered sample (``SAMPLE``): at most ``PIVOTS`` of each length, none
near another, so that a dense group doesn't take them all; how near is near follows the data (``APART``), so vectors with a
direction in common have pivots too. A vector is described by its ``NEAREST`` nearest pivots in order. Inverted lists are
kept by label and triple of pivots, so two vectors that meet in a list share at least three pivots. The lists first hold
ids and descriptions alone: from the counts of shared pivots each list keeps the rows of the pairs whose first three
common pivots it is (a pair has one such list), and only those fetch their vectors, for the cosine in double precision.

How it is spread: exact copies (same label and components) are one class with a multiplicity. A list with more than
``LIST`` members is cut into blocks, and blocks meet in pairs of blocks, so no list has to fit in a task; a list's members
are compared as matrices, and what leaves a task is one row for each member, one count for each member and one link for each
member and component (the pairs themselves are not emitted). Only the pivots (bounded by their number) are broadcast.

The one approximation: a pair with fewer than three common pivots is not met.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null label,
link with nothing and are their own component; vectors are scaled by their largest component first, so squares of very
large or small components neither overflow nor vanish; vectors of different length do not link; rows that repeat an id are one
node, counted once a row; a null id has a null component and is kept; columns not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import columns, short_batches, written
from turnwise.llm.graph import components

PIVOTS, NEAREST, SHARED = 256, 7, 3
#: Pivots come from so many vectors at most. They are as far apart (a cosine) as the first of these that leaves ``ENOUGH``.
SAMPLE, APART, ENOUGH = 1024, (0.7, 0.8, 0.88, 0.94, 0.97), 64
LIST, SMALL = 2048, 64
THRESHOLD = 0.98
_TRIPLES = np.array(list(combinations(range(NEAREST), SHARED)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def spread_pivots(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """For each length up to PIVOTS unit vectors of the sample, in its order, none too near an earlier one."""
    out: dict[int, np.ndarray] = {}
    for dim in {len(v) for v in sample}:
        x = unit(np.array([v for v in sample if len(v) == dim], np.float64))
        for apart in APART:
            known = x[:1]
            for v in x[1:]:
                if len(known) < PIVOTS and (known @ v).max() < apart:
                    known = np.concatenate([known, v[None]])
            if len(known) > len(out.get(dim, ())):
                out[dim] = known
            if len(known) >= ENOUGH:
                break
    return out


def describe(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(cls, label, dim, list, near): a row for each class and triple of its nearest pivots."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column(2).value_lengths().to_numpy()
            values, ends = b.column(2).flatten().to_numpy(), np.cumsum(lengths)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                x = unit(values[(ends[at] - dim)[:, None] + np.arange(dim)].astype(np.float64))
                p = shared.value.get(dim)
                if p is None:  # a length that the sample lacks has fixed random pivots
                    p = shared.value.setdefault(dim, np.random.default_rng(dim).normal(size=(PIVOTS, dim)))
                order = np.sort(np.argsort(-x @ p.T, axis=1, kind="stable")[:, :NEAREST], axis=1)
                if order.shape[1] >= SHARED:
                    t = _TRIPLES[_TRIPLES.max(1) < order.shape[1]]
                    keys = (order[:, t[:, 0]] * PIVOTS + order[:, t[:, 1]]) * PIVOTS + order[:, t[:, 2]]
                else:
                    keys = np.full((len(at), 1), -1)
                row = np.repeat(at, keys.shape[1])
                near = pa.array([o.tobytes() for o in order.astype(np.int16)], pa.binary()).take(pa.array(np.repeat(np.arange(len(at)), keys.shape[1])))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.full(len(row), dim), pa.int32()), pa.array(keys.ravel(), pa.int32()), near], names=["cls", "label", "dim", "list", "near"])

    return classes.select("cls", "label", "vec").mapInArrow(run, f"cls bigint, label {dict(classes.dtypes)['label']}, dim int, list int, near binary")


def _blocks(group: np.ndarray, own: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, rows) whose product holds every pair of a group of consecutive rows; small groups are taken together."""
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    bounds = [*at.tolist(), len(group)]
    start = 0
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b - a > SMALL:
            for x in range(a, b, 512):
                for y in range(x, b, 512):
                    yield np.arange(x, min(x + 512, b)), np.arange(y, min(y + 512, b))
            start = b
        elif k + 1 == len(at) or bounds[k + 2] - b > SMALL or bounds[k + 2] - start > 4 * SMALL:
            yield np.arange(start, b), np.arange(start, b)
            start = b


def _own_pairs(group: np.ndarray, own: np.ndarray, cross: np.ndarray, lists: np.ndarray, near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of a group (where ``cross``, of different blocks) that have its list as their first three common pivots.

    That is so if of the pivots up to the list's last one they share three and no more.
    """
    last = lists % PIVOTS
    for a, b in _blocks(group, own, cross):
        if near.shape[1] < SHARED:
            same = np.ones((len(a), len(b)), bool)
        else:
            held = np.zeros((2, max(len(a), len(b)), PIVOTS), np.float32)
            for side, rows in enumerate((a, b)):
                r, c = np.nonzero(near[rows] <= last[rows][:, None])
                held[side, r, near[rows][r, c]] = 1
            same = held[0, : len(a)] @ held[1, : len(b)].T == SHARED
        x, y = np.nonzero(same & (group[a][:, None] == group[b][None]))
        x, y = a[x], b[y]
        ok = (x < y) & (~cross[x] | (own[x] != own[y]))
        yield x[ok], y[ok]


def _links(group: np.ndarray, own: np.ndarray, cross: np.ndarray, lists: np.ndarray, near: np.ndarray, vec: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``_own_pairs`` with so large a cosine."""
    none = np.zeros(0, np.int64)
    out = [(none, none)]
    for x, y in _own_pairs(group, own, cross, lists, near):
        for k in range(0, len(x), 100_000):
            i, j = x[k : k + 100_000], y[k : k + 100_000]
            good = np.einsum("ij,ij->i", vec[i], vec[j]) >= threshold
            out.append((i[good], j[good]))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected with."""
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


_KEYS = ["label", "dim", "list", "x", "y"]


def _whole_groups(batches: Iterator[pa.RecordBatch], solve) -> Iterator[pa.RecordBatch]:
    """Call ``solve`` on tables of whole groups (label, dim, list, x, y) of sorted rows, of about 16,384 rows at once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) < 16_384:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(t.num_rows - 1, bool)
        for c in _KEYS:
            v = t.column(c).to_numpy()
            change |= v[1:] != v[:-1]
        cut = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
        if cut:
            yield from solve(t.slice(0, cut).combine_chunks())
        held = t.slice(cut).to_batches()
    if held and sum(h.num_rows for h in held):
        yield from solve(pa.Table.from_batches(held).combine_chunks())


def _by_dim(t: pa.Table) -> Iterator[tuple[int, pa.Table, np.ndarray, np.ndarray]]:
    """(length, its rows, groups, descriptions) of sorted rows."""
    dims = t.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        part = t.filter(pa.array(dims == dim)).combine_chunks()
        new = np.zeros(part.num_rows, bool)
        for c in _KEYS:
            v = part.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        yield dim, part, np.cumsum(new), np.frombuffer(b"".join(part.column("near").to_pylist()), np.int16).reshape(part.num_rows, -1).astype(np.int64)


def link(described: DataFrame, classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(cls, n, other): linked rows of a class (copies counted) and links (other) that join its list's components."""
    keys = ["label", "dim", "list"]
    sizes = described.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = described.join(sizes.withColumn("blocks", F.ceil(F.col("size") / LIST).cast("int")).drop("size"), keys)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks").cast("bigint")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("x", F.least("own", "with")).withColumn("y", F.greatest("own", "with")).select(*_KEYS, "own", "cls", "near")
    parts = int(described.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def paired(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for _, part, group, near in _by_dim(t):
            lists, x, y, own = (part.column(c).to_numpy() for c in ("list", "x", "y", "own"))
            used = np.zeros(part.num_rows, bool)
            for i, j in _own_pairs(group, own, x != y, lists, near):
                used[i] = used[j] = True
            yield from part.filter(pa.array(used)).to_batches()

    def verify(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for dim, part, group, near in _by_dim(t):
            lists, x, y, own, cls, copies = (part.column(c).to_numpy() for c in ("list", "x", "y", "own", "cls", "copies"))
            vec = unit(part.column("vec").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim))
            i, j = _links(group, own, x != y, lists, near, vec, threshold)
            n = np.zeros(len(cls), np.int64)
            np.add.at(n, i, copies[j])
            np.add.at(n, j, copies[i])
            linked = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(cls[linked]), pa.array(n[linked]), pa.array(cls[_roots(len(cls), i, j)[linked]])], names=["cls", "n", "other"])

    kinds = f"label {dict(classes.dtypes)['label']}, dim int, list int, x int, y int, own int, cls bigint, near binary"
    met = rows.repartition(parts, *_KEYS).sortWithinPartitions(*_KEYS, "cls").mapInArrow(lambda b: _whole_groups(b, paired), kinds)
    met = met.join(classes.select("cls", "copies", "vec"), "cls").select(*_KEYS, "own", "cls", "copies", "near", "vec")
    return met.repartition(parts, *_KEYS).sortWithinPartitions(*_KEYS, "cls").mapInArrow(lambda b: _whole_groups(b, verify), "cls bigint, n bigint, other bigint")


def near_duplicate_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    short_batches(table.sparkSession)
    # single precision stays as it is until it is compared
    kept = "array<float>" if dict(table.dtypes)[vec_col] == "array<float>" else "array<double>"
    base = columns(table, id_col, vec_col, label_col).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast(kept).alias("vec"))
    fit = F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("vec").isNotNull()
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    # a minus zero is a zero
    base = base.withColumn("vec", F.when(fit & sound, F.transform("vec", lambda x: x + F.lit(0).cast(kept[6:-1]))))
    base = base.withColumn("key", F.when(F.col("vec").isNotNull(), F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.transform("vec", lambda x: x.cast("string")), ",")), 256)))
    classes = base.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("cls"), F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "vectors")
    sample = classes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vec").collect()
    pivots = spread_pivots([r.vec for r in sample])
    found = written(link(describe(classes, pivots), classes, threshold), "links")
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    labels = components(found.where("cls <> other").select(F.col("cls").alias("u"), F.col("other").alias("v")))
    # several classes may have one smallest id only where an id is repeated; their links add up
    member = classes.select("key", "cls", "copies").join(counts, "cls", "left").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    member = member.select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "cls").alias("component"))
    kind = table.schema[id_col].dataType
    return base.select("id", "key").join(member, "key", "left").select(
        F.col("id").cast(kind).alias(id_col), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").cast("bigint").alias("component_id"), F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept")
    )


def brute(rows: list[tuple], threshold: float = THRESHOLD) -> dict[int, tuple[int, int]]:
    """id -> (links, component) from all pairs of equal labels, for tests."""
    good = [(i, l, np.array(v, np.float64)) for i, v, l in rows if l is not None and v is not None and len(v) and all(x is not None for x in v) and np.isfinite(np.array(v, np.float64)).all() and np.any(v)]
    links = {i: 0 for i, *_ in rows}
    parent = {i: i for i in links}

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, l, v) in enumerate(good):
        for j, m, w in good[x + 1 :]:
            if l == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (links[i], find(i)) for i in links}
