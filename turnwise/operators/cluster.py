"""Speaker clustering by average linkage on cosine distance."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Distances that are computed at once at most.
BLOCK = 1 << 21
#: Rows that are recomputed ahead of their turn, since a product of matrices is cheaper than one for each row.
AHEAD = 24


def average_linkage(vectors: np.ndarray, distance_threshold: float = 0.6, num_speakers: int | None = None) -> list[int]:
    """Labels by order of first appearance. Merges the closest groups while they are within the threshold, or more than k.

    Vectors must not be zero. The mean distance of two groups is one less the product of their mean unit vectors, so means
    stand for the table of distances and memory is linear in the windows; time is quadratic. A row keeps its nearest group,
    its distance and a bound for all others. No merge brings a group nearer than its nearer part was, so bounds last, and
    a row is only computed again when its bound is the least of all. Equal vectors are one group from the start.
    """
    x = np.asarray(vectors, float)
    n = len(x)
    if n < 2:
        return [0] * n
    norms = np.linalg.norm(x, axis=1)
    if not np.all(norms > 0):
        raise ValueError("a zero vector has no cosine distance")
    x = x / norms[:, None]
    least = 1 if num_speakers is None else max(1, num_speakers)
    bound = distance_threshold if num_speakers is None else np.inf
    parent, size, rows = np.arange(n), np.ones(n), np.arange(n)
    _, first, which, many = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
    if least <= len(first) < n and bound >= 0:
        parent = first[which.reshape(-1)]
        order = np.argsort(first)
        rows, size = first[order], many[order].astype(float)
    mean, left = x[rows].copy(), len(rows)
    del x, which
    near, value, second, fresh = np.zeros(left, int), np.full(left, -np.inf), np.full(left, -np.inf), np.zeros(left, bool)
    live = np.ones(left, bool)

    def compute(ids: np.ndarray) -> None:
        step = max(1, BLOCK // len(mean))
        for at in range(0, len(ids), step):
            part = ids[at : at + step]
            d = mean[part] @ mean.T
            np.subtract(1.0, d, out=d)
            d[:, ~live] = np.inf
            k = np.arange(len(part))
            d[k, part] = np.inf
            near[part] = d.argmin(1)
            value[part] = d[k, near[part]]
            d[k, near[part]] = np.inf
            second[part] = d.min(1)
            fresh[part] = True

    if left > least:
        compute(np.arange(left))
    while left > least:
        i = int(value.argmin())
        if not fresh[i]:
            stale = np.flatnonzero(live & ~fresh)
            bounds = value[stale]
            until = value[fresh].min(initial=np.inf)
            if np.isfinite(until) and len(stale) > AHEAD:
                until = max(until, np.partition(bounds, AHEAD - 1)[AHEAD - 1])
            compute(stale[bounds <= until])
            continue
        j = int(near[i])
        if value[i] > bound:
            break
        others = [float(second[k] if fresh[k] and near[k] == o else value[k]) for k, o in ((i, j), (j, i))]
        hit = np.flatnonzero(fresh & ((near == i) | (near == j)))
        a, b = size[i], size[j]
        gone = near[hit] == j
        mine, other = np.where(gone, b, a), np.where(gone, a, b)
        value[hit] = np.minimum(second[hit], (mine * value[hit] + other * second[hit]) / (a + b))
        i, j = min(i, j), max(i, j)
        mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (a + b)
        size[i] = a + b
        hit = np.append(hit, i)
        value[i] = min(others)
        second[hit], fresh[hit] = value[hit], False
        live[j], fresh[j], value[j] = False, False, np.inf
        parent[rows[j]] = rows[i]
        left -= 1
        if left * 4 < len(live) * 3 and len(live) > 64:
            to = np.cumsum(live) - 1
            # a stale row's nearest group may be gone; it isn't read before the row is computed again
            rows, mean, size, near, value, second, fresh = (v[live] for v in (rows, mean, size, to[near], value, second, fresh))
            live = np.ones(left, bool)
    # a group's first member leads it, so leaders have smaller numbers
    names: dict[int, int] = {}
    labels = []
    for k in range(n):
        parent[k] = parent[parent[k]]
        labels.append(names.setdefault(int(parent[k]), len(names)))
    return labels


def cluster_embeddings(embeddings: DataFrame, distance_threshold: float = 0.6, num_speakers: int | None = None) -> DataFrame:
    """(rec_id, idx, label) from (rec_id, idx, vec); a recording's windows are clustered together, so they meet in a task."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("idx")
        return pd.DataFrame({"rec_id": table["rec_id"], "idx": table["idx"], "label": average_linkage(np.stack(table["vec"].to_numpy()), distance_threshold, num_speakers)})

    return embeddings.select("rec_id", "idx", "vec").groupBy("rec_id").applyInPandas(run, "rec_id string, idx bigint, label int")


def relabel_first_appearance(labels: DataFrame) -> DataFrame:
    """(rec_id, idx, label): labels numbered by where they first appear."""
    first = F.min("idx").over(Window.partitionBy("rec_id", "label"))
    return labels.withColumn("_f", first).select("rec_id", "idx", (F.dense_rank().over(Window.partitionBy("rec_id").orderBy("_f")) - 1).alias("label"))


def centroids(embeddings: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, centroid): the unit mean vector, computed by component."""
    means = embeddings.select(*keys, F.posexplode("vec").alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    listed = means.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    from turnwise.functions import unit

    return listed.select(*keys, "n", unit(F.col("m")).alias("centroid"))


#: Vectors of a block at most; a pair of blocks is one product of matrices.
BLOCK_ROWS = 512


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec_id, size, ids, values): vectors of one recording and one size by blocks; a size of -1 is a vector with nulls."""
    names = ["rec_id", "size", "ids", "vecs"]
    for batch in batches:
        vec = batch.column("vec")
        flat = vec.flatten()
        held = pc.fill_null(pc.list_value_length(vec), 0).to_numpy()
        at, size = np.cumsum(held) - held, np.where(vec.is_valid().to_numpy(zero_copy_only=False), held, -1)
        if flat.null_count:
            size[np.repeat(np.arange(len(size)), held)[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
        values = flat.to_numpy(zero_copy_only=False).astype(np.float32 if flat.type == pa.float32() else np.float64, copy=False)
        ids, recs = batch.column("idx").to_numpy(), batch.column("rec_id").dictionary_encode()
        codes = recs.indices.to_numpy()
        for code, n in sorted(set(zip(codes.tolist(), size.tolist(), strict=True))):
            rows = np.flatnonzero((codes == code) & (size == n))
            parts = [rows[k : k + BLOCK_ROWS] for k in range(0, len(rows), BLOCK_ROWS)]
            vecs = [values[at[p][:, None] + np.arange(max(n, 0))].tobytes() for p in parts]
            columns = [pa.array([recs.dictionary[code].as_py()] * len(parts), pa.string()), pa.array([n] * len(parts), pa.int32()), pa.array([ids[p].tobytes() for p in parts], pa.binary()), pa.array(vecs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)


def round_half_up(x: np.ndarray, places: int) -> np.ndarray:
    """As the engine rounds: halves of the shortest decimal form go away from zero."""
    scaled = x * 10.0**places
    with np.errstate(invalid="ignore"):
        near = np.rint(scaled)
        out = near / 10.0**places + 0.0
        ties = np.flatnonzero(np.isfinite(x) & (np.abs(np.abs(scaled - near) - 0.5) < 1e-6))
    for k in ties.tolist():
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) + 0.0
    return out


def cosine_to_queries(embeddings: DataFrame, every: int, places: int) -> DataFrame:
    """(a, b, distance): the rows whose idx is a multiple of ``every`` with all other rows of their recording.

    A pair of two such rows counts once; a zero vector counts as of norm 1; nulls, or vectors of two sizes, have no distance.
    All pairs are the result, so the work is quadratic. Vectors move by blocks: blocks of queries are copied to each salt,
    blocks of rows go to one, so a recording is spread over tasks, and a task holds a pair of blocks at a time.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(vecs: bytes, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
            x = np.frombuffer(vecs, np.float32 if len(vecs) == 4 * rows * n else np.float64).reshape(rows, n).astype(float)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            return x, np.where(norm > 0, norm, 1.0)

        for batch in batches:
            for r in range(batch.num_rows):
                n, m, ids, vecs, ids2, vecs2 = (batch.column(c)[r].as_py() for c in ("size", "size2", "ids", "vecs", "ids2", "vecs2"))
                a, b = np.frombuffer(ids, np.int64), np.frombuffer(ids2, np.int64)
                keep = (a[:, None] < b) | ((a[:, None] > b) & (b % every != 0))
                count = keep.sum(1)
                if n == m >= 0:
                    (x, p), (y, q) = matrix(vecs, len(a), n), matrix(vecs2, len(b), m)
                    distance = pa.array(round_half_up((1.0 - x @ y.T / (p[:, None] * q))[keep], places))
                else:
                    distance = pa.nulls(int(count.sum()), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a, count)), pa.array(np.broadcast_to(b, keep.shape)[keep]), distance], ["a", "b", "distance"])

    known = embeddings.select("rec_id", F.col("idx").cast("bigint").alias("idx"), "vec").where("rec_id IS NOT NULL AND idx IS NOT NULL")
    made = "rec_id string, size int, ids binary, vecs binary"
    parts = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = min(parts, 64)
    queries = known.where(F.col("idx") % every == 0).mapInArrow(_blocks, made).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = known.mapInArrow(_blocks, made).select("rec_id", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int").alias("salt"), F.col("size").alias("size2"), F.col("ids").alias("ids2"), F.col("vecs").alias("vecs2"))
    both = rows.repartition(parts, "rec_id", "salt").hint("merge").join(queries, ["rec_id", "salt"])
    return both.select("size", "size2", "ids", "vecs", "ids2", "vecs2").mapInArrow(pairs, "a bigint, b bigint, distance double")
