"""One-to-one speaker mappings from overlap tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _solve(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(match, u, v) of the cheapest choice, by successive shortest augmenting paths; at most as many rows as columns.

    ``match`` has the row of each column, counted from 1; u and v are the dual values, at least those of a choice are tight.
    """
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            slack = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], j0
            j1 = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[back[j0]]
            j0 = back[j0]
    return match, u, v


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one choice with the largest sum."""
    turned = gain.shape[0] > gain.shape[1]
    match = _solve(-(gain.T if turned else gain).astype(float))[0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, len(match)) if match[j]]
    return sorted((b, a) for a, b in pairs) if turned else sorted(pairs)


def first_assignment(gain: np.ndarray) -> list[int]:
    """The column of each row in the choice with the largest sum; of equal sums the first one, row by row.

    A choice is as good as the best one if and only if all its pairs are tight, so rows take their first tight column from
    which the rows behind can still be served. A column beyond the table is none.
    """
    n = max(gain.shape)
    cost = np.zeros((n, n))
    cost[: gain.shape[0], : gain.shape[1]] = -gain
    match, u, v = _solve(cost)
    tight = np.abs(cost - u[1:, None] - v[None, 1:]) <= 1e-9 * max(1.0, float(np.abs(cost).max(initial=0.0)))
    owner = (match[1:] - 1).tolist()
    tight[owner, range(n)] = True
    mine = np.argsort(owner).tolist()

    def serve(row: int, fixed: int, seen: set[int]) -> bool:
        for j in np.flatnonzero(tight[row]).tolist():
            if j in seen or 0 <= owner[j] < fixed:
                continue
            seen.add(j)
            if owner[j] < 0 or serve(owner[j], fixed, seen):
                owner[j], mine[row] = row, j
                return True
        return False

    for i in range(gain.shape[0]):
        for j in np.flatnonzero(tight[i, : mine[i]]).tolist():
            if owner[j] < i:
                continue
            moved, left = owner[j], mine[i]
            owner[j], mine[i], owner[left] = i, j, -1
            if serve(moved, i + 1, {j}):
                break
            owner[j], mine[i], owner[left] = moved, left, i
    return mine[: gain.shape[0]]


def optimal_mapping(overlaps: DataFrame, refs: tuple[str, ...] = (), hyps: tuple[str, ...] = ()) -> DataFrame:
    """(rec_id, hyp, ref, seconds): the one-to-one mapping with the most overlap; pairs without overlap are left out.

    Of equally good mappings it is the one with the first references, from one hypothesis label to the next. Labels are in
    the order of ``refs`` and ``hyps``, which take part in every recording, then by name.
    The table of a recording has a row for each pair of labels, so a group is small whatever the recording's length.
    """

    def solve(table: pd.DataFrame) -> pd.DataFrame:
        order = [[*known, *sorted(set(table[c]) - set(known))] for c, known in (("hyp", hyps), ("ref", refs))]
        (i, j) = ([{x: k for k, x in enumerate(o)}[x] for x in table[c]] for c, o in zip(("hyp", "ref"), order, strict=True))
        values = np.zeros((len(order[0]), len(order[1])))
        np.add.at(values, (i, j), table["seconds"].to_numpy())
        chosen = [(a, b) for a, b in enumerate(first_assignment(values)) if b < len(order[1]) and values[a, b] > 0]
        return pd.DataFrame([(table["rec_id"].iloc[0], order[0][a], order[1][b], values[a, b]) for a, b in chosen], columns=["rec_id", "hyp", "ref", "seconds"])

    return overlaps.groupBy("rec_id").applyInPandas(solve, "rec_id string, hyp string, ref string, seconds double")


def greedy_mapping(overlaps: DataFrame) -> DataFrame:
    """(rec_id, hyp, ref, seconds): pairs by falling overlap, each label once; ties by hyp, then ref. As a viewer maps, not a scorer."""
    ordered = overlaps.where("seconds > 0").groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("seconds")).alias("o"), "hyp", "ref"))).alias("ps"))
    pair = "struct<hyp:string,ref:string,seconds:double>"
    start = F.expr(f"cast(array() as array<{pair}>)")
    taken = F.aggregate("ps", start, lambda acc, p: F.when(F.exists(acc, lambda x: (x["hyp"] == p["hyp"]) | (x["ref"] == p["ref"])), acc).otherwise(F.array_append(acc, F.struct(p["hyp"].alias("hyp"), p["ref"].alias("ref"), (-p["o"]).alias("seconds")))))
    return ordered.select("rec_id", F.explode(taken).alias("p")).select("rec_id", "p.*")


def turn_overlaps(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """(rec_id, ref, hyp, seconds): overlap of turns by label, collars aside."""
    from turnwise.functions import overlap_seconds
    from turnwise.operators.timeline import BUCKET, bucket_of, spread

    r = spread(reference.select("rec_id", "start", "end", F.col("speaker").alias("ref")))
    h = spread(hypothesis.select("rec_id", F.col("start").alias("hs"), F.col("end").alias("he"), F.col("speaker").alias("hyp"), F.col("start"), F.col("end"))).drop("start", "end")
    first = F.greatest(bucket_of(F.col("start"), BUCKET), bucket_of(F.col("hs"), BUCKET)) == F.col("_bucket")
    both = r.join(h, ["rec_id", "_bucket"]).where(first).withColumn("s", overlap_seconds(F.col("start"), F.col("end"), F.col("hs"), F.col("he")))
    return both.where("s > 0").groupBy("rec_id", "ref", "hyp").agg(F.sum("s").alias("seconds"))


def orphan_speakers(reference: DataFrame, mapping: DataFrame) -> DataFrame:
    """(rec_id, speaker) of the reference that nothing is mapped to."""
    return reference.select("rec_id", "speaker").distinct().join(mapping.select("rec_id", F.col("ref").alias("speaker")), ["rec_id", "speaker"], "left_anti")
