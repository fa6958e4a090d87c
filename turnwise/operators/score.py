"""Scoring: word error rate, diarization error rate, pooled ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import ratio
from turnwise.operators.assign import optimal_mapping
from turnwise.operators.timeline import collar_holes, elementary_intervals, stab


#: Cells of a diagonal of a batch of alignments at most; a longer pair is aligned alone.
ALIGN_WORDS = 1 << 15
#: Half the cost beyond the difference of the lengths that the first band allows: so many words, or this part of the longer text.
GUESS = (16, 18)


def edit_counts(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(pairs, 3): substitutions, deletions, insertions of pairs of number arrays (reference, hypothesis).

    The edit table by its diagonals, for pairs of like lengths at once; three diagonals are held, so memory grows with the
    length alone. A cell is one integer: cost, rank of the step, deletions; the lengths give the rest. The least one is the
    cheapest step and, of equal costs, a match goes before a substitution, a deletion, an insertion.

    Alignments of at most some cost stay in a band of the table. The first band is a guess; where the cost that is found is
    beyond the band's, it is the most that the pair can cost, and its band is the second and last one.
    """
    n, m = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
    out = np.zeros((len(pairs), 3), np.int64)
    limit = np.abs(n - m) + 2 * np.maximum(GUESS[0], np.maximum(n, m) // GUESS[1])
    order = np.lexsort((m, n)).tolist()
    while order:
        # a diagonal has half as many cells as the band has diagonals, and no more than words
        cells = np.minimum(limit // 2 + 1, np.maximum(n, m)).tolist()
        at, again = 0, []
        while at < len(order):
            end, most = at, 0
            while end < len(order) and (end == at or max(most, cells[order[end]]) * (end - at + 1) <= ALIGN_WORDS):
                most = max(most, cells[order[end]])
                end += 1
            group = order[at:end]
            out[group] = _align([pairs[p] for p in group], limit[group])
            again += [p for p in group if out[p].sum() > limit[p]]
            at = end
        limit[again] = out[again].sum(1)
        order = again
    return out


def _align(pairs: list[tuple[np.ndarray, np.ndarray]], limit: np.ndarray) -> np.ndarray:
    n, m = np.array([len(r) for r, _ in pairs]), np.array([len(h) for _, h in pairs])
    rows, cols = int(n.max()), int(m.max())
    below, above = int(((limit + n - m) // 2).max()) + 1, int(((limit - n + m) // 2).max()) + 1
    bits, kind = (15, np.uint32) if max(rows, cols) < 32_000 else (31, np.uint64)
    if max(rows, cols) + 3 >= 1 << bits:
        raise ValueError(f"a text of {max(rows, cols)} words is too long to be aligned")
    rank, cost = bits, bits + 2
    substituted = kind(1 << cost)
    deleted, inserted = kind((1 << cost) + (1 << rank) + 1), kind((1 << cost) + (2 << rank))
    clear = kind(((1 << (cost + bits)) - 1) ^ (3 << rank))
    outside = kind(((1 << bits) - 2) << cost)
    ref, turned = np.full((rows, len(pairs)), -1, np.int32), np.full((cols, len(pairs)), -2, np.int32)
    for g, (r, h) in enumerate(pairs):
        ref[: len(r), g] = r
        turned[cols - len(h) :, g] = h[::-1]
    ends: dict[int, list[int]] = {}
    for g, k in enumerate((n + m).tolist()):
        ends.setdefault(k, []).append(g)
    cells = [np.zeros((rows + 1, len(pairs)), kind) for _ in range(3)]
    step, differs = np.zeros((rows + 1, len(pairs)), kind), np.zeros((rows + 1, len(pairs)), bool)
    last = np.zeros(len(pairs), kind)
    for k in range(rows + cols + 1):
        now, one, two = cells[k % 3], cells[(k - 1) % 3], cells[(k - 2) % 3]
        lo, hi = max(1, k - cols, (k - above + 1) // 2), min(rows, k - 1, (k + below) // 2) + 1
        if lo < hi:
            here, other, unlike = now[lo:hi], step[: hi - lo], differs[: hi - lo]
            np.not_equal(ref[lo - 1 : hi - 1], turned[cols - k + lo : cols - k + hi], out=unlike)
            np.multiply(unlike, substituted, out=here)
            here += two[lo - 1 : hi - 1]
            np.add(one[lo - 1 : hi - 1], deleted, out=other)
            np.minimum(here, other, out=here)
            np.add(one[lo:hi], inserted, out=other)
            np.minimum(here, other, out=here)
            here &= clear
            now[lo - 1] = outside
            if hi <= rows:
                now[hi] = outside
        if k <= cols:
            now[0] = kind(k << cost)
        if k <= rows:
            now[k] = kind((k << cost) + k)
        for g in ends.get(k, ()):
            last[g] = now[n[g], g]
    v = last.astype(np.int64)
    c, d = v >> cost, v & ((1 << bits) - 1)
    return np.stack([c - 2 * d + n - m, d, d - n + m], 1)


def wer_counts(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Adds wer (NaN on an empty reference), substitutions, deletions, insertions, reference_words to pairs of word arrays.

    Whole arrays are aligned, see ``edit_counts``; a null array gives nulls.
    """

    def align(refs: pa.Array, hyps: pa.Array) -> pa.Array:
        words = pa.concat_arrays([refs.flatten().cast(pa.string()), hyps.flatten().cast(pa.string())]).dictionary_encode().indices
        r, h = words[: len(refs.flatten())].fill_null(-1).to_numpy(), words[len(refs.flatten()) :].fill_null(-2).to_numpy()
        known = pc.and_(refs.is_valid(), hyps.is_valid()).to_pylist()
        sizes = [np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy())]) for x in (refs, hyps)]
        counts = edit_counts([(r[sizes[0][i] : sizes[0][i + 1]], h[sizes[1][i] : sizes[1][i + 1]]) for i in range(len(known))])
        fields = [pa.array(counts[:, j].astype(np.int32)) for j in range(3)]
        return pa.StructArray.from_arrays(fields, ["s", "d", "i"], mask=pa.array([not k for k in known], pa.bool_()))

    n = F.size(ref)
    # a row costs the product of its lengths: dealt out evenly, whatever the files were
    spread = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = spread.withColumn("_r", F.arrow_udf(align, "s int, d int, i int")(F.col(ref), F.col(hyp)))
    errors = F.col("_r.s") + F.col("_r.d") + F.col("_r.i")
    return out.select(*pairs.columns, ratio(errors.cast("double"), n.cast("double")).alias("wer"), F.col("_r.s").alias("substitutions"), F.col("_r.d").alias("deletions"), F.col("_r.i").alias("insertions"), n.alias("reference_words"))


def scored_intervals(reference: DataFrame, hypothesis: DataFrame, collar: float = 0.25) -> DataFrame:
    """(rec_id, start, end, mid, dur): elementary intervals with any active speaker, outside the collars."""
    edges = lambda t: t.select("rec_id", F.explode(F.array("start", "end")).alias("x"))
    bounds = edges(reference).unionByName(edges(hypothesis))
    if collar > 0:
        holes = collar_holes(reference, collar)
        bounds = bounds.unionByName(edges(holes))
    parts = elementary_intervals(bounds).withColumn("mid", (F.col("start") + F.col("end")) / 2).withColumn("dur", F.col("end") - F.col("start"))
    spans = reference.select("rec_id", "start", "end").unionByName(hypothesis.select("rec_id", "start", "end"))
    parts = stab(parts, spans, how="left_semi")
    return stab(parts, holes, how="left_anti") if collar > 0 else parts


def active(intervals: DataFrame, turns: DataFrame, name: str) -> DataFrame:
    """(rec_id, start, dur, name): a row for each turn active in an interval; turns of one label count each."""
    return stab(intervals, turns.select("rec_id", "start", "end", "speaker")).select("rec_id", "start", "dur", F.col("_s_speaker").alias(name))


def overlap_matrix(intervals: DataFrame, reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """(rec_id, ref, hyp, seconds) of the labels active together."""
    r, h = active(intervals, reference, "ref"), active(intervals, hypothesis, "hyp")
    return r.join(h.select("rec_id", "start", "hyp"), ["rec_id", "start"]).groupBy("rec_id", "ref", "hyp").agg(F.sum("dur").alias("seconds"))


def active_labels(reference: DataFrame, hypothesis: DataFrame, collar: float = 0.25) -> DataFrame:
    """(rec_id, start, dur, r, h): the labels active in each scored interval, as bags; one range join for both tables."""
    edges = lambda t: t.select("rec_id", F.explode(F.array("start", "end")).alias("x"))
    turns = reference.select("rec_id", "start", "end", F.col("speaker").alias("r"), F.lit(None).cast("string").alias("h")).unionByName(hypothesis.select("rec_id", "start", "end", F.lit(None).cast("string").alias("r"), F.col("speaker").alias("h")))
    bounds = edges(turns)
    if collar > 0:
        holes = collar_holes(reference, collar)
        bounds = bounds.unionByName(edges(holes))
    parts = elementary_intervals(bounds).withColumn("mid", (F.col("start") + F.col("end")) / 2).withColumn("dur", F.col("end") - F.col("start"))
    if collar > 0:
        parts = stab(parts, holes, how="left_anti")
    held = stab(parts, turns).select("rec_id", "start", "dur", F.col("_s_r").alias("r"), F.col("_s_h").alias("h"))
    return held.groupBy("rec_id", "start", "dur").agg(F.collect_list("r").alias("r"), F.collect_list("h").alias("h"))


def der(reference: DataFrame, hypothesis: DataFrame, collar: float = 0.25, refs: tuple[str, ...] = (), hyps: tuple[str, ...] = ()) -> DataFrame:
    """(rec_id, der, missed, false_alarm, confusion, total_reference, speaker_map) of every recording in either table.

    Active labels are bags: a label that is active twice counts twice. Without a reference everything is 0 and der NaN.
    Bags make equally good mappings differ in confusion, so ``refs`` and ``hyps`` say which one counts, see ``optimal_mapping``.
    """
    held = active_labels(reference, hypothesis, collar)
    pairs = held.select("rec_id", "dur", F.explode("r").alias("ref"), "h").select("rec_id", "dur", "ref", F.explode("h").alias("hyp"))
    mapping = optimal_mapping(pairs.groupBy("rec_id", "ref", "hyp").agg(F.sum("dur").alias("seconds")), refs, hyps)
    names = mapping.groupBy("rec_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("hyp", "ref")))).alias("speaker_map"))
    nr, nh = F.size("r"), F.size("h")
    right = F.size(F.filter("h", lambda x: F.coalesce(F.array_contains("r", F.try_element_at("speaker_map", x)), F.lit(False))))
    scored = held.join(names, "rec_id", "left").withColumn("right", F.when(F.col("speaker_map").isNull(), 0).otherwise(right))
    part = lambda n: F.sum(F.col("dur") * n)
    sums = scored.groupBy("rec_id").agg(part(nr).alias("total"), part(F.greatest(F.lit(0), nr - nh)).alias("missed"), part(F.greatest(F.lit(0), nh - nr)).alias("false_alarm"), part(F.least(nr, nh) - F.col("right")).alias("confusion"))
    every = reference.select("rec_id", F.lit(1).alias("ref")).unionByName(hypothesis.select("rec_id", F.lit(0).alias("ref"))).groupBy("rec_id").agg(F.max("ref").alias("ref"))
    out = every.join(sums, "rec_id", "left").join(names, "rec_id", "left")
    seconds = lambda c: F.when(F.col("ref") == 1, F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0))
    named = {c: seconds(F.col(c)) for c in ("missed", "false_alarm", "confusion", "total")}
    errors = named["missed"] + named["false_alarm"] + named["confusion"]
    return out.select("rec_id", ratio(errors, named["total"]).alias("der"), named["missed"].alias("missed"), named["false_alarm"].alias("false_alarm"), named["confusion"].alias("confusion"), named["total"].alias("total_reference"), F.when(F.col("ref") == 1, F.col("speaker_map")).alias("speaker_map"))


def pooled_der(scores: DataFrame, *keys: str) -> DataFrame:
    """Ratios of sums over recordings: der and its components."""
    total = F.sum("total_reference")
    share = lambda *c: ratio(F.sum(sum((F.col(x) for x in c[1:]), F.col(c[0]))), total)
    return scores.groupBy(*keys).agg(share("missed", "false_alarm", "confusion").alias("der"), share("missed").alias("missed"), share("false_alarm").alias("false_alarm"), share("confusion").alias("confusion"))


def pooled_wer(scores: DataFrame, *keys: str) -> DataFrame:
    return scores.groupBy(*keys).agg(ratio(F.sum(F.col("substitutions") + F.col("deletions") + F.col("insertions")).cast("double"), F.sum("reference_words").cast("double")).alias("wer"))
