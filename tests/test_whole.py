"""Whole jobs: results that a cut input would change."""

import random

import numpy as np
import pytest

from turnwise.operators import score
from turnwise.plans import queries


def edits(ref, hyp):
    """(substitutions, deletions, insertions) by the plain table; of equal costs a match or substitution, then a deletion."""
    rows = [[(j, 0, 0, j) for j in range(len(hyp) + 1)]]
    for i, r in enumerate(ref, 1):
        row = [(i, 0, i, 0)]
        for j, h in enumerate(hyp, 1):
            a, b, c = rows[-1][j - 1], rows[-1][j], row[-1]
            steps = [(a[0] + (r != h), 0, a[1] + (r != h), a[2], a[3]), (b[0] + 1, 1, b[1], b[2] + 1, b[3]), (c[0] + 1, 2, c[1], c[2], c[3] + 1)]
            best = min(steps)
            row.append((best[0], *best[2:]))
        rows.append(row)
    return rows[-1][-1][1:]


def test_alignment_against_brute_force(monkeypatch):
    rng = random.Random(3)
    pairs = [([rng.randrange(6) for _ in range(rng.randrange(40))], [rng.randrange(6) for _ in range(rng.randrange(40))]) for _ in range(120)]
    arrays = [(np.array(r, np.int32), np.array(h, np.int32)) for r, h in pairs]
    want = [edits(r, h) for r, h in pairs]
    for words in (1, 200, 1 << 15):
        monkeypatch.setattr(score, "ALIGN_WORDS", words)
        assert [tuple(x) for x in score.edit_counts(arrays).tolist()] == want
    long = [([rng.randrange(9) for _ in range(1100)], [rng.randrange(9) for _ in range(1050)])]
    assert [tuple(x) for x in score.edit_counts([tuple(np.array(x, np.int32) for x in p) for p in long]).tolist()] == [edits(*p) for p in long]


def test_bands_hold_the_alignment(monkeypatch):
    """A first band that is too narrow is widened by the cost that it found; a wide enough one isn't left."""
    rng = random.Random(11)
    pairs = []
    for n in range(0, 160, 4):
        ref = [rng.randrange(5) for _ in range(n)]
        kept = [w for w in ref if rng.random() < 0.86]
        pairs += [(ref, [w if rng.random() < 0.9 else 9 for w in kept]), (kept, ref), (ref, ref[n // 2 :] + ref[: n // 2]), (ref, [])]
    arrays = [(np.array(r, np.int32), np.array(h, np.int32)) for r, h in pairs]
    want = [edits(r, h) for r, h in pairs]
    for guess in ((0, 1000), (1, 20), (16, 18)):
        monkeypatch.setattr(score, "GUESS", guess)
        assert [tuple(x) for x in score.edit_counts(arrays).tolist()] == want
    limits = []
    monkeypatch.setattr(score, "_align", lambda ps, limit, f=score._align: limits.append(len(ps)) or f(ps, limit))
    monkeypatch.setattr(score, "GUESS", (0, 1000))
    score.edit_counts(arrays)
    assert len(pairs) < sum(limits) <= 2 * len(pairs)


def test_words_by_letter(spark):
    import re

    from turnwise import functions as fn

    texts = ["".join(chr(c) for c in range(a, a + 4096) if not 0xD800 <= c < 0xE000) for a in range(0, 0x11000, 4096)] + ["it's 'a' B'c'd x''y 9'z"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", fn.F.lower("t").alias("low"), fn.normalize_words(fn.F.col("t")).alias("w")).collect()
    for r in got:
        inner = re.sub(r"(?<![a-z])'|'(?![a-z])", " ", re.sub(r"[^a-z0-9' ]+", " ", r.low))
        assert r.w == inner.split()


def test_error_rates_are_of_whole_texts(spark, tmp_path):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice("abcdefgh") for _ in range(n))) for i, n in enumerate([0, 5, 20, 21, 90, 300])]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in texts:
        ref = t.split()
        kept = [w for j, w in enumerate(ref) if (j + i) % 7]
        want[i] = (*edits(ref, ["zz" if (j * 3 + i) % 11 == 0 else w for j, w in enumerate(kept)]), len(ref))
    got = queries.queries()["wer_counts"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.substitutions, r.deletions, r.insertions, r.reference_words) for r in got} == want
    (pooled,) = queries.queries()["wer_pooled"](spark, str(tmp_path)).collect()
    assert pooled.wer == pytest.approx(sum(sum(x[:3]) for x in want.values()) / sum(x[3] for x in want.values()), abs=1e-8)


def test_query_rows_meet_smaller_ids(spark, tmp_path):
    spark.createDataFrame([(i, 0, [1.0, float(i)]) for i in (0, 3, 50, 75, 100)], "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.a, r.b) for r in queries.queries()["pairwise_cosine"](spark, str(tmp_path)).collect())
    assert got == [(0, 3), (0, 50), (0, 75), (0, 100), (50, 3), (50, 75), (50, 100), (100, 3), (100, 75)]


def test_query_rows_by_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from turnwise import functions as fn
    from turnwise.operators import cluster

    rng = random.Random(7)
    rows = [(rng.choice("xyz"), i, [rng.randrange(-4, 5) / 4 for _ in range(4)]) for i in range(1500)]
    rows += [("x", 1500, [0.0] * 4), ("x", 1550, None), ("x", 1551, [1.0, None, 0.0, 0.0]), ("x", 1600, [1.0]), ("x", 1601, []), (None, 1650, [1.0] * 4), ("x", -50, [1.0] * 4), ("x", None, [1.0] * 4)]
    v = spark.createDataFrame(rows, "rec_id string, idx bigint, vec array<float>")
    w = v.select("rec_id", F.col("idx").alias("b"), F.col("vec").alias("w"))
    pairs = v.where("idx % 50 = 0").join(w, "rec_id").where("idx < b OR idx > b AND b % 50 <> 0")
    want = pairs.select("idx", "b", F.round(fn.cosine_distance(F.col("vec"), F.col("w")), 5))
    sizes = lambda bs: [len(ids) // 8 for b in bs for ids in b.column("ids").to_pylist()]
    assert sorted(map(tuple, cluster.cosine_to_queries(v, 50, 5).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    table = v.where("rec_id IS NOT NULL AND idx IS NOT NULL").toArrow().combine_chunks().to_batches()
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 100)
    assert sum(sizes(cluster._blocks(iter(table)))) == 1506 and max(sizes(cluster._blocks(iter(table)))) == 100
    halves = [k / 64 + s for k in range(-70, 200) for s in (0.0, 1e-12, -1e-12)] + [float("nan"), float("inf"), -1e-9, 2.675, 1.000005]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(halves)], "i int, x double").select("i", F.round("x", 5).alias("r"))
    assert [str(r.r) for r in df.orderBy("i").collect()] == [str(x) for x in cluster.round_half_up(np.array(halves), 5).tolist()]


def test_long_texts_make_long_recordings(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "x" * 5000), (1, 1, "assistant", "y" * 10)], "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (m,) = queries.queries()["build_mixture"](spark, str(tmp_path)).collect()
    assert m.duration > 5.0 and m.n_turns == 2
