import math
import random

import numpy as np
import pytest

from turnwise import schema
from turnwise.functions import normalize_words
from turnwise.operators import assign, score


def turns(spark, rows):
    return spark.createDataFrame([("r", i, float(a), float(b), s) for i, (a, b, s) in enumerate(rows)], schema.TURNS)


@pytest.mark.parametrize(("ref", "hyp", "collar", "want"), [
    ([(0, 10, "A")], [(0, 10, "X")], 0, {"der": 0.0}),
    ([(0, 10, "A")], [(0, 8, "A")], 0, {"der": 0.2, "missed": 2.0}),
    ([(0, 5, "A"), (5, 10, "B")], [(0, 5, "S1"), (5, 10, "S0")], 0, {"der": 0.0}),
    ([(0, 5, "A"), (5, 10, "B")], [(0, 10, "S")], 0, {"der": 0.5, "confusion": 5.0}),
    ([(0, 5, "A")], [(0, 5, "X"), (5, 8, "Y")], 0, {"der": 0.6, "false_alarm": 3.0}),
    ([(0, 10, "A"), (4, 6, "B")], [(0, 10, "A")], 0, {"total_reference": 12.0, "missed": 2.0, "der": 1 / 6}),
    ([(0, 10, "A")], [(0.2, 10, "A")], 0.25, {"der": 0.0}),
    ([(0, 4, "A")], [], 0, {"der": 1.0, "missed": 4.0}),
    ([], [(0, 1, "X")], 0.25, {"der": math.nan, "missed": 0.0, "false_alarm": 0.0, "total_reference": 0.0}),
    ([(0, 10, "A")], [(0, 10, "X"), (0, 10, "X")], 0, {"false_alarm": 10.0, "confusion": -10.0, "der": 0.0}),
    ([(0, 0.4, "A")], [(0, 0.4, "X")], 0.25, {"der": math.nan}),
])
def test_der(spark, ref, hyp, collar, want):
    (row,) = score.der(turns(spark, ref), turns(spark, hyp), collar).collect()
    for k, v in want.items():
        assert row[k] == pytest.approx(v, nan_ok=True)


def test_speaker_map(spark):
    (row,) = score.der(turns(spark, [(0, 5, "A"), (5, 10, "B")]), turns(spark, [(0, 5, "S1"), (5, 10, "S0")]), 0).collect()
    assert row.speaker_map == {"S1": "A", "S0": "B"}


@pytest.mark.parametrize(("ref", "hyp", "want"), [
    ("a b c", "a b c", (0.0, 0, 0, 0)), ("a b c", "a x c", (1 / 3, 1, 0, 0)), ("a b c", "a c", (1 / 3, 0, 1, 0)), ("a c", "a b c", (0.5, 0, 0, 1)),
    ("the cat sat on the mat", "the cat sat mat", (2 / 6, 0, 2, 0)), ("", "x", (math.nan, 0, 0, 1)), ("a", "x y z", (3.0, 1, 0, 2)), ("a", "", (1.0, 0, 1, 0)), ("", "", (math.nan, 0, 0, 0)),
])
def test_wer(spark, ref, hyp, want):
    (r,) = score.wer_counts(spark.createDataFrame([(ref.split(), hyp.split())], "ref array<string>, hyp array<string>")).collect()
    assert (r.wer, r.substitutions, r.deletions, r.insertions) == pytest.approx(want, nan_ok=True)


def backtrace(ref, hyp):
    d = np.zeros((len(ref) + 1, len(hyp) + 1), int)
    d[:, 0], d[0] = range(len(ref) + 1), range(len(hyp) + 1)
    for i in range(1, len(ref) + 1):
        for j in range(1, len(hyp) + 1):
            d[i, j] = min(d[i - 1, j - 1] + (ref[i - 1] != hyp[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
    i, j, n = len(ref), len(hyp), [0, 0, 0]
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + (ref[i - 1] != hyp[j - 1]):
            n[0] += ref[i - 1] != hyp[j - 1]
            i, j = i - 1, j - 1
        elif i and d[i, j] == d[i - 1, j] + 1:
            n[1] += 1
            i -= 1
        else:
            n[2] += 1
            j -= 1
    return n


def test_wer_on_random_pairs(spark):
    rng = random.Random(3)
    pairs = [([rng.choice("abc") for _ in range(rng.randrange(9))], [rng.choice("abc") for _ in range(rng.randrange(9))]) for _ in range(200)]
    for r in score.wer_counts(spark.createDataFrame(pairs, "ref array<string>, hyp array<string>")).collect():
        assert [r.substitutions, r.deletions, r.insertions] == backtrace(r.ref, r.hyp)


@pytest.mark.parametrize(("text", "want"), [("Hello, World!", ["hello", "world"]), ("It's five o'clock", ["it's", "five", "o'clock"]), ("' quoted '", ["quoted"]), ("  3   little  pigs ", ["3", "little", "pigs"]), ("Été", ["t"]), ("", [])])
def test_normalize(spark, text, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(normalize_words(F.col("t")).alias("w")).first().w == want


def test_pooled_ratios(spark):
    cells = spark.createDataFrame([("a", 10.0, 0.0, 0.0, 100.0), ("b", 0.0, 0.0, 1.0, 10.0)], "rec_id string, missed double, false_alarm double, confusion double, total_reference double")
    assert score.pooled_der(cells).first().der == pytest.approx(11 / 110)
    assert math.isnan(score.pooled_der(cells.where("false")).first().der)


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for _ in range(60):
        g = rng.integers(0, 9, (rng.integers(1, 5), rng.integers(1, 5))).astype(float)
        small, large = sorted(g.shape)
        w = g if g.shape[0] == small else g.T
        best = max(sum(w[i, p[i]] for i in range(small)) for p in permutations(range(large), small))
        assert sum(g[i, j] for i, j in assign.best_assignment(g)) == best


def test_greedy_mapping_is_greedy(spark):
    o = spark.createDataFrame([("r", "A", "X", 5.0), ("r", "A", "Y", 4.0), ("r", "B", "X", 4.0), ("r", "B", "Y", 0.0)], "rec_id string, ref string, hyp string, seconds double")
    assert [(r.hyp, r.ref) for r in assign.greedy_mapping(o).collect()] == [("X", "A")]
    assert {(r.hyp, r.ref) for r in assign.optimal_mapping(o).collect()} == {("Y", "A"), ("X", "B")}
    ref = turns(spark, [(0, 1, "A"), (1, 2, "B")])
    assert [r.speaker for r in assign.orphan_speakers(ref, assign.greedy_mapping(o)).collect()] == ["B"]


def test_ties_of_mappings_have_an_order(spark):
    from itertools import permutations

    rng = np.random.default_rng(2)
    for _ in range(200):
        g = rng.integers(0, 3, (rng.integers(1, 6), rng.integers(1, 6))).astype(float)
        n = max(g.shape)
        w = np.zeros((n, n))
        w[: g.shape[0], : g.shape[1]] = g
        want = max(permutations(range(n)), key=lambda p: (sum(w[i, p[i]] for i in range(n)), [-x for x in p]))
        assert assign.first_assignment(g) == list(want[: len(g)])
    equal = spark.createDataFrame([("r", a, b, 1.0) for a in ("assistant", "system", "user") for b in ("S1", "S2")], "rec_id string, ref string, hyp string, seconds double")
    found = lambda *o: {r.hyp: r.ref for r in assign.optimal_mapping(equal, *o).collect()}
    assert found() == {"S1": "assistant", "S2": "system"}
    assert found(("user", "assistant", "system")) == {"S1": "user", "S2": "assistant"}
    assert found(("user", "assistant", "system"), ("S0", "S1", "S2")) == {"S1": "assistant", "S2": "system"}


def test_der_takes_the_mapping_of_its_sql(spark, tmp_path):
    """Two mappings of this recording are equally good, but differ in confusion, as a speaker's turns overlap each other."""
    duckdb = pytest.importorskip("duckdb")
    from turnwise.plans import queries

    lengths = [35, 139, 21, 226, 39, 70, 47]
    rows = [(4051, turn, ("user", "assistant")[turn % 2], " ".join(["x"] * n)) for turn, n in enumerate(lengths)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["der_components"]).fetchall()
    assert sorted(map(tuple, queries.queries()["der_components"](spark, str(tmp_path)).collect())) == sorted(want)
