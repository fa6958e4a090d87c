"""Interval operators against hand-made cases and plain loops on random input."""

import random

import pytest

from turnwise.operators import timeline
from turnwise.streaming import live

SPANS = "rec_id string, start double, end double"


def spans(spark, rows, rec="r"):
    return spark.createDataFrame([(rec, float(a), float(b)) for a, b in rows], SPANS)


def rows(df, *cols):
    return sorted(tuple(getattr(r, c) for c in cols) for r in df.collect())


@pytest.mark.parametrize(("given", "kw", "want"), [
    ([(0, 1), (1.1, 2)], {"pad": 0.05, "min_gap": 0.3}, [(0, 2.05)]),
    ([(0, 1), (2, 3)], {"pad": 0.0}, [(0, 1), (2, 3)]),
    ([(0, 0.1)], {"pad": 0.0, "min_duration": 0.2}, []),
    ([(0.2, 1)], {"pad": 0.5}, [(0, 1.5)]),
    ([(0, 5), (1, 2), (5.25, 6)], {"pad": 0.0, "min_gap": 0.25}, [(0, 5), (5.25, 6)]),
])
def test_merge_regions(spark, given, kw, want):
    assert rows(timeline.merge_regions(spans(spark, given), **kw), "start", "end") == [(float(a), float(b)) for a, b in want]


def test_merge_regions_needs_a_gap(spark):
    with pytest.raises(ValueError):
        timeline.merge_regions(spans(spark, [(0, 1)]), min_gap=-1)


def test_touching_intervals_merge(spark):
    assert rows(timeline.merge_intervals(spans(spark, [(0, 1), (1, 2), (3, 4)])), "start", "end") == [(0.0, 2.0), (3.0, 4.0)]


@pytest.mark.parametrize(("given", "want"), [([(0, 1)], [(0, 1)]), ([(0, 4)], [(0, 1.5), (0.75, 2.25), (1.5, 3), (2.25, 3.75), (2.5, 4)]), ([(0, 1.5)], [(0, 1.5)])])
def test_slice_windows(spark, given, want):
    assert rows(timeline.slice_windows(spans(spark, given)), "start", "end") == [(float(a), float(b)) for a, b in want]


def test_random_timelines_match_plain_loops(spark):
    rng = random.Random(5)
    given = {f"r{k}": [(a := rng.randrange(0, 4000) / 64, a + rng.randrange(1, 300) / 64) for _ in range(rng.randrange(1, 30))] for k in range(40)}
    df = spark.createDataFrame([(k, a, b) for k, v in given.items() for a, b in v], SPANS)
    merged = timeline.merge_regions(df, 0.3, 0.2, 0.25)
    want = {k: live.merged(v, 0.3, 0.2, 0.25) for k, v in given.items()}
    assert rows(merged, "rec_id", "start", "end") == sorted((k, a, b) for k, v in want.items() for a, b in v)
    sliced = timeline.slice_windows(merged)
    windows = {k: live.sliced(v, 1.5, 0.75) for k, v in want.items()}
    assert rows(sliced, "rec_id", "start", "end") == sorted((k, a, b) for k, v in windows.items() for a, b in v)
    from turnwise.plans.derive import labelled_windows

    turns = timeline.windows_to_turns(labelled_windows(sliced))
    plain = {k: live.turned(v, [int(a // 3) % 3 for a, _ in v]) for k, v in windows.items()}
    assert rows(turns, "rec_id", "start", "end", "label") == sorted((k, *t) for k, v in plain.items() for t in v)


@pytest.mark.parametrize(("given", "want"), [
    ([(0, 1.5, 0), (0.75, 2.25, 0)], [(0, 2.25, 0)]),
    ([(0, 1.5, 0), (1, 2.5, 1)], [(0, 1.25, 0), (1.25, 2.5, 1)]),
    ([(0, 1, 0), (2, 3, 0)], [(0, 1, 0), (2, 3, 0)]),
])
def test_windows_to_turns(spark, given, want):
    df = spark.createDataFrame([("r", i, float(a), float(b), k) for i, (a, b, k) in enumerate(given)], "rec_id string, idx bigint, start double, end double, label int")
    assert rows(timeline.windows_to_turns(df), "start", "end", "label") == [(float(a), float(b), k) for a, b, k in want]


def test_subtract_leaves_what_holes_do_not_cover(spark):
    assert rows(timeline.subtract(spans(spark, [(0, 10)]), spans(spark, [(2, 3), (5, 12)])), "start", "end") == [(0.0, 2.0), (3.0, 5.0)]


def test_stab_is_strict_and_crosses_buckets(spark):
    points = spark.createDataFrame([("r", 0.0), ("r", 59.0), ("r", 200.0), ("r", 300.0)], "rec_id string, mid double")
    assert rows(timeline.stab(points, spans(spark, [(0, 300)])), "mid") == [(59.0,), (200.0,)]


def test_place_and_consecutive_overlap(spark):
    u = spark.createDataFrame([("r", 0, "A", 1.0, 0.5), ("r", 1, "B", 1.0, 0.5)], "rec_id string, idx bigint, speaker string, seconds double, gap double")
    assert rows(timeline.place_utterances(u), "start", "end") == [(0.0, 1.0), (1.5, 2.5)]
    t = spark.createDataFrame([("r", 0, 0.0, 2.0, "A"), ("r", 1, 1.5, 3.0, "B"), ("r", 2, 4.0, 5.0, "A")], "rec_id string, turn_idx bigint, start double, end double, speaker string")
    assert rows(timeline.consecutive_overlap(t), "overlapped_seconds") == [(0.5,)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SPANS)
    assert not timeline.merge_regions(empty).count() and not timeline.slice_windows(empty).count() and not timeline.subtract(empty, empty).count()
