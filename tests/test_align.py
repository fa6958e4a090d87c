import pytest

from turnwise import schema
from turnwise.operators.align import assign_words, group_segments, word_at


def words(spark, *spans):
    return spark.createDataFrame([("r", i, float(a), float(b), f"w{i}", 1.0) for i, (a, b) in enumerate(spans)], schema.WORDS)


def turns(spark, *rows):
    return spark.createDataFrame([("r", i, float(a), float(b), s) for i, (a, b, s) in enumerate(rows)], schema.TURNS)


@pytest.mark.parametrize(("word", "given", "want"), [
    ((1.0, 1.5), [(0, 2, "A"), (2, 4, "B")], "A"),
    ((1.8, 2.4), [(0, 2, "A"), (2, 4, "B")], "B"),
    ((1.5, 2.5), [(2, 4, "B"), (0, 2, "A")], "A"),
    ((1.5, 1.8), [(0, 1, "A")], "A"),
    ((2.0, 2.5), [(0, 1, "A")], "A"),
    ((5.0, 5.2), [(0, 1, "A")], None),
    ((5.0, 5.2), [], None),
    ((0.5, 0.5), [(0, 1, "A")], "A"),
    ((61.0, 61.5), [(0, 60.5, "A"), (200, 300, "B")], "A"),
    ((119.0, 121.0), [(0, 400, "A"), (119.5, 119.75, "B")], "A"),
])
def test_assign_words(spark, word, given, want):
    assert [r.speaker for r in assign_words(words(spark, word), turns(spark, *given)).collect()] == [want]


@pytest.mark.parametrize(("given", "want"), [
    ([(0, 0.5, "A"), (0.6, 1, "A")], [("A", 0.0, 1.0, "w0 w1")]),
    ([(0, 0.5, "A"), (0.6, 1, "B")], [("A", 0.0, 0.5, "w0"), ("B", 0.6, 1.0, "w1")]),
    ([(0, 0.4, "A"), (3, 3.5, "A")], [("A", 0.0, 0.4, "w0"), ("A", 3.0, 3.5, "w1")]),
    ([(0, 0.5, None), (0.6, 1, None)], [(None, 0.0, 1.0, "w0 w1")]),
    ([(0, 2, "A"), (0.5, 1, "A")], [("A", 0.0, 1.0, "w0 w1")]),
])
def test_group_segments(spark, given, want):
    df = spark.createDataFrame([("r", i, float(a), float(b), f" w{i} ", 1.0, s) for i, (a, b, s) in enumerate(given)], schema.WORDS + ", speaker string")
    got = group_segments(df).orderBy("seg_idx").collect()
    assert [(r.speaker, r.start, r.end, r.text) for r in got] == want


def test_word_at(spark):
    assert [r.text for r in word_at(words(spark, (0, 1), (0.5, 2)), 0.75).collect()] == ["w0"]


def test_every_word_appears_once(spark):
    w = words(spark, *[(i * 0.5, i * 0.5 + 0.4) for i in range(200)])
    t = turns(spark, *[(i, i + 1.5, "AB"[i % 2]) for i in range(100)])
    assert assign_words(w, t).count() == 200
