"""Packing depends on the rows alone."""

from turnwise.llm import packing
from turnwise.llm.queries import split_pattern, tokenizer_file


def test_pieces_do_not_depend_on_how_rows_are_stored(spark):
    rows = [(i if i % 9 else None, None if i % 11 == 0 else f"text {i} " * (40 + i % 7 * 30), f"s{i % 3}") for i in range(120)] + [(5, "twice", "s1")] * 2
    found = []
    for part in (rows, rows[::-1], rows[60:] + rows[:60]):
        docs = spark.createDataFrame(part, "doc_id bigint, text string, source string")
        for n in (1, 5):
            pieces = packing.pack(docs.coalesce(1).repartition(n), tokenizer_file("byte_bpe_50k.json"), split_pattern())
            found.append(sorted(map(str, pieces.collect())))
    assert all(f == found[0] for f in found)


def test_pieces_do_not_depend_on_the_number_of_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " * (40 + i % 7 * 30), f"s{i % 3}") for i in range(120)], "doc_id bigint, text string, source string")
    found = []
    for n in (1, 2, 7):
        monkeypatch.setattr(packing, "partitions_for", lambda *_, n=n: n)
        found.append(sorted(map(str, packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), split_pattern()).collect())))
    assert found[0] == found[1] == found[2]
