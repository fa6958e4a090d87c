"""Whole jobs of the training-data operators, and odd input: results that a cut, a cap or a weak comparison would change."""

import random
import struct
import zlib

import numpy as np
import pytest

from turnwise.llm import media, minhash, substrings, warc


def thue_morse(n):
    """A word and its complement whose polynomial hashes modulo powers of two are equal."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_that_weak_hashes_confuse(spark, size):
    x, y = thue_morse(size)
    rest = " ".join(f"w{i}" for i in range(49))
    rows = [(0, f"{x} {rest}"), (1, f"{y} {rest}"), (2, x), (3, y)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = substrings.brute(rows)
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).collect()} == {i: (n, gone) for i, (n, gone, _) in want.items()}
    near = minhash.brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()} == near and near[3] == (1, 3)


def test_urls_with_control_characters(spark):
    urls = ["http://a.com/x\ny", "http://a.com/x\r\n\r\nz", "http://a.com/ [1, 2]", "http://a.com/\x00\x7f\u2028", " http://a.com/x%0Ay\t"]
    pages = spark.createDataFrame([(i, u, f"<p>{i}" + "x" * 120) for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    got = warc.round_trip(pages).collect()
    assert sorted(r.page_id for r in got) == list(range(5)) and all(bytes(r.payload).decode().startswith(f"<p>{r.page_id}x") for r in got)
    assert warc.url_key(urls[0]) == "com,a)/x%0Ay" == warc.url_key(urls[4])


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_media_of_others(spark):
    payload = bytes(range(64)) * 40
    m = media.write_container(payload)
    spans = {p: (a, b) for p, a, b in media.walk(memoryview(m))}
    a, b = spans[b"moov", b"trak"]
    a -= 8
    # a first track without a sample table, then the whole one
    broken = box(b"trak", box(b"mdia", box(b"mdhd", bytes(24))))
    start = spans[b"moov",][0] - 8
    moved = box(b"moov", m[start + 8 : a] + broken + m[a:b])
    shifted = m[:start] + moved + m[b:]
    assert [t["samples"] for t in media.tracks(shifted[: len(shifted)])] in ([40], [])  # its offsets still point into the file
    odd = [None, b"", b"junk", m[:40], m[: len(m) - 1], box(b"moov", box(b"trak", b"")), box(b"moov", b"") * 3, b"\0\0\0\1mdat", shifted]
    df = spark.createDataFrame([(i, None if x is None else len(x), None if x is None else bytearray(x)) for i, x in enumerate(odd)], "doc_id bigint, n_bytes bigint, media binary")
    got = {r.doc_id: r for r in media.read_media(df).collect()}
    assert got[0].payload_bytes is None and got[0].feature is None and len(got) == len(odd)
    for i in (1, 2, 3, 4, 5, 6, 7):
        assert (got[i].codec, got[i].payload_bytes, got[i].tail_crc32) == ("none", 0, zlib.crc32(b"")), i


@pytest.mark.parametrize("paired", [1024, 40])
def test_partners_among_many_like_texts(spark, monkeypatch, paired):
    """300 texts of one template at similarities just below 0.75, with few true partners just above."""
    from turnwise.llm import minhash

    monkeypatch.setattr(minhash, "PAIRED", paired)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"
    base = [word() for _ in range(200)]
    tails = [[word() for _ in range(38)] for _ in range(300)]
    for k in range(12):  # a common tail of a few words more lifts a pair over 0.75
        tails[150 + k][:10] = tails[k][:10]
    rows = [(i, " ".join(base + t)) for i, t in enumerate(tails)]
    rng.shuffle(rows)
    want = {i: c for i, (_, c) in minhash.brute(rows).items()}
    assert len(set(want.values())) == 288
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("sources", [3, 150, 5000])
def test_every_source_keeps_its_proportion(spark, monkeypatch, sources):
    """Windows hold every source by its share, also where sources are stored one after another and share queues."""
    from turnwise.llm import packing

    rng = random.Random(6)
    totals = [rng.randrange(1, 1200 if sources > 200 else 20_000) for _ in range(sources)]
    mix, held = packing.Mixture(totals), np.zeros((-(-sum(totals) // packing.WINDOW), sources))
    for q, t in enumerate(totals):
        done = 0
        for start, n, w, o in sorted(mix.pieces(q, 0, t)):
            assert start == done and 0 <= o and o + n <= packing.WINDOW
            done += n
            held[w, q] += n
        assert done == t
    assert (held.sum(1)[:-1] == packing.WINDOW).all()
    ahead = np.cumsum(held, 0) - np.arange(1, len(held) + 1)[:, None] * packing.WINDOW * np.array(totals) / sum(totals)
    assert np.abs(ahead[:-1]).max() < 2 * packing.WINDOW


def test_sources_that_share_queues_are_interleaved(spark):
    from turnwise.llm import packing
    from turnwise.llm.queries import split_pattern, tokenizer_file

    rows = [(100 * s + i, "some plain words of a text " * 50, f"s{s}") for s in range(130) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    pieces = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), split_pattern()).collect()
    half, early, all_ = max(p.sequence_id for p in pieces) / 2, {}, {}
    for p in pieces:
        s = p.doc_id // 100
        all_[s] = all_.get(s, 0) + p.length
        early[s] = early.get(s, 0) + p.length * (p.sequence_id < half)
    assert len(all_) == 130 and all(0.25 < early[s] / n < 0.75 for s, n in all_.items())


def test_terms_of_clean_texts_and_covered_ones_count(spark):
    """A term in 60% of toxic and 10% of clean examples, and one of examples that have four others, are in the vocabulary."""
    from turnwise.llm import toxicity

    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 10 == 0
        words = [f"p{rng.randrange(400)}" for _ in range(30)]
        words += ["often"] * (rng.random() < (0.6 if bad else 0.1)) + [f"bad{k}" for k in range(8)] * bad
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    vocabulary = toxicity.fit(docs, marks).vocabulary
    assert {"often", *(f"bad{k}" for k in range(8))} <= set(vocabulary)


def test_literals_of_added_tokens(spark):
    """Packing has the ids of the library at its defaults."""
    import struct
    import zlib

    from tokenizers import Tokenizer

    from turnwise.llm import bpe, packing
    from turnwise.llm.queries import split_pattern, tokenizer_file

    path, text = tokenizer_file("byte_bpe_50k.json"), "a <|endoftext|> b"
    texts = [text, "<|endoftext|>", "<|endoftext|><|endoftext|>  x\n <|endoftext", "", "plain"]
    ids, bounds = bpe.TokenIds.of(path, split_pattern()).encode([t.encode() for t in texts], added=True)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275] and [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want
    (p,) = packing.pack(spark.createDataFrame([(1, text, "a")], "doc_id bigint, text string, source string"), path, split_pattern()).collect()
    assert p.doc_tokens == 5 and p.ids_crc32 == zlib.crc32(struct.pack("<5I", *want[0], 0))
