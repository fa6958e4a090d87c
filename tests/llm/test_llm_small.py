"""Edge cases and brute-force comparisons of the training-data operators on small tables."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from turnwise.llm import bpe, media, minhash, packing, pii, substrings, token_counts, toxicity, vectors, warc
from turnwise.llm.queries import split_pattern, tokenizer_file

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = ("word " * 30_000).strip()
PANGRAMS = ["The quick brown fox jumps over the lazy dog and runs", "pack my box with five dozen liquor jugs today", "how vexingly quick daft zebras jump", "sphinx of black quartz judge my vow"]


def table(spark, rows, extra=True):
    """Documents with columns whose names the operators might use themselves."""
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    for name in ("chunk", "bucket", "data", "id", "_id", "_text", "key", "sig", "rep", "ids", "score", "kept", "queue", "part") if extra else ():
        df = df.selectExpr("*", f"cast(null as string) as `{name}`")
    return df


def edge_rows():
    same = " ".join(PANGRAMS)
    return [(0, same, "a"), (1, None, None), (2, "", "b"), (3, LONG, "a"), (4, same, "a"), (5, same, "a"), (5, same, "a"), (6, "é中 \U0001f600\t\r\n x", "c"), (None, same, "a"), (7, "one two", "a"), (8, "ONE two", "a"), (9, " \n ", "a")]


def corpus(n=60, seed=4):
    """Texts with exact and near copies, shared passages and noise."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    passage = [rng.choice(words) for _ in range(70)]
    out = []
    for i in range(n):
        kind = rng.randrange(5)
        if kind == 0 and out:
            out.append((i, rng.choice(out)[1]))
        elif kind == 1 and out:
            w = rng.choice(out)[1].split()
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append((i, " ".join(w)))
        else:
            w = [rng.choice(words) for _ in range(rng.randrange(3, 220))]
            if kind == 2:
                at = rng.randrange(len(w))
                cut = rng.randrange(0, 12)
                w[at:at] = passage[cut:]
            out.append((i, " ".join(w)))
    return out


# ------------------------------------------------------------------ 1


def test_warc_round_trip(spark):
    big, small = "<p>" + "x" * 200, "tiny"
    rows = [(3, "http://a.b/c", big), (1, "http://a.b/c", big), (2, None, big), (4, "bad url", small), (5, "http://a.b/c", small), (6, "", None), (1, "http://a.b/c", big), (None, "http://z", big), (7, "http://" + "l" * 5000, "é" * 100)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as digest", "2 as first", "3 as key")
    got = sorted((tuple(r) for r in warc.digest(warc.round_trip(pages)).collect()), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = []
    for i, _, t in rows:
        revisit = t == big and i != 1
        want.append((i, len((t or "").encode()), sha(t), "revisit" if revisit else "response", 1 if revisit else None))
    assert got == sorted(want, key=repr)
    assert not warc.round_trip(pages.where("false")).count()


def test_capture_index_finds_by_binary_search(spark):
    captures = spark.createDataFrame([(f"com,h{i % 50:03d})/ {i:020d}", i, "f", i, 1) for i in range(500)], "key string, page_id bigint, archive string, start bigint, length bigint")
    blocks, directory = warc.build_index(captures, lines=7)
    assert len(directory) >= 70 and directory == sorted(directory)
    keys = spark.createDataFrame([(f"com,h{i % 50:03d})/ {i:020d}",) for i in (0, 49, 250, 499)] + [("nothing",)], "key string")
    assert sorted(r.start for r in warc.lookup(keys, blocks, directory).collect()) == [0, 49, 250, 499]


@pytest.mark.parametrize(("url", "key"), [("http://blog.A.example.com:80/x?y#z", "com,example,a,blog)/x?y"), ("https://u@www.a.b", "b,a)/"), (None, ")/"), ("nonsense", "nonsense)/"), ("http://a.b?q=1", "b,a)/?q=1")])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


# ------------------------------------------------------------------ 2, 6, 8


def reference_ids(name, texts):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=bpe.load_ranks(tokenizer_file(name)), special_tokens={})
    return [enc.encode_ordinary(t or "") for t in texts]


def test_bpe_equals_the_library(spark):
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    rows = edge_rows() + [(20 + i, t, "a") for i, (_, t) in enumerate(corpus(20))] + [(90, "z" * 3000 + " " * 500 + "é 　''s 123<|endoftext|>", "a"), (91, "ab" * 60, "a")]
    texts = {i: t for i, t, _ in rows}
    ids = dict(zip(texts, reference_ids("byte_bpe_multi_50k.tiktoken", texts.values()), strict=True))
    got = bpe.digest(bpe.encode(table(spark, rows), path, split_pattern()), path).collect()
    assert len(got) == len(rows)
    for r in got:
        want = ids[r.doc_id]
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert not bpe.encode(table(spark, [], False), path, split_pattern()).count()


def test_long_merges_equal_short_ones():
    ranks = bpe.load_ranks(tokenizer_file("byte_bpe_50k.tiktoken"))
    for t in ("indivisibility", "aaaaaaaaaaaaaaa", "éè", "x"):
        assert [bpe.merge_long(t.encode(), ranks)] == reference_ids("byte_bpe_50k.tiktoken", [t])


def hf_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(list(texts), add_special_tokens=False)]


def test_token_ids_equal_the_tokenizer():
    texts = [t for _, t in corpus(20)] + ["", "a<|endoftext|>b", " " * 20_000 + "x", "é 　\U0001f600\r\n\t9''re"]
    ids, bounds = bpe.TokenIds.of(tokenizer_file("byte_bpe_50k.json"), split_pattern()).encode([t.encode() for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == hf_ids(texts)


def test_token_counts(spark):
    rows = edge_rows()
    want = sorted((str(i), n) for i, n in zip([r[0] for r in rows], map(len, hf_ids([t or "" for _, t, _ in rows])), strict=True))
    for block in (64, 1 << 20):
        files = token_counts.write_token_files(table(spark, rows).repartition(3), tokenizer_file("byte_bpe_50k.json"), split_pattern(), 50256, block=block)
        assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.document_tokens(files, 50256).collect()) == want
    assert not token_counts.document_tokens(token_counts.write_token_files(table(spark, [], False), tokenizer_file("byte_bpe_50k.json"), split_pattern(), 50256), 50256).count()


def test_token_counts_of_raw_blocks(spark):
    pack = lambda *x: struct.pack(f"<{len(x)}H", *x)
    rows = [(0, 0, pack(1, 2)), (0, 1, pack(3, 4)), (0, 2, pack(9, 9, 5)), (0, 3, pack(6)), (1, 0, pack(9))]
    got = token_counts.count_tokens(spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "file int, block int, data binary"), 9)
    assert sorted((r.file, r.ordinal, r.n_tokens) for r in got.collect()) == [(0, 0, 4), (0, 1, 0), (0, 2, 2), (1, 0, 0)]


def packed(spark, rows, **kw):
    return packing.pack(table(spark, rows), tokenizer_file("byte_bpe_50k.json"), split_pattern(), **kw).collect()


def test_packing_is_a_partition_of_all_tokens(spark):
    rows = edge_rows() + [(100 + i, t, f"s{i % 7}") for i, (_, t) in enumerate(corpus(40))]
    texts = {i: t for i, t, _ in rows}
    ids = {i: [*x, 0] for i, x in zip(texts, hf_ids([t or "" for t in texts.values()]), strict=True)}
    pieces = packed(spark, rows)
    docs, windows = {}, {}
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length > 0 and p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        docs.setdefault(p.doc_id, []).append((p.start, p.length))
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, x in ids.items():
        times = sum(r[0] == i for r in rows)
        assert sum(n for _, n in docs[i]) == times * len(x)
        if times == 1:
            at = 0
            for s, n in sorted(docs[i]):
                assert s == at
                at += n
    for w in windows.values():
        at = 0
        for s, n in sorted(w):
            assert s == at
            at += n
    assert sorted(sum(n for _, n in w) for w in windows.values())[1:] == [1024] * (len(windows) - 1) and sorted(windows) == list(range(len(windows)))
    assert packed(spark, []) == []


def shares(mixture, totals):
    """Tokens of each source in each window."""
    share = np.zeros((-(-sum(totals) // 1024), len(totals)), np.int64)
    for q, t in enumerate(totals):
        for place in range(0, t, 5000):
            for _, n, w, _ in mixture.pieces(q, place, min(5000, t - place)):
                share[w, q] += n
    return share


@pytest.mark.parametrize("totals", [[600_000, 300_000, 99_000, 1_000], [50_000] * 24, [700_000, *range(1000, 40_000, 1900)], [1], [1023, 1]])
def test_windows_keep_the_mixture(totals):
    share = shares(packing.Mixture(totals), totals)
    assert share.sum(0).tolist() == totals and (share.sum(1)[:-1] == 1024).all()
    target = 1024 * np.array(totals) / sum(totals)
    assert np.abs(share[:-1] - target).max(initial=0) < 3
    # what a queue is ahead or behind is carried over windows and blocks
    ahead = np.cumsum(share, 0) - np.arange(1, len(share) + 1)[:, None] * target
    assert np.abs(ahead[:-1]).max(initial=0) < 3


def test_blocks_continue_a_plain_round_robin():
    """One block over all windows is the round-robin run as it is; cut into blocks no queue is off by more than tokens."""
    totals = [40_000, 30_000, 20_000, 9_000, 701]
    plain = packing.Schedule(totals, block_windows=1 << 20)
    cut = packing.Schedule(totals, block_windows=4)
    assert plain.blocks == 1 and cut.blocks > 20
    assert np.abs(shares(plain, totals) - shares(cut, totals)).max() <= 3


def test_many_sources_share_queues(spark):
    pieces = packed(spark, [(i, PANGRAMS[i % 4], f"s{i}") for i in range(100)], max_queues=16)
    assert len({p.doc_id for p in pieces}) == 100 and max(p.queue for p in pieces) < 16
    # every source of a shared queue keeps its deficit
    totals = [20_000] * 40
    share = np.cumsum(shares(packing.Mixture(totals, 16), totals), 0)
    target = np.arange(1, len(share) + 1)[:, None] * 1024 / 40
    assert np.abs(share - target)[:-1].max() < 1024


# ------------------------------------------------------------------ 3


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows, base = [], rng.normal(size=(12, 16))
    for i in range(300):
        v = base[i % 12] + rng.normal(0, rng.choice([0.02, 0.1, 0.3]), 16)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    rows += [(400 + i, rows[5][1], 2) for i in range(5)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, rows[0][1], None), (503, [float("nan")] * 16, 1), (504, [None, 1.0], 1), (505, [1.0, 2.0], 1), (506, [2.0, 4.0], 1), (507, [], 1), (508, [-0.0, 1.0], 2), (509, [0.0, 1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 as cls", "2 as id", "3 as n")
    want = vectors.brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows])
    got = vectors.near_duplicate_vectors(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (n, c, c == i) for i, (n, c) in want.items()} and len(got) == len(rows)
    assert not vectors.near_duplicate_vectors(df.where("false")).count()


def test_large_lists_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST", 8)
    monkeypatch.setattr(vectors, "SMALL", 4)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in np.eye(12)[0] + rng.normal(0, 0.03, 12)], 0) for i in range(60)]
    want = vectors.brute(rows)
    got = vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_vectors_with_a_common_direction(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(90, 24)) + 2.5
    rows = [(i, [float(np.float32(x)) for x in base[i % 90] + rng.normal(0, 0.15, 24)], 0) for i in range(360)]
    assert len(vectors.spread_pivots([v for _, v, _ in rows])[24]) >= vectors.ENOUGH
    want = vectors.brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    assert sum(n for n, _ in want.values()) > 500
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values()) and all(got[i][0] <= n for i, (n, _) in want.items())


def test_vectors_of_very_large_and_small_components(spark):
    rows = [(1, [1e200, 2e200], 0), (2, [1e-200, 2e-200], 0), (3, [1.0, 2.0], 0), (4, [2.0, -1.0], 0)]
    got = vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


# ------------------------------------------------------------------ 4


def test_media_round_trip(spark):
    rows = edge_rows() + [(30, "x" * 64, "a"), (31, "y" * (media.FRAME * media.CHUNK_FRAMES), "a"), (32, "z" * (media.FRAME * media.CHUNK_FRAMES + 1), "a")]
    got = media.digest(media.read_media(media.to_media(table(spark, rows)))).collect()
    assert len(got) == len(rows)
    texts, seen = {i: (t or "").encode() for i, t, _ in rows}, {}
    for r in got:
        p = media.padded(texts[r.doc_id])
        assert len(p) % 64 == 0 and p and (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        m = media.write_container(p)
        assert r.media_sha256 == hashlib.sha256(m).hexdigest() and r.media_bytes == len(m)
        assert seen.setdefault(p, r.feature) == r.feature
    assert not media.to_media(table(spark, [], False)).count()


def test_key_ranges_lie_in_the_payload():
    payload = bytes(range(256)) * 300
    m = media.write_container(payload)
    info = media.describe(m)
    assert info["codec"] == "raw " and info["samples"] == len(payload) // 64 and info["duration"] == len(payload)
    for k, (a, b) in enumerate(info["key_ranges"].tolist()):
        assert m[a:b] == payload[k * 64 * media.KEY_EVERY :][:64]
    # boxes are walked, not the payload: the walk of a cut file ends at the cut
    assert [p[-1] for p, _, _ in media.walk(memoryview(m))][:2] == [b"ftyp", b"moov"] and list(media.walk(memoryview(m[:20]))) == []


# ------------------------------------------------------------------ 5, 7


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_against_brute_force(spark, seed):
    rows = [(i * 3 % 61, t) for i, t in corpus(60, seed)] + [(100, None), (101, ""), (102, " ".join(["w"] * 200)), (103, " ".join(["w"] * 120)), (104, "a\x0bb\x0cc\xa0d")]
    want = substrings.brute(rows)
    got = substrings.remove_repeats(table(spark, [(i, t, "a") for i, t in rows]), carry=("lang", "chunk", "text")).collect()
    assert len(got) == len(rows) and sum(r.n_removed for r in got) > 500
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_text.encode()) == want[r.doc_id] and r.lang == "en"
        assert sum(b - a for a, b in r.repeats) == r.n_removed


def test_substrings_edges(spark):
    got = substrings.remove_repeats(table(spark, edge_rows())).collect()
    assert len(got) == len(edge_rows())
    assert {r.doc_id: r.n_removed for r in got if r.doc_id in (2, 6, 7)} == {2: 0, 6: 0, 7: 0}
    # fewer than 50 words are never removed; a null id is the largest
    text = " ".join(f"w{i}" for i in range(50))
    got = substrings.remove_repeats(table(spark, [(None, text, "a"), (8, text, "a"), (8, text, "a"), (9, text + " x", "a")])).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.kept_text[-1:]) for r in got) == [("8", 0, "9"), ("8", 0, "9"), ("9", 50, "x"), ("None", 50, "")]
    assert not substrings.remove_repeats(table(spark, [], False)).count()


@pytest.mark.parametrize("seed", [3, 4])
def test_minhash_against_brute_force(spark, seed):
    rows = [(i * 7 % 97, t) for i, t in corpus(90, seed)] + [(200, None), (201, ""), (202, "One two"), (203, "one TWO"), (204, "one two three"), (205, "É one"), (206, "é one")]
    want = minhash.brute(rows)
    got = minhash.near_duplicates(table(spark, [(i, t, "a") for i, t in rows])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and sum(not r.kept for r in got) > 10


def test_minhash_edges(spark):
    got = minhash.near_duplicates(table(spark, edge_rows())).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got if r.doc_id in (None, 0, 4, 5)) == [("0", "0", True), ("4", "0", False), ("5", "0", False), ("5", "0", False), ("None", "None", True)]
    assert not minhash.near_duplicates(table(spark, [], False)).count()


def test_regions_larger_than_a_window(spark, monkeypatch):
    """Many near copies of one text: more than are compared whole."""
    rng = random.Random(0)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(200)] = f"n{i}x{rng.randrange(9)}"
        rows.append((i, " ".join(w), "a"))
    got = minhash.near_duplicates(table(spark, rows)).collect()
    want = minhash.brute([(i, t) for i, t, _ in rows])
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}


# ------------------------------------------------------------------ 9


def test_pii_base_spans_against_regular_expressions(spark):
    rng = random.Random(6)
    fixed = ["a@b.c@d.e", "x.y@z-1.co.uk.", "@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "1..2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100.", "+12", "+1--------2345678901", "+" + "9" * 5000, "5500 0000 0000 0004 5500000000000004", "00.000.0000.1", "١.2.3.4", "a@b..c", "a@b.c-", "tel:+49 30 901820", "9" * 6000 + ".1.1.1"]
    made = ["".join(rng.choice("ab@.+-%_ 0123456789()é\n") for _ in range(rng.randrange(1, 120))) for _ in range(1500)]
    texts = fixed + made
    for t in texts:
        assert pii.joined([s for s in pii.find_spans(t) if s[2] in pii.BASE]) == pii.brute(t), t
    rows = edge_rows() + [(1000 + i, t, "a") for i, t in enumerate(fixed)]
    got = pii.digest(pii.scan_pii(table(spark, rows))).collect()
    assert {str(r.doc_id): r.base_sha256 for r in got} == {str(i): pii.sha(pii.brute(t)) for i, t, _ in rows} and len(got) == len(rows)
    assert not pii.scan_pii(table(spark, [], False)).count()


def test_pii_more_kinds_and_redaction(spark):
    text = "see https://a.b/c?d, IBAN DE44 5001 0517 5407 3249 31 or account number 12345678, mail me@x.org"
    kinds = [k for _, _, k in pii.find_spans(text)]
    assert kinds == ["url", "account", "account", "email"]
    (r,) = pii.redact_pii(table(spark, [(1, text, "a")])).collect()
    assert r.text == "see [URL], IBAN [ACCOUNT] or account number [ACCOUNT], mail [EMAIL]" and r.n_chars == len(r.text)
    assert [x.text for x in pii.redact_pii(table(spark, [(1, None, "a"), (2, "", "a")])).orderBy("doc_id").collect()] == [None, ""]


# ------------------------------------------------------------------ 10


def toxic_tables(spark, n=400):
    rng = random.Random(9)
    common = ["".join(rng.choice("mnoprstu") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        w, bad = [rng.choice(common) for _ in range(80)], i % 8 == 0
        for _ in range(3 if bad else 0):
            w[rng.randrange(80)] = rng.choice(["vileword", "nastyterm", "crudething"]) + rng.choice(["", "s", "er"])
        rows.append((i, " ".join(w), "a"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_tables(spark)
    docs, marks = table(spark, rows + [(1000, None, "a"), (1001, "", "a"), (None, rows[0][1], "a"), (1002, LONG, "a")]), spark.createDataFrame(labels + [(0, 1, 1), (3, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.digest(toxicity.score(docs, toxicity.fit(docs, marks))).collect()
    by = {r.doc_id: r for r in got}
    for i, _, y in labels:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert by[i].predicted == y, i
    assert by[1000].score == by[1001].score < 0.5 and by[None].held_out and by[None].score == by[0].score and len(got) == len(rows) + 4
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_without_labels(spark):
    docs = table(spark, [(1, "a b", "a")])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.predicted for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] in ([0], [1])
    assert not toxicity.score(docs.where("false"), toxicity.fit(docs.where("false"), none)).count()


@pytest.mark.parametrize(("n_terms", "n_examples"), [(30, 700), (400, 3000)])
def test_nearest_is_exact(n_terms, n_examples):
    rng = np.random.default_rng(5)
    index = toxicity.Index({str(i): i for i in range(n_terms)}, np.linspace(1, 4, n_terms), np.arange(n_examples), rng.integers(0, 2, n_examples).astype(float), 1.0, 0.0)
    chance = 1 / np.arange(1, n_terms + 1)
    draw = lambda n: rng.choice(n_terms, n, replace=False, p=chance / chance.sum()).tolist()
    examples = [index.weigh({t: int(rng.integers(1, 5)) for t in draw(rng.integers(1, 9))}) for _ in range(n_examples)]
    index.build(examples)
    queries = [index.weigh({t: 1 for t in draw(n % 6)}) for n in range(150)] + examples[:50]
    without = [-1] * 150 + list(range(50))
    for q, w, got in zip(queries, without, index.nearest(queries, without=without), strict=True):
        cosines = [sum(q.get(t, 0) * x for t, x in e.items()) if i != w else 0.0 for i, e in enumerate(examples)]
        want = sorted((s for s in cosines if s > 0), reverse=True)[: toxicity.NEIGHBOURS]
        assert [s for s, _ in got] == pytest.approx(want)
        assert [cosines[i] for _, i in got] == pytest.approx(want) and len({i for _, i in got}) == len(got)
    alone = [index.nearest([q], without=[w])[0] for q, w in zip(queries, without, strict=True)]
    assert alone == index.nearest(queries, without=without)
