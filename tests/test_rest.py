"""Clustering, tracking, mixtures, sweeps, formats, ingest, audio and streaming."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise import functions as fn
from turnwise import schema
from turnwise.operators import cluster, mixture, sweep
from turnwise.sources import annotations, audio, formats
from turnwise.streaming import jobs, live, models


def naive_linkage(x, t, k=None):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        d = [(np.mean([1 - x[i] @ x[j] for i in a for j in b]), p, q) for p, a in enumerate(groups) for q, b in enumerate(groups) if p < q]
        best, p, q = min(d)
        if (k is None and best > t) or (k is not None and len(groups) <= k):
            break
        groups[p] += groups.pop(q)
    return {frozenset(g) for g in groups}


def test_linkage_against_the_definition():
    rng = np.random.default_rng(2)
    for n in (2, 5, 9, 14):
        x = rng.normal(size=(n, 4))
        for kw in ({"distance_threshold": 0.8}, {"num_speakers": 3}):
            got = cluster.average_linkage(x, **kw)
            assert {frozenset(np.flatnonzero(np.array(got) == g).tolist()) for g in set(got)} == naive_linkage(x, kw.get("distance_threshold", 0), kw.get("num_speakers"))
            assert got[0] == 0 and all(g <= max(got[:i], default=-1) + 1 for i, g in enumerate(got))


def test_linkage_keeps_no_table_of_distances():
    import tracemalloc

    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 8))
    tracemalloc.start()
    labels = cluster.average_linkage(x, 0.3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3000 * 3000 * 8 and 1 < len(set(labels)) < 3000
    again = cluster.average_linkage(np.concatenate([x, x[:1000]]), num_speakers=5)
    assert again[3000:] == again[:1000] and len(set(again)) == 5
    assert len(set(cluster.average_linkage(np.ones((6, 2)), num_speakers=4))) == 4


def test_cluster_blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.01, (6, 16)) + np.eye(16)[0], rng.normal(0, 0.01, (6, 16)) + np.eye(16)[1]])
    df = spark.createDataFrame([("r", i, v.tolist()) for i, v in enumerate(x)], "rec_id string, idx bigint, vec array<float>")
    assert [r.label for r in cluster.cluster_embeddings(df).orderBy("idx").collect()] == [0] * 6 + [1] * 6
    assert {r.label for r in cluster.cluster_embeddings(df, num_speakers=1).collect()} == {0}
    assert cluster.average_linkage(np.zeros((0, 3))) == [] and cluster.average_linkage(np.ones((1, 3))) == [0]
    with pytest.raises(ValueError):
        cluster.average_linkage(np.zeros((2, 3)))


def test_recognise():
    axis = np.eye(8)
    known, ids = live.recognise(live.NOBODY, axis[:1], [0])
    assert ids == [0]
    known, ids = live.recognise(known, axis[1:2], [0])
    assert ids == [1]
    noisy = axis[:1] + 0.05
    assert live.recognise(known, noisy / np.linalg.norm(noisy), [0])[1] == [0]
    assert live.recognise(known, np.stack([axis[1], axis[0]]), [0, 1])[1] == [1, 0]
    # the order of local labels decides who is new first, not that of the windows
    assert live.recognise(live.NOBODY, np.stack([axis[1], axis[0]]), [1, 0])[1] == [1, 0]
    known, _ = live.recognise(live.NOBODY, np.repeat(axis[:1], 9, 0), [0] * 9, 0.9)
    known, ids = live.recognise(known, ((axis[0] + axis[1]) / np.sqrt(2))[None], [0], 0.9)
    assert ids == [0] and known.centres[0][0] > 0.9 and known.windows.tolist() == [10]


def using(words=((1.0, 1.5, "hi", 1.0),)):
    return live.Models(lambda x: [(0.0, len(x) / models.RATE)], lambda x, w: np.ones((len(w), 8)), lambda x: list(words))


def test_advance_by_chunks():
    def seconds(n):
        return np.zeros(n * models.RATE)

    state, made = live.advance(using(), None, seconds(3))
    assert made == []
    state, made = live.advance(using(), state, seconds(2))
    assert len(made) == 1
    state, (second,) = live.advance(using(), state, seconds(5))
    assert second["start"] == 6.0 and second["speaker"] == "SPEAKER_00"
    state, made = live.advance(using(), state, seconds(1))
    assert made == [] and len(live.advance(using(), state, seconds(0), last=True)[1]) == 1
    # many chunks at once are as many steps; a stop with nothing open gives nothing
    assert len(live.advance(using(), None, seconds(12), last=True)[1]) == 3
    assert live.advance(using(), None, seconds(0), last=True)[1] == []
    (_, done, known), made = live.advance(using(()), None, seconds(5))
    assert made == [] and done == 5 * models.RATE and not len(known.windows)


def test_live_stream_survives_a_restart_and_order(spark, tmp_path):
    """Frames of one session come over two runs of the query, partly out of order and repeated."""
    pcm = np.zeros(models.RATE, "<i2").tobytes()
    frames = [("s", i, models.RATE, pcm, False) for i in range(6)] + [("s", 6, models.RATE, None, True)]
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))

    def step(part):
        spark.createDataFrame(part, schema.FRAMES).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema.FRAMES).parquet(src)
        made = live.live_segments(stream, lambda x: [(0.0, len(x) / models.RATE)], lambda x, w: np.ones((len(w), 8)), lambda x: [(0.25, 0.5, "hi", 1.0)])
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()

    step([frames[1], frames[0], frames[3]])
    step([frames[2], frames[0], frames[4], frames[6]])
    step([frames[5]])
    got = sorted((r.start, r.speaker, r.text) for r in spark.read.parquet(out).collect())
    assert got == [(0.25, "SPEAKER_00", "hi"), (5.25, "SPEAKER_00", "hi")]


def test_jobs(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.wav").write_bytes(b"x")
    (drop / "b.txt").write_bytes(b"x")
    (drop / "c.wav").write_bytes(b"")
    seg = lambda df: df.select("job", F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit("A").alias("speaker"), F.lit("t").alias("text"))
    table, status = str(tmp_path / "t"), str(tmp_path / "s")
    jobs.run_jobs(jobs.dropped_files(spark, str(drop)), seg, table, status, str(tmp_path / "ck")).awaitTermination()
    got = {r.filename: (r.status, r.error, r.segments) for r in jobs.job_response(spark.read.parquet(status), spark.read.parquet(table)).collect()}
    assert got["a.wav"][0] == "done" and got["a.wav"][1] is None and len(got["a.wav"][2]) == 1
    assert got["b.txt"][:2] == ("error", "no audio by its name: .txt")
    assert "c.wav" not in got  # Spark's file source doesn't list empty files


def test_mixtures(spark):
    u = lambda i, s, n: ("r", i, s, f"t{i}", 100, [0.75] * n)
    ddl = "rec_id string, idx bigint, speaker string, transcript string, sample_rate int, samples array<float>"
    (m,) = mixture.build_mixture(spark.createDataFrame([u(0, "A", 100), u(1, "B", 100)], ddl), gap_range=(0.5, 0.5)).collect()
    assert [(t.start, t.end) for t in m.turns] == [(0.0, 1.0), (1.5, 2.5)] and len(m.samples) == 250 and m.text == "t0 t1"
    (m,) = mixture.build_mixture(spark.createDataFrame([u(0, "A", 400), u(1, "B", 100)], ddl), overlap_prob=1.0, overlap_range=(3.0, 3.0)).collect()
    assert m.turns[0].end - m.turns[1].start == 0.5 and max(m.samples) == 1.0
    order = mixture.interleaved(["A"] * 3 + ["B"] * 3, 0)
    assert sorted(order) == list(range(6)) and [i for i in order if i < 3] == [0, 1, 2]
    assert mixture.interleaved(["A", "A"], 1) == [0, 1]
    with pytest.raises(Exception, match="mixes sample rates"):
        mixture.build_mixture(spark.createDataFrame([u(0, "A", 10), ("r", 1, "B", "t", 200, [0.0])], ddl)).collect()


def test_sweep(spark):
    ddl = "mix_id string, mix_idx int, value string, miss double, false_alarm double, confusion double, ref_time double, num_speakers_ref int, num_speakers_hyp int"
    rows = [("a", 0, "0.50", 1.0, 0.0, 0.0, 10.0, 2, 2), ("b", 1, "0.50", 9.0, 0.0, 0.0, 10.0, 2, 3), ("a", 0, "0.60", 1.0, 0.0, 0.0, 10.0, 2, 2), ("b", 1, "0.60", 0.0, 0.0, 0.0, 10.0, 2, 2)]
    rolled = sweep.roll_up(sweep.with_split(spark.createDataFrame(rows, ddl)))
    got = {(r.value, r.split): (r.der, r.speakers_correct) for r in rolled.collect()}
    assert got["0.50", "all"] == (0.5, "1/2") and got["0.50", "heldout"] == (0.9, "0/1") and got["0.60", "calibration"] == (0.1, "1/1")
    assert sweep.pick_value(rolled).first().value == "0.50"
    assert sweep.grid(0.0, 0.4, 0.05) == ["0.00", "0.05", "0.10", "0.15", "0.20", "0.25", "0.30", "0.35", "0.40"]
    assert sweep.grid(0.3, 0.9, 0.05)[-1] == "0.90"


@pytest.mark.parametrize(("s", "want"), [(0.0, "00:00:00,000"), (75.5, "00:01:15,500"), (3661.001, "01:01:01,001"), (-1.0, "00:00:00,000")])
def test_srt_stamp(spark, s, want):
    row = spark.createDataFrame([(s,)], "s double").select(fn.srt_timestamp(F.col("s")).alias("a"), formats.exact_stamp(F.col("s")).alias("b")).first()
    assert row.a == row.b == want


def test_json_is_written_in_pieces(spark, monkeypatch):
    word = lambda i, t: {"start": i / 7, "end": i / 7 + 0.0005, "text": t, "probability": 1.0 if i % 3 else 2.675}
    texts = ["a", 'quo"te', "é\n\t\\", "\u2028", "", None, "😀", "x"]
    rows = [(f"r{r}", i, i / 3, i + 1e-7, None if i == 2 else "A", texts[i], [word(k, texts[(i + k) % 8]) for k in range(i)]) for r in range(2) for i in range(8)]
    rows.append(("z", 0, None, float("inf"), "B", "", []))
    want = {}
    for rec, _, s, e, who, text, words in rows:
        listed = [{**w, "start": round(w["start"], 3), "end": round(w["end"], 3), "probability": round(w["probability"], 3)} for w in words]
        want.setdefault(rec, []).append({"speaker": who, "start": round(float("nan") if s is None else s, 3), "end": round(e, 3), "text": text, "words": listed})
    got = formats.segments_to_json(spark.createDataFrame(rows, schema.SEGMENTS).orderBy(F.desc("seg_idx"))).collect()
    assert {r.rec_id: r.json for r in got} == {k: json.dumps({"segments": v}, ensure_ascii=False, indent=2) for k, v in want.items()}
    batch = spark.createDataFrame(rows, schema.SEGMENTS).toArrow().combine_chunks().to_batches()[0]
    held = []
    monkeypatch.setattr(formats, "JSON_WORDS", 10)
    monkeypatch.setattr(formats, "segment_jsons", lambda piece, f=formats.segment_jsons: held.append(piece) or f(piece))
    texts = [j for out in formats._written([batch]) for j in out.column("j").to_pylist()]
    monkeypatch.undo()
    assert len(held) > 5 and max(len(p.column("words").flatten()) for p in held) <= 10 and texts == formats.segment_jsons(batch)


def test_formats(spark):
    words = [{"start": 0.0625, "end": 1.5, "text": "é", "probability": 0.98765}]
    seg = spark.createDataFrame([("r", 0, 0.0625, 1.5, "A", "é", words), ("r", 1, 2.0, 2.5, None, "x", [])], schema.SEGMENTS)
    data = json.loads(formats.segments_to_json(seg).first().json)
    assert data["segments"][0]["words"][0] == {"start": 0.062, "end": 1.5, "text": "é", "probability": 0.988} and data["segments"][1]["speaker"] is None
    assert "é" in formats.segments_to_json(seg).first().json
    assert formats.segments_to_srt(seg).first().srt == "1\n00:00:00,062 --> 00:00:01,500\nA: é\n\n2\n00:00:02,000 --> 00:00:02,500\nx\n"
    turns = spark.createDataFrame([("demo", 0, 0.0, 1.5, "A")], schema.TURNS)
    assert formats.turns_to_rttm(turns).first().rttm == "SPEAKER demo 1 0.000 1.500 <NA> <NA> A <NA> <NA>\n"


def test_rttm_round_trip(spark, tmp_path):
    (tmp_path / "x.rttm").write_text("SPEAKER demo 1 0.000 1.500 <NA> <NA> A <NA> <NA>\n")
    (r,) = annotations.read_rttm(spark, str(tmp_path / "x.rttm")).collect()
    assert (r.rec_id, r.turn_idx, r.start, r.end, r.speaker) == ("demo", 0, 0.0, 1.5, "A")


def test_annotation_xml(spark, tmp_path):
    head = '<?xml version="1.0" encoding="ISO-8859-1"?>\n'
    (tmp_path / "M1.A.segments.xml").write_text(head + '<root><segment transcriber_start="0.5" transcriber_end="2"/><segment transcriber_start="3" transcriber_end="3"/></root>')
    (tmp_path / "M1.B.segments.xml").write_text(head + '<root><segment transcriber_start="0.1" transcriber_end="4"/></root>')
    (tmp_path / "M1.A.words.xml").write_text(head + '<root><w starttime="0.37">Hmm</w><w starttime="0.5" punc="true">.</w><w>no</w><w starttime="0.95"> okay </w><w starttime="1"> </w></root>')
    segments = annotations.read_segments_xml(spark, str(tmp_path / "*.segments.xml"))
    words = annotations.read_words_xml(spark, str(tmp_path / "*.words.xml"))
    assert sorted((r.rec_id, r.start, r.end, r.speaker) for r in segments.collect()) == [("M1", 0.1, 4.0, "B"), ("M1", 0.5, 2.0, "A")]
    assert sorted((r.start, r.text) for r in words.collect()) == [(0.37, "Hmm"), (0.95, "okay")]
    sounds = spark.createDataFrame([("M1", "audio/M1.wav", 12.34567)], "rec_id string, wav string, duration double")
    (m,) = annotations.manifest_entries(segments, words, sounds).collect()
    assert m.num_speakers == 2 and m.text == "Hmm okay" and [t.speaker for t in m.turns] == ["B", "A"] and m.duration == 12.346
    out = str(tmp_path / "manifest")
    formats.write_manifest(annotations.manifest_entries(segments, words, sounds), out)
    again = annotations.read_manifest(spark, out)
    assert annotations.manifest_turns(again).count() == 2
    with pytest.raises(Exception, match="no segment annotations"):
        annotations.manifest_entries(segments.where("false"), words, sounds).collect()


def test_transcripts_and_selection(spark, tmp_path):
    (tmp_path / "1-2.trans.txt").write_text("u1 HELLO THERE\nu2 YES\nu3 NO\n")
    t = annotations.read_transcripts(spark, str(tmp_path))
    assert {r.utt_id: r.text for r in t.collect()}["u1"] == "HELLO THERE"
    files = spark.createDataFrame([("s", "p1", "u1", 5.0), ("s", "p2", "u2", 50.0), ("s", "p3", "u3", 1.0), ("s", "p4", "u4", 1.0), ("s", "p5", "u1", 1.0)], "speaker string, path string, utt_id string, duration double")
    assert sorted(r.path for r in annotations.select_utterances(files, t, 10.0, 2).collect()) == ["p1", "p3"]


def test_audio(spark, tmp_path):
    t = np.arange(8000) / 8000
    wave = np.sin(2 * np.pi * 440 * t).astype(np.float32) * 0.5
    assert audio.resample(wave, 8000, 8000) is wave
    up = audio.resample(wave, 8000, 16000)
    want = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000) * 0.5
    assert len(up) == 16000 and np.abs(up[500:-500] - want[500:-500]).max() < 0.01
    down = audio.resample(np.repeat(wave, 1), 48000, 16000)
    assert len(down) == len(wave) // 3 + 1
    (tmp_path / "x.wav").write_bytes(audio.encode_wav(wave, 8000))
    (r,) = audio.read_audio(spark, str(tmp_path)).collect()
    assert r.rec_id == "x" and r.sample_rate == 16000 and abs(r.duration - 1.0) < 1e-6
    assert audio.from_pcm(np.array([-32768, 0], "<i2").tobytes()).tolist() == [-1.0, 0.0]
    with pytest.raises(ValueError):
        models.energy_vad(wave, rate=8000)


def test_functions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(
        fn.cosine_distance(F.col("a"), F.col("b")).alias("d"), fn.cosine_distance(F.col("a"), F.col("z")).alias("z"), fn.unit(F.col("a")).alias("u"), fn.peak(F.col("a")).alias("p"), fn.speaker_label(F.lit(100)).alias("s"), fn.clock(F.lit(75.9)).alias("c"), fn.strip(F.lit("  x\t")).alias("x")
    ).first()
    assert row.d == pytest.approx(0.04) and row.z == 1.0 and row.u == [0.6, 0.8] and row.p == 4.0 and row.s == "SPEAKER_100" and row.c == "1:15" and row.x == "x"
