import json

import numpy as np
import pytest

from turnwise import cli
from turnwise.sources.audio import encode_wav


def test_defaults():
    a = cli.build_parser().parse_args(["attribute", "x.wav"])
    assert (a.model, a.device, a.compute_type, a.language, a.backend, a.num_speakers, a.distance_threshold, a.json, a.srt) == ("small", "cpu", "int8", None, "clustered", None, 0.75, None, None)
    with pytest.raises(SystemExit):
        cli.build_parser().parse_args(["diarize", "x.wav", "--backend", "none"])
    with pytest.raises(SystemExit):
        cli.build_parser().parse_args([])


def test_end_to_end(spark, tmp_path):
    rate, t = 16000, np.arange(32000) / 16000
    clip = np.concatenate([np.sin(2 * np.pi * 300 * t), np.zeros(16000), np.sin(2 * np.pi * 2000 * t)]).astype(np.float32) * 0.5
    (tmp_path / "demo.wav").write_bytes(encode_wav(clip, rate))
    out, srt, rttm = (str(tmp_path / n) for n in ("o.json", "o.srt", "o.rttm"))
    assert cli.main(["attribute", str(tmp_path / "demo.wav"), "--json", out, "--srt", srt]) == 0
    data = json.loads(open(out).read())
    assert [s["speaker"] for s in data["segments"]] == ["SPEAKER_00", "SPEAKER_01"] and open(srt).read().startswith("1\n00:00:00,")
    assert cli.main(["diarize", str(tmp_path / "demo.wav"), "--rttm", rttm]) == 0
    assert [line.split()[7] for line in open(rttm)] == ["SPEAKER_00", "SPEAKER_01"]


def test_bench_run(spark, tmp_path):
    t = np.arange(32000) / 16000
    (tmp_path / "audio").mkdir()
    (tmp_path / "audio/m0.wav").write_bytes(encode_wav(np.sin(2 * np.pi * 300 * t) * 0.5, 16000))
    (tmp_path / "manifest.jsonl").write_text(json.dumps({"id": "m0", "wav": "audio/m0.wav", "num_speakers": 1, "duration": 2.0, "turns": [{"start": 0.0, "end": 2.0, "speaker": "A"}], "text": "speech"}) + "\n\n")
    assert cli.main(["bench", "run", "--manifest", str(tmp_path / "manifest.jsonl"), "--out", str(tmp_path)]) == 0
    (path,) = (tmp_path / "benchmark_clustered_small_int8_cpu.json").glob("*.json")
    report = json.loads(path.read_text())
    assert report["overall"]["wer"] == 0.0 and report["overall"]["der"] == 0.0 and report["per_mixture"][0]["num_speakers_hyp"] == 1


def test_bench_build(spark, tmp_path):
    for s in ("s1", "s2", "s3", "s4"):
        (tmp_path / f"c/{s}/ch").mkdir(parents=True)
        lines = []
        for i in range(3):
            (tmp_path / f"c/{s}/ch/{s}-{i}.wav").write_bytes(encode_wav(np.full(4000, 0.1), 16000))
            lines.append(f"{s}-{i} word{i}")
        (tmp_path / f"c/{s}/ch/{s}.trans.txt").write_text("\n".join(lines) + "\n")
    assert cli.main(["bench", "build", "--corpus", str(tmp_path / "c"), "--mixtures", "2", "--out", str(tmp_path / "o")]) == 0
    from turnwise.sources.annotations import read_manifest

    got = {r.id: r for r in read_manifest(spark, str(tmp_path / "o/manifest")).collect()}
    assert sorted(got) == ["mix_000", "mix_001"] and got["mix_001"].num_speakers == 3 and len(got["mix_000"].text.split()) == len(got["mix_000"].turns)
    assert spark.read.parquet(str(tmp_path / "o/audio.parquet")).count() == 2


def test_bench_sweep(spark, tmp_path):
    t = np.arange(32000) / 16000
    (tmp_path / "audio").mkdir()
    (tmp_path / "audio/m0.wav").write_bytes(encode_wav(np.sin(2 * np.pi * 300 * t) * 0.5, 16000))
    (tmp_path / "manifest.jsonl").write_text(json.dumps({"id": "m0", "wav": "audio/m0.wav", "num_speakers": 1, "duration": 2.0, "turns": [{"start": 0.0, "end": 2.0, "speaker": "A"}], "text": "speech"}) + "\n")
    assert cli.main(["bench", "sweep", "--param", "pad", "--lo", "0", "--hi", "0.25", "--step", "0.25", "--manifest", str(tmp_path / "manifest.jsonl"), "--out", str(tmp_path / "r")]) == 0
    (path,) = (tmp_path / "r").glob("*.json")
    report = json.loads(path.read_text())
    assert report["chosen_value"] == "0.00" and sorted(report["grid"]) == ["0.00", "0.25"] and report["default_value"] == "0.25"
