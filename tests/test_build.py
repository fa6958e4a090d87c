import json

import numpy as np
from pyspark.sql import functions as F

from turnwise.operators import sweep
from turnwise.plans import attribute, build
from turnwise.sources import formats


def test_build_set(spark):
    rows = [(s, f"{s}/{i}", f"{s}{i}", 100, [0.5] * (60 + 10 * i)) for s in "ABCDE" for i in range(4)]
    u = spark.createDataFrame(rows, "speaker string, path string, transcript string, sample_rate int, samples array<float>")
    got = {r.id: r for r in build.build_set(u, mixtures=4, per_mixture=6, overlap_prob=0.7).collect()}
    assert [got[f"mix_{i:03d}"].num_speakers for i in range(4)] == [2, 3, 4, 2]
    assert [len(got[f"mix_{i:03d}"].turns) for i in range(3)] == [6, 6, 8] and got["mix_000"].wav == "audio/mix_000.wav"
    assert len(build.draw_speakers(["A", "B", "C", "D"], 3)) == 9
    for r in got.values():
        shared = sum(max(0.0, a.end - b.start) for a, b in zip(r.turns, r.turns[1:], strict=False))
        assert abs(shared - r.overlapped_seconds) < 1e-3 and len(r.text.split()) == len(r.turns)


def test_threshold_sweep_and_its_report(spark, tmp_path):
    """Two speakers on two axes: a threshold of 0.5 keeps them apart, one of 1.2 doesn't."""
    rows = [(f"m{m}", i, i * 1.0, i + 1.0, np.eye(4)[(i // 3) % 2].tolist()) for m in range(2) for i in range(6)]
    embedded = spark.createDataFrame(rows, "rec_id string, idx bigint, start double, end double, vec array<float>")
    ref = spark.createDataFrame([(f"m{m}", k, 3.0 * k, 3.0 * k + 3, "AB"[k]) for m in range(2) for k in range(2)], "rec_id string, turn_idx bigint, start double, end double, speaker string")
    order = spark.createDataFrame([("m0", 0), ("m1", 1)], "rec_id string, mix_idx int")
    cells = attribute.sweep_threshold(embedded, ref, ["0.50", "1.20"], order).persist()
    rolled = sweep.roll_up(cells).persist()
    assert sweep.pick_value(rolled).first().value == "0.50"
    assert {(r.value, r.split): r.speakers_correct for r in rolled.collect()}["1.20", "all"] == "0/2"
    report = formats.sweep_report(rolled, cells, "threshold", "1.20")
    formats.write_report(report, str(tmp_path / "r"))
    (path,) = (tmp_path / "r").glob("*.json")
    data = json.loads(path.read_text())
    assert data["chosen_value"] == "0.50" and data["chosen_heldout_der"] == 0.0 and data["default_heldout_der"] == 0.5 and len(data["per_mixture"]) == 2
    assert spark.read.json(str(tmp_path / "r")).select(F.col("config.param")).first().param == "threshold"
