"""Synthetic benchmark sets: speakers drawn for each mixture, utterances interleaved, placed and summed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators.mixture import build_mixture, interleave_speakers
from turnwise.operators.timeline import consecutive_overlap

#: Numbers of speakers, in turn.
SPEAKER_COUNTS = (2, 3, 4)


def draw_speakers(speakers: list[str], mixtures: int = 12, seed: int = 0) -> list[tuple[str, int, str]]:
    """(rec_id, mixture, speaker): distinct speakers for each mixture, two, three and four in turn."""
    draw, out = np.random.default_rng(seed), []
    for i in range(mixtures):
        for k in draw.choice(len(speakers), size=SPEAKER_COUNTS[i % len(SPEAKER_COUNTS)], replace=False):
            out.append((f"mix_{i:03d}", i, speakers[int(k)]))
    return out


def build_set(utterances: DataFrame, mixtures: int = 12, per_mixture: int = 9, seed: int = 0, overlap_prob: float = 0.0) -> DataFrame:
    """Manifest rows with samples, from (speaker, path, transcript, sample_rate, samples).

    The speakers of a corpus are few and are drawn on the driver; utterances are taken in the order of their paths.
    """
    spark = utterances.sparkSession
    names = sorted(r.speaker for r in utterances.select("speaker").distinct().collect())
    chosen = spark.createDataFrame(draw_speakers(names, mixtures, seed), "rec_id string, mix_idx int, speaker string")
    chosen = chosen.withColumn("_take", F.greatest(F.lit(2), F.floor(F.lit(per_mixture) / F.count(F.lit(1)).over(Window.partitionBy("rec_id"))).cast("int")))
    rank = F.row_number().over(Window.partitionBy("rec_id", "speaker").orderBy("path"))
    taken = utterances.join(chosen, "speaker").withColumn("_n", rank).where(F.col("_n") <= F.col("_take"))
    order = (F.row_number().over(Window.partitionBy("rec_id").orderBy("speaker", "path")) - 1).cast("bigint")
    listed = taken.select("rec_id", order.alias("idx"), "speaker", "transcript", "sample_rate", "samples")
    made = build_mixture(interleave_speakers(listed, seed), seed=seed, overlap_prob=overlap_prob)
    turns = made.select("rec_id", F.posexplode("turns").alias("turn_idx", "t")).select("rec_id", "turn_idx", "t.start", "t.end", "t.speaker")
    shared, heard = consecutive_overlap(turns), turns.groupBy("rec_id").agg(F.count_distinct("speaker").cast("int").alias("num_speakers"))
    rows = made.join(shared, "rec_id").join(heard, "rec_id")
    return rows.select(F.col("rec_id").alias("id"), F.concat(F.lit("audio/"), "rec_id", F.lit(".wav")).alias("wav"), "num_speakers", F.bround("duration", 3).alias("duration"), F.lit(overlap_prob).alias("overlap_prob"), F.bround("overlapped_seconds", 3).alias("overlapped_seconds"), "turns", "text", "sample_rate", "samples")
