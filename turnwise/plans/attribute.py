"""Whole plans: audio to attributed transcripts, benchmark runs, sweeps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import normalize_words, real_time_factor
from turnwise.operators import align, cluster, score, sweep, timeline
from turnwise.streaming.models import ClusteredConfig, EmbedFn, TranscribeFn, VadFn


def detect_regions(audio: DataFrame, vad: VadFn) -> DataFrame:
    """(rec_id, idx, start, end) by a pluggable detector."""

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in tables:
            for r in t.itertuples():
                yield pd.DataFrame([(r.rec_id, i, a, b) for i, (a, b) in enumerate(vad(np.asarray(r.samples, np.float32)))], columns=["rec_id", "idx", "start", "end"])

    return audio.select("rec_id", "samples").mapInPandas(run, "rec_id string, idx bigint, start double, end double")


def transcribe(audio: DataFrame, asr: TranscribeFn) -> DataFrame:
    """(rec_id, word_idx, start, end, text, probability, seconds): words by a pluggable recogniser, and its time."""
    import time

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in tables:
            for r in t.itertuples():
                began = time.perf_counter()
                words = asr(np.asarray(r.samples, np.float32))
                seconds = time.perf_counter() - began
                yield pd.DataFrame([(r.rec_id, i, *w, seconds) for i, w in enumerate(words)], columns=["rec_id", "word_idx", "start", "end", "text", "probability", "seconds"])

    return audio.select("rec_id", "samples").mapInPandas(run, "rec_id string, word_idx bigint, start double, end double, text string, probability double, seconds double")


def embed_windows(audio: DataFrame, windows: DataFrame, embed: EmbedFn) -> DataFrame:
    """(rec_id, idx, start, end, vec); the windows of a recording go to its audio as one row, so audio isn't copied."""
    listed = windows.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("idx", "start", "end"))).alias("ws"))

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in tables:
            for r in t.itertuples():
                spans = [(w["start"], w["end"]) for w in r.ws]
                vectors = embed(np.asarray(r.samples, np.float32), spans)
                yield pd.DataFrame({"rec_id": r.rec_id, "idx": [w["idx"] for w in r.ws], "start": [a for a, _ in spans], "end": [b for _, b in spans], "vec": [np.asarray(v, np.float32) for v in vectors]})

    return audio.select("rec_id", "samples").join(listed, "rec_id").mapInPandas(run, "rec_id string, idx bigint, start double, end double, vec array<float>")


def turns_of(embedded: DataFrame, config: ClusteredConfig) -> DataFrame:
    """Turns of embedded windows: clustered by recording, then resolved in time."""
    labels = cluster.cluster_embeddings(embedded, config.distance_threshold, config.num_speakers)
    turns = timeline.windows_to_turns(embedded.select("rec_id", "idx", "start", "end").join(labels, ["rec_id", "idx"]))
    return turns.select("rec_id", "turn_idx", "start", "end", F.format_string("SPEAKER_%02d", "label").alias("speaker"))


def diarize(audio: DataFrame, vad: VadFn, embed: EmbedFn, config: ClusteredConfig | None = None) -> DataFrame:
    """(rec_id, turn_idx, start, end, speaker): regions, windows, embeddings, clusters, turns."""
    c = config or ClusteredConfig()
    regions = timeline.merge_regions(detect_regions(audio, vad), c.min_gap, c.min_duration, c.vad_pad)
    return turns_of(embed_windows(audio, timeline.slice_windows(regions, c.window, c.stride), embed), c)


def attribute(audio: DataFrame, vad: VadFn, embed: EmbedFn, asr: TranscribeFn, config: ClusteredConfig | None = None) -> DataFrame:
    """Segments: who said what, when."""
    words = transcribe(audio, asr).drop("seconds")
    return align.group_segments(align.assign_words(words, diarize(audio, vad, embed, config)))


def benchmark(manifest: DataFrame, reference: DataFrame, hypothesis: DataFrame, words: DataFrame, collar: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(per recording, overall): error rates, speaker counts and real-time factors.

    ``manifest``: (rec_id, duration, num_speakers, text); ``words`` as from ``transcribe``.
    """
    text = words.groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda w: w["text"]), " ").alias("hyp"), F.max("seconds").alias("seconds"))
    pairs = manifest.join(text, "rec_id", "left").select("rec_id", "duration", "num_speakers", "seconds", normalize_words(F.col("text")).alias("ref"), normalize_words(F.coalesce("hyp", F.lit(""))).alias("hyp"))
    heard = hypothesis.groupBy("rec_id").agg(F.count_distinct("speaker").alias("num_speakers_hyp"))
    each = score.wer_counts(pairs).join(score.der(reference, hypothesis, collar), "rec_id", "left").join(heard, "rec_id", "left")
    each = each.select("rec_id", "duration", "num_speakers", F.coalesce("num_speakers_hyp", F.lit(0)).alias("num_speakers_hyp"), "wer", "substitutions", "deletions", "insertions", "reference_words", "der", "missed", "false_alarm", "confusion", "total_reference", F.bround(real_time_factor(F.coalesce("seconds", F.lit(0.0)), F.col("duration")), 4).alias("rtf"))
    overall = score.pooled_der(each).join(score.pooled_wer(each)).join(each.agg(F.avg("rtf").alias("mean_rtf"), F.sum("duration").alias("duration"), F.count(F.lit(1)).alias("recordings")))
    return each, overall


def _cells(turns: dict[str, DataFrame], reference: DataFrame, order: DataFrame, collar: float) -> DataFrame:
    """Sweep cells of the turns found at each value. The values' plans are one plan; ``order``: (rec_id, mix_idx)."""
    parts = []
    for value, found in turns.items():
        count = found.groupBy("rec_id").agg(F.count_distinct("speaker").cast("int").alias("num_speakers_hyp"))
        parts.append(score.der(reference, found, collar).join(count, "rec_id", "left").withColumn("value", F.lit(value)))
    cells = reduce(DataFrame.unionByName, parts)
    known = reference.groupBy("rec_id").agg(F.count_distinct("speaker").cast("int").alias("num_speakers_ref"))
    cells = cells.join(known, "rec_id").join(order, "rec_id")
    return sweep.with_split(cells.select(F.col("rec_id").alias("mix_id"), "mix_idx", "value", F.col("missed").alias("miss"), "false_alarm", "confusion", F.col("total_reference").alias("ref_time"), "num_speakers_ref", F.coalesce("num_speakers_hyp", F.lit(0)).alias("num_speakers_hyp")))


def sweep_threshold(embedded: DataFrame, reference: DataFrame, values: list[str], order: DataFrame, collar: float = 0.25, config: ClusteredConfig | None = None) -> DataFrame:
    """Cells of a grid of distance thresholds over windows that were embedded once (persist them)."""
    c = config or ClusteredConfig()
    return _cells({v: turns_of(embedded, replace(c, distance_threshold=float(v))) for v in values}, reference, order, collar)


def sweep_pad(audio: DataFrame, vad: VadFn, embed: EmbedFn, reference: DataFrame, values: list[str], order: DataFrame, collar: float = 0.25, config: ClusteredConfig | None = None) -> DataFrame:
    """Cells of a grid of paddings: regions, windows and embeddings are those of each value."""
    c = config or ClusteredConfig()
    return _cells({v: diarize(audio, vad, embed, replace(c, vad_pad=float(v))) for v in values}, reference, order, collar)
