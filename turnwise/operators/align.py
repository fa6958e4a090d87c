"""Words to speakers, and words to segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import gap_seconds, overlap_seconds, strip
from turnwise.operators.timeline import BUCKET, bucket_of, spread


def assign_words(words: DataFrame, turns: DataFrame, max_gap: float = 1.0, seconds: float = BUCKET) -> DataFrame:
    """Words with ``speaker``: of the turn that overlaps most, else of the nearest within ``max_gap``, else null.

    Ties go to the earlier turn. One left join by recording and time bucket serves both rules; a pair that shares several
    buckets counts in its first one; the best turn is a minimum, so it is aggregated before rows move.
    """
    reach = words.withColumn("_lo", bucket_of(F.col("start") - max_gap, seconds)).withColumn("_hi", bucket_of(F.col("end") + max_gap, seconds))
    reach = reach.withColumn("_bucket", F.explode(F.sequence("_lo", F.greatest("_lo", "_hi"))))
    t = spread(turns.select("rec_id", "turn_idx", "start", "end", "speaker"), seconds)
    t = t.select(F.col("rec_id").alias("_rec"), F.col("_bucket").alias("_b"), F.col("start").alias("_ts"), F.col("end").alias("_te"), F.col("turn_idx").alias("_ti"), F.col("speaker").alias("_sp"))
    ws, we, ts, te = F.col("start"), F.col("end"), F.col("_ts"), F.col("_te")
    first = F.greatest(F.col("_lo"), bucket_of(ts, seconds)) == F.col("_bucket")
    on = (F.col("rec_id") == F.col("_rec")) & (F.col("_bucket") == F.col("_b")) & first & (gap_seconds(ws, we, ts, te) <= max_gap)
    shared = overlap_seconds(ws, we, ts, te)
    rank = F.struct((-shared).alias("o"), F.when(shared > 0, F.lit(0.0)).otherwise(gap_seconds(ws, we, ts, te)).alias("d"), ts.alias("s"), te.alias("e"), F.col("_ti").alias("i"), F.col("_sp").alias("speaker"))
    best = reach.join(t, on, "left").groupBy(*[F.col(c) for c in words.columns]).agg(F.min(F.when(F.col("_ts").isNotNull(), rank)).alias("_best"))
    return best.select(*words.columns, F.col("_best.speaker").alias("speaker"))


def group_segments(assigned: DataFrame, max_pause: float = 1.0, scope: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Segments of consecutive words of one speaker (null equals null) with pauses of at most ``max_pause``.

    ``scope`` is the recording, or recording and recogniser segment, within which words are grouped.
    """
    w = Window.partitionBy(*scope).orderBy("word_idx")
    same = F.lag("speaker").over(w).eqNullSafe(F.col("speaker")) & (F.col("start") - F.lag("end").over(w) <= max_pause)
    marked = assigned.withColumn("_new", F.when(same & (F.row_number().over(w) > 1), 0).otherwise(1))
    numbered = marked.withColumn("seg_idx", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    ordered = F.array_sort(F.collect_list(F.struct("word_idx", "start", "end", "text", "probability")))
    grouped = numbered.groupBy(*scope, "seg_idx").agg(F.min_by("start", "word_idx").alias("start"), F.max_by("end", "word_idx").alias("end"), F.first("speaker").alias("speaker"), ordered.alias("_w"))
    text = F.array_join(F.transform("_w", lambda x: strip(x["text"])), " ")
    words = F.transform("_w", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["probability"].alias("probability")))
    return grouped.select(*scope, "seg_idx", "start", "end", "speaker", text.alias("text"), words.alias("words"))


def word_at(words: DataFrame, position: float) -> DataFrame:
    """The first word of each recording at a play position: start <= position < end."""
    here = words.where((F.col("start") <= position) & (F.col("end") > position))
    return here.groupBy("rec_id").agg(F.min(F.struct("word_idx", "start", "end", "text")).alias("w")).select("rec_id", "w.*")
