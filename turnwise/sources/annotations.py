"""Readers of transcripts, annotation XML, manifests and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise import schema
from turnwise.functions import strip


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, text) of lines that are an id, a space and a text."""
    lines = spark.read.text(path, pathGlobFilter="*.trans.txt", recursiveFileLookup=True)
    parts = F.split("value", " ", 2)
    return lines.select(parts[0].alias("utt_id"), strip(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("text"))


def select_utterances(files: DataFrame, transcripts: DataFrame, max_seconds: float, limit: int) -> DataFrame:
    """The first ``limit`` utterances of each speaker by path, of at most ``max_seconds`` and with a transcript.

    ``files``: (speaker, path, utt_id, duration).
    """
    found = files.where(F.col("duration") <= max_seconds).join(transcripts, "utt_id")
    rank = F.row_number().over(Window.partitionBy("speaker").orderBy("path"))
    return found.withColumn("_n", rank).where(F.col("_n") <= limit).drop("_n")


def _from_name(part: int) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/.]+)\.([^/.]+)\.(?:segments|words)\.xml$", part)


def read_segments_xml(spark: SparkSession, path: str) -> DataFrame:
    """(rec_id, start, end, speaker) of timed segments with a duration; meeting and channel come from the file's name."""
    rows = spark.read.format("xml").option("rowTag", "segment").option("charset", "ISO-8859-1").schema("_transcriber_start double, _transcriber_end double").load(path)
    return rows.select(_from_name(1).alias("rec_id"), F.col("_transcriber_start").alias("start"), F.col("_transcriber_end").alias("end"), _from_name(2).alias("speaker")).where("end > start")


def read_words_xml(spark: SparkSession, path: str) -> DataFrame:
    """(rec_id, speaker, start, text) of timed words; punctuation and blanks are left out."""
    rows = spark.read.format("xml").option("rowTag", "w").option("charset", "ISO-8859-1").schema("_VALUE string, _starttime double, _punc string").load(path)
    text = strip(F.col("_VALUE"))
    return rows.where((F.coalesce("_punc", F.lit("")) != "true") & F.col("_starttime").isNotNull() & (text != "")).select(_from_name(1).alias("rec_id"), _from_name(2).alias("speaker"), F.col("_starttime").alias("start"), text.alias("text"))


def manifest_entries(segments: DataFrame, words: DataFrame, audio: DataFrame) -> DataFrame:
    """A manifest row for each recording of ``audio`` (rec_id, wav, duration); one without segments is an error."""
    turns = segments.groupBy("rec_id").agg(F.count_distinct("speaker").cast("int").alias("num_speakers"), F.array_sort(F.collect_list(F.struct("start", "end", "speaker"))).alias("turns"))
    text = words.groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "speaker", "text"))), lambda w: w["text"]), " ").alias("text"))
    rows = audio.join(turns, "rec_id", "left").join(text, "rec_id", "left")
    missing = F.raise_error(F.concat(F.lit("no segment annotations found for "), F.col("rec_id")))
    return rows.select(F.col("rec_id").alias("id"), "wav", "num_speakers", F.bround("duration", 3).alias("duration"), F.lit(None).cast("double").alias("overlap_prob"), F.lit(None).cast("double").alias("overlapped_seconds"), F.when(F.col("turns").isNull(), missing).otherwise(F.col("turns")).alias("turns"), F.coalesce("text", F.lit("")).alias("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a manifest; Spark tells if the file is missing, blank lines are dropped, broken lines are errors."""
    return spark.read.schema(schema.MANIFEST).option("mode", "FAILFAST").json(path)


def manifest_turns(manifest: DataFrame) -> DataFrame:
    rows = manifest.select(F.col("id").alias("rec_id"), F.posexplode("turns").alias("turn_idx", "t"))
    return rows.select("rec_id", F.col("turn_idx").cast("bigint").alias("turn_idx"), "t.start", "t.end", "t.speaker")


def read_transcript_json(spark: SparkSession, path: str, reference: str | None = None) -> DataFrame:
    """(name, segments, turns) of transcript files and, if there, their reference turns (name.ref.json)."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.ref)?\.json$", 1)
    hyp = spark.read.schema(schema.TRANSCRIPT).option("multiLine", True).json(path).select(name.alias("name"), "segments")
    if reference is None:
        return hyp.withColumn("turns", F.lit(None).cast("array<struct<start:double,end:double,speaker:string>>"))
    ref = spark.read.schema(schema.REFERENCE).option("multiLine", True).json(reference).select(name.alias("name"), "turns")
    return hyp.join(ref, "name", "left")


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """Turns of RTTM files: a pluggable source for diarizers that run elsewhere."""
    f = F.split(strip(F.col("value")), r"\s+")
    rows = spark.read.text(path).where(F.col("value").startswith("SPEAKER")).select(f.alias("f"))
    start, dur = F.get("f", F.lit(3)).cast("double"), F.get("f", F.lit(4)).cast("double")
    turns = rows.select(F.get("f", F.lit(1)).alias("rec_id"), start.alias("start"), (start + dur).alias("end"), F.get("f", F.lit(7)).alias("speaker"))
    return turns.withColumn("turn_idx", (F.row_number().over(Window.partitionBy("rec_id").orderBy("start", "end", "speaker")) - 1).cast("bigint")).select("rec_id", "turn_idx", "start", "end", "speaker")
