"""Transcript jobs as streams: files dropped into a folder become append tables of segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The suffixes that are taken.
SUFFIXES = (".wav", ".flac", ".ogg", ".mp3", ".m4a")


def dropped_files(spark: SparkSession, folder: str) -> DataFrame:
    """(job, filename, suffix, content, problem): a stream of files; ``problem`` tells why one isn't taken.

    Spark's file source doesn't list files without bytes, so an empty upload never becomes a job.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    problem = F.when(~suffix.isin(*SUFFIXES), F.concat(F.lit("no audio by its name: "), F.when(suffix == "", "(none)").otherwise(suffix)))
    return files.select(F.substring(F.sha2("path", 256), 1, 12).alias("job"), name.alias("filename"), suffix.alias("suffix"), "content", problem.alias("problem"))


def run_jobs(files: DataFrame, attribute: Callable[[DataFrame], DataFrame], table: str, status: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Segments of every job are appended to ``table``, its last state to ``status``. A batch is written again after a failure
    under the same batch number, which readers use to leave out what is written twice."""

    def batch(df: DataFrame, number: int) -> None:
        good = df.where("problem IS NULL")
        attribute(good).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")
        states = df.select("job", "filename", F.when(F.col("problem").isNull(), "done").otherwise("error").alias("status"), F.col("problem").alias("error"))
        states.write.mode("overwrite").parquet(f"{status}/batch={number}")

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def job_response(states: DataFrame, segments: DataFrame) -> DataFrame:
    """(job, filename, status, error, segments): the error only of failed jobs, segments only of others."""
    listed = segments.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("start", "end", "speaker", "text"))).alias("segments"))
    return states.join(listed, "job", "left").select("job", "filename", "status", F.when(F.col("status") == "error", F.col("error")).alias("error"), F.when(F.col("status") != "error", F.col("segments")).alias("segments"))
