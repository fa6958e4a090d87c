"""Interval operators: merging, slicing, boundary resolution, elementary intervals, stabbing, placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a time bucket in range joins; a span is copied to each bucket it touches.
BUCKET = 60.0


def bucket_of(t: Column, seconds: float = BUCKET) -> Column:
    return F.floor(t / F.lit(seconds)).cast("bigint")


def islands(df: DataFrame, gap: float, strict: bool, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Merge spans whose start is less than ``gap`` (or at most, unless strict) behind the running end; (keys, start, end)."""
    ahead = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    since = F.col("start") - F.max("end").over(ahead)
    near = (since < gap) if strict else (since <= gap)
    marked = df.select(*keys, "start", "end", F.when(near, 0).otherwise(1).alias("_new"))
    numbered = marked.withColumn("_island", F.sum("_new").over(running))
    return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def merge_intervals(spans: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Union of intervals; touching ones merge."""
    return islands(spans, 0.0, False, keys)


def merge_regions(regions: DataFrame, min_gap: float = 0.3, min_duration: float = 0.2, pad: float = 0.05) -> DataFrame:
    """Pad (not below 0), merge regions less than ``min_gap`` apart, then drop those shorter than ``min_duration``."""
    if min_gap < 0:
        raise ValueError("min_gap must not be negative")
    padded = regions.select("rec_id", F.greatest(F.lit(0.0), F.col("start") - pad).alias("start"), (F.col("end") + pad).alias("end"))
    return islands(padded, min_gap, True).where(F.col("end") - F.col("start") >= min_duration)


def slice_windows(regions: DataFrame, window: float = 1.5, stride: float = 0.75) -> DataFrame:
    """(rec_id, idx, start, end): windows at every stride inside a region, and one flush with its end."""
    length = F.col("end") - F.col("start")
    hops = F.greatest(F.lit(0), F.ceil((length - window) / stride)).cast("int")
    inner = F.when(hops > 0, F.transform(F.sequence(F.lit(0), hops - 1), lambda k: F.struct((F.col("start") + k * F.lit(stride)).alias("start"), (F.col("start") + k * F.lit(stride) + window).alias("end")))).otherwise(
        F.expr("cast(array() as array<struct<start:double,end:double>>)")
    )
    tail = F.array(F.struct(F.greatest(F.col("start"), F.col("end") - window).alias("start"), F.col("end").alias("end")))
    sliced = regions.select("rec_id", F.explode(F.concat(inner, tail)).alias("w")).select("rec_id", "w.start", "w.end")
    return sliced.withColumn("idx", (F.row_number().over(Window.partitionBy("rec_id").orderBy("start", "end")) - 1).cast("bigint")).select("rec_id", "idx", "start", "end")


def windows_to_turns(windows: DataFrame, max_merge_gap: float = 0.5) -> DataFrame:
    """(rec_id, turn_idx, start, end, label) from labelled windows (rec_id, idx, start, end, label).

    Windows in time order: one of the open turn's label at most ``max_merge_gap`` behind it extends it; one of another label
    that overlaps it is cut at the middle of the overlap, and so is the open turn. Turns without duration go.

    The open turn depends on all that came before, so a recording is one fold over its sorted windows. The array of a
    recording's windows has to fit in a task; it is bounded by the length of a recording.
    """
    ordered = windows.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "idx", F.col("label").cast("bigint").alias("label")))).alias("ws"))
    turn = "struct<start:double,end:double,label:bigint>"
    start = F.struct(F.expr(f"cast(array() as array<{turn}>)").alias("done"), F.expr(f"cast(null as {turn})").alias("open"))

    def made(s: Column, e: Column, label: Column) -> Column:
        return F.struct(s.alias("start"), e.alias("end"), label.alias("label"))

    def step(acc: Column, w: Column) -> Column:
        o = acc["open"]
        cut = (w["start"] + o["end"]) / 2
        opened = F.struct(acc["done"].alias("done"), made(w["start"], w["end"], w["label"]).alias("open"))
        longer = F.struct(acc["done"].alias("done"), made(o["start"], F.greatest(o["end"], w["end"]), o["label"]).alias("open"))
        contested = F.struct(F.array_append(acc["done"], made(o["start"], cut, o["label"])).alias("done"), made(cut, F.greatest(cut, w["end"]), w["label"]).alias("open"))
        apart = F.struct(F.array_append(acc["done"], o).alias("done"), made(w["start"], w["end"], w["label"]).alias("open"))
        return F.when(o.isNull(), opened).when((w["label"] == o["label"]) & (w["start"] - o["end"] <= max_merge_gap), longer).when(w["start"] < o["end"], contested).otherwise(apart)

    turns = F.aggregate("ws", start, step, lambda acc: F.filter(F.array_append(acc["done"], acc["open"]), lambda t: t["end"] > t["start"]))
    out = ordered.select("rec_id", F.posexplode(turns).alias("turn_idx", "t"))
    return out.select("rec_id", F.col("turn_idx").cast("bigint").alias("turn_idx"), "t.start", "t.end", "t.label")


def elementary_intervals(bounds: DataFrame) -> DataFrame:
    """(rec_id, start, end) between consecutive distinct boundaries (rec_id, x)."""
    after = F.lead("x").over(Window.partitionBy("rec_id").orderBy("x"))
    return bounds.select("rec_id", "x").distinct().select("rec_id", F.col("x").alias("start"), after.alias("end")).where("end IS NOT NULL")


def spread(spans: DataFrame, seconds: float = BUCKET) -> DataFrame:
    """Spans with a row for each time bucket they touch, so that joins have a second key and long recordings split."""
    return spans.withColumn("_bucket", F.explode(F.sequence(bucket_of(F.col("start"), seconds), F.greatest(bucket_of(F.col("start"), seconds), bucket_of(F.col("end"), seconds)))))


def stab(points: DataFrame, spans: DataFrame, at: str = "mid", seconds: float = BUCKET, how: str = "inner") -> DataFrame:
    """Points joined with the spans (rec_id, start, end, ...) that hold them strictly inside."""
    other = spread(spans, seconds)
    renamed = other.select(*[F.col(c).alias(f"_s_{c}") for c in other.columns])
    hold = (F.col("rec_id") == F.col("_s_rec_id")) & (bucket_of(F.col(at), seconds) == F.col("_s__bucket")) & (F.col("_s_start") < F.col(at)) & (F.col(at) < F.col("_s_end"))
    return points.join(renamed, hold, how)


def subtract(spans: DataFrame, holes: DataFrame) -> DataFrame:
    """(rec_id, start, end) of what the holes leave of the spans' elementary intervals; each is wholly in or out of a hole."""
    bounds = spans.select("rec_id", F.col("start").alias("x")).unionByName(spans.select("rec_id", F.col("end").alias("x"))).unionByName(holes.select("rec_id", F.col("start").alias("x"))).unionByName(holes.select("rec_id", F.col("end").alias("x")))
    parts = elementary_intervals(bounds).withColumn("mid", (F.col("start") + F.col("end")) / 2)
    inside = stab(parts, spans.select("rec_id", "start", "end"), how="left_semi")
    return stab(inside, holes.select("rec_id", "start", "end"), how="left_anti").drop("mid")


def collar_holes(reference: DataFrame, collar: float) -> DataFrame:
    """The merged surroundings of the reference's starts and ends."""
    edges = reference.select("rec_id", F.explode(F.array("start", "end")).alias("x"))
    return merge_intervals(edges.select("rec_id", (F.col("x") - collar).alias("start"), (F.col("x") + collar).alias("end")))


def consecutive_overlap(turns: DataFrame) -> DataFrame:
    """(rec_id, overlapped_seconds): how long each turn's start lies before the end of the one before, summed."""
    before = F.lag("end").over(Window.partitionBy("rec_id").orderBy("start", "end", "turn_idx"))
    return turns.withColumn("_o", F.greatest(F.lit(0.0), before - F.col("start"))).groupBy("rec_id").agg(F.coalesce(F.sum("_o"), F.lit(0.0)).alias("overlapped_seconds"))


def place_utterances(utterances: DataFrame) -> DataFrame:
    """(rec_id, idx, start, end, speaker) one behind the other, ``gap`` seconds apart, from (rec_id, idx, speaker, seconds, gap)."""
    ahead = Window.partitionBy("rec_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("seconds") + F.col("gap")).over(ahead), F.lit(0.0))
    return utterances.withColumn("start", start).select("rec_id", "idx", "start", (F.col("start") + F.col("seconds")).alias("end"), "speaker")
