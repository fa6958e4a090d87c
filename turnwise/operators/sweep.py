"""Parameter sweeps: calibrate on even recordings, report on odd ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import ratio

#: Values of a range of ``numbered``.
RANGE = 4096


def grid(lo: float, hi: float, step: float) -> list[str]:
    """The values lo, lo + step ... hi as keys with two places."""
    n = int(round((hi - lo) / step + 1e-9))
    return [f"{(round(lo * 10_000) + i * round(step * 10_000)) / 10_000:.2f}" for i in range(n + 1) if round(lo * 10_000) + i * round(step * 10_000) <= round(hi * 10_000)]


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Adds the place (from 0) of each row in the order of a unique integer column.

    Rows are numbered within ranges of ``RANGE`` values; only a count for each range meets in one task.
    """
    at = F.floor(F.col(by) / RANGE)
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(at.alias("_range")).agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    return rows.withColumn("_range", at).join(ranges, "_range").withColumn(name, F.col("_ahead") + within).drop("_range", "_ahead")


def with_split(cells: DataFrame, order: str = "mix_idx") -> DataFrame:
    """Adds split: the recordings, by their places in order from 0, are calibration, heldout, calibration and so on."""
    return cells.withColumn("split", F.when(F.col(order) % 2 == 0, "calibration").otherwise("heldout"))


def roll_up(cells: DataFrame) -> DataFrame:
    """(value, split, der, miss, false_alarm, confusion, speakers_correct, recordings) with split ``all`` over both."""
    share = lambda c: ratio(F.sum(c), F.sum("ref_time"))
    right = F.count_if(F.col("num_speakers_ref") == F.col("num_speakers_hyp"))
    sets = cells.groupingSets([["value", "split"], ["value"]], "value", "split")
    out = sets.agg(share(F.col("miss") + F.col("false_alarm") + F.col("confusion")).alias("der"), share("miss").alias("miss"), share("false_alarm").alias("false_alarm"), share("confusion").alias("confusion"), F.concat(right.cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string")).alias("speakers_correct"), F.count(F.lit(1)).alias("recordings"))
    return out.withColumn("split", F.coalesce("split", F.lit("all")))


def pick_value(rolled: DataFrame, split: str = "calibration") -> DataFrame:
    """The value with the least der, ties to the smaller value; NaN counts as the largest."""
    return rolled.where(F.col("split") == split).select("value", "der").orderBy("der", "value").limit(1)
