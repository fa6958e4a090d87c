"""Column functions: times, text and vectors. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_seconds(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def gap_seconds(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The distance of two spans; 0 if they touch or overlap."""
    return F.greatest(F.lit(0.0), b_start - a_end, a_start - b_end)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NaN where there is nothing to divide by."""
    return F.when(den > 0, num / den).otherwise(F.lit(float("nan")))


def real_time_factor(seconds: Column, duration: Column) -> Column:
    return ratio(seconds, duration)


def speaker_label(index: Column) -> Column:
    """SPEAKER_00 and so on; wider from 100."""
    return F.format_string("SPEAKER_%02d", index)


def srt_timestamp(seconds: Column) -> Column:
    """HH:MM:SS,mmm of seconds, negative ones as 0, rounded half to even."""
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000, 0).cast("bigint")
    part = lambda div, mod: F.floor(ms / div).cast("bigint") % mod if mod else F.floor(ms / div).cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), ms % 1000)


def clock(seconds: Column) -> Column:
    """m:ss."""
    whole = F.floor(seconds).cast("bigint")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def normalize_words(text: Column) -> Column:
    """Lower-cased words of a-z, 0-9 and inner apostrophes, for scoring."""
    # letters one by one: a set in Java's regular expressions, where a denied union of ranges takes a microsecond a letter
    kept = F.regexp_replace(F.lower(text), "[^abcdefghijklmnopqrstuvwxyz0123456789' ]+", " ")
    inner = F.regexp_replace(kept, r"(?<![a-z])'|'(?![a-z])", " ")
    return F.filter(F.split(inner, " +"), lambda w: w != "")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; a zero vector counts as of norm 1."""
    norm = lambda v: F.sqrt(dot(v, v))
    unit = lambda n: F.when(n > 0, n).otherwise(F.lit(1.0))
    return F.lit(1.0) - dot(a, b) / (unit(norm(a)) * unit(norm(b)))


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0)))


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, F.abs))
