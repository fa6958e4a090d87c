"""Writers: segments as JSON and SRT, turns as RTTM, reports.

Numbers in text are rounded half to even on their exact binary value. Built-ins round the decimal string instead, so exact
texts come from pandas functions here; queries on times with few binary places can use the built-in forms.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.functions import srt_timestamp


@F.pandas_udf(T.StringType())
def fixed3(x: pd.Series) -> pd.Series:
    """Three places, as text."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.3f}")


@F.pandas_udf(T.DoubleType())
def round3(x: pd.Series) -> pd.Series:
    return x.map(lambda v: round(v, 3))


#: Words of a piece of segments that is written at once at most; a longer segment is written alone.
JSON_WORDS = 1 << 16


def _number(x: float) -> str:
    v = round(x, 3)
    return repr(v) if math.isfinite(v) else json.dumps(v)


def _string(x: str | None) -> str:
    return "null" if x is None else json.dumps(x, ensure_ascii=False)


def segment_jsons(segments: pa.RecordBatch) -> list[str]:
    """Segments as in the file, indented by two from a depth of two. Words are read by column, never as objects."""
    words = segments.column("words")
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_pylist()
    listed = iter(zip(*(words.flatten().field(c).to_pylist() for c in ("start", "end", "text", "probability")), strict=True))
    # nulls of times are NaN
    start, end = (segments.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("start", "end"))
    out = []
    for s, e, who, text, n in zip(start, end, segments.column("speaker").to_pylist(), segments.column("text").to_pylist(), sizes, strict=True):
        ws = [f'        {{\n          "start": {_number(a)},\n          "end": {_number(b)},\n          "text": {_string(t)},\n          "probability": {_number(p)}\n        }}' for a, b, t, p in islice(listed, n)]
        inner = "[\n" + ",\n".join(ws) + "\n      ]" if ws else "[]"
        out.append(f'    {{\n      "speaker": {_string(who)},\n      "start": {_number(s)},\n      "end": {_number(e)},\n      "text": {_string(text)},\n      "words": {inner}\n    }}')
    return out


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_pylist()
        at = 0
        while at < len(sizes):
            end, held = at + 1, sizes[at]
            while end < len(sizes) and held + sizes[end] <= JSON_WORDS:
                held += sizes[end]
                end += 1
            piece = batch.slice(at, end - at)
            yield pa.RecordBatch.from_arrays([piece.column("rec_id"), piece.column("seg_idx"), pa.array(segment_jsons(piece), pa.string())], ["rec_id", "seg_idx", "j"])
            at = end


def segments_to_json(segments: DataFrame) -> DataFrame:
    """(rec_id, json): {"segments": [...]}, indented by two, letters as they are.

    Segments are written in pieces of ``JSON_WORDS`` words, so a worker's memory doesn't grow with the table; a recording's
    text is put together by the engine.
    """
    one = segments.select("rec_id", F.col("seg_idx").cast("bigint").alias("seg_idx"), "start", "end", "speaker", "text", "words").mapInArrow(_written, "rec_id string, seg_idx bigint, j string")
    listed = one.groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "j"))), lambda s: s["j"]).alias("js"))
    return listed.select("rec_id", F.concat(F.lit('{\n  "segments": [\n'), F.array_join("js", ",\n"), F.lit("\n  ]\n}")).alias("json"))


def srt_blocks(segments: DataFrame, stamp=srt_timestamp) -> DataFrame:
    """(rec_id, n, block): numbered from 1, the speaker before the text if there is one."""
    n = F.row_number().over(Window.partitionBy("rec_id").orderBy("seg_idx"))
    text = F.when(F.col("speaker").isNotNull(), F.concat("speaker", F.lit(": "), "text")).otherwise(F.col("text"))
    block = F.concat_ws("\n", n.cast("string"), F.concat(stamp(F.col("start")), F.lit(" --> "), stamp(F.col("end"))), text)
    return segments.select("rec_id", n.alias("n"), block.alias("block"))


def segments_to_srt(segments: DataFrame) -> DataFrame:
    blocks = srt_blocks(segments, exact_stamp)
    return blocks.groupBy("rec_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda b: b["block"]), "\n\n"), F.lit("\n")).alias("srt"))


def exact_stamp(seconds: Column) -> Column:
    return _stamp(seconds)


@F.pandas_udf(T.StringType())
def _stamp(x: pd.Series) -> pd.Series:
    def one(v: float) -> str:
        ms = int(round(max(v, 0.0) * 1000))
        return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"

    return x.map(one)


def rttm_lines(turns: DataFrame, file_id: str | None = None) -> DataFrame:
    """(rec_id, n, line): SPEAKER lines by start; ``file_id`` stands for the recording if given."""
    n = F.row_number().over(Window.partitionBy("rec_id").orderBy("start", "turn_idx"))
    name = F.lit(file_id) if file_id else F.col("rec_id")
    line = F.concat(F.lit("SPEAKER "), name, F.lit(" 1 "), fixed3("start"), F.lit(" "), fixed3(F.col("end") - F.col("start")), F.lit(" <NA> <NA> "), F.col("speaker"), F.lit(" <NA> <NA>"))
    return turns.select("rec_id", n.alias("n"), line.alias("line"))


def turns_to_rttm(turns: DataFrame, file_id: str | None = None) -> DataFrame:
    lines = rttm_lines(turns, file_id)
    return lines.groupBy("rec_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda b: b["line"]), "\n"), F.lit("\n")).alias("rttm"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object: config, overall, per_mixture."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def report_tag(set_name: str, backend: str, model: str, compute: str, device: str, oracle: bool = False, threshold: float | None = None, pad: float | None = None) -> str:
    """The file name of a report, with what differs from the defaults."""
    parts = ["benchmark", *([] if set_name == "plain" else [set_name.replace("-", "_")]), backend, model, compute, device, *(["oracle"] if oracle else []), *([f"thr{threshold:g}"] if threshold is not None else []), *([f"pad{pad:g}"] if pad is not None else [])]
    return "_".join(parts) + ".json"


def sweep_report(rolled: DataFrame, cells: DataFrame, param: str, default: str) -> DataFrame:
    """One row: config, the chosen and the default value with their held-out error, the grid and each recording's cells."""
    from turnwise.operators.sweep import pick_value

    one = lambda *c: F.struct(*[F.bround(x, 4).alias(x) if x in ("der", "miss", "false_alarm", "confusion") else F.col(x) for x in c])
    by_split = rolled.groupBy("value").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", one("der", "miss", "false_alarm", "confusion", "speakers_correct"))))).alias("sets"))
    grid = by_split.agg(F.map_from_entries(F.collect_list(F.struct("value", "sets"))).alias("grid"))
    each = cells.groupBy("mix_id", "mix_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", F.struct("miss", "false_alarm", "confusion", "ref_time", "num_speakers_hyp"))))).alias("by_value"))
    listed = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("mix_idx", "mix_id", "by_value")), lambda a, b: F.sign(a["mix_idx"] - b["mix_idx"]).cast("int")), lambda m: F.struct(m["mix_id"].alias("id"), m["by_value"].alias("by_value"))).alias("per_mixture"))
    config = F.struct(F.lit(param).alias("param"))
    heldout = lambda v: F.try_element_at(F.try_element_at("grid", v), F.lit("heldout"))["der"]
    row = grid.join(listed).join(pick_value(rolled).select(F.col("value").alias("chosen_value")))
    return row.select(config.alias("config"), "chosen_value", heldout(F.col("chosen_value")).alias("chosen_heldout_der"), F.lit(default).alias("default_value"), heldout(F.lit(default)).alias("default_heldout_der"), "grid", "per_mixture")
