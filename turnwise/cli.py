"""Command line: transcribe, diarize, attribute, bench.

Acoustic models are pluggable: ``--models module`` names a module with ``vad``, ``embed`` and ``transcribe`` functions; the
built-in stand-ins make the plans run without any.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.operators import align, sweep
from turnwise.plans import attribute as plans
from turnwise.sources import annotations, formats
from turnwise.sources import audio as sound
from turnwise.streaming import models


#: Lowest, highest and step of the grids.
GRIDS = {"threshold": (0.30, 0.90, 0.05), "pad": (0.00, 0.40, 0.05)}


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="turnwise")
    sub = parser.add_subparsers(dest="command", required=True)
    model = argparse.ArgumentParser(add_help=False)
    model.add_argument("--models", default="", help="module with vad, embed and transcribe")
    model.add_argument("--model", default="small")
    model.add_argument("--device", default="cpu", choices=["cpu", "cuda"])
    model.add_argument("--compute-type", default="int8")
    model.add_argument("--language", default=None)
    speakers = argparse.ArgumentParser(add_help=False)
    speakers.add_argument("--backend", default="clustered", choices=["clustered", "rttm"])
    speakers.add_argument("--turns", default=None, help="RTTM files of another diarizer, for --backend rttm")
    speakers.add_argument("--num-speakers", type=int, default=None)
    speakers.add_argument("--distance-threshold", type=float, default=0.75)
    t = sub.add_parser("transcribe", parents=[model])
    d = sub.add_parser("diarize", parents=[model, speakers])
    a = sub.add_parser("attribute", parents=[model, speakers])
    for p in (t, d, a):
        p.add_argument("audio")
    for p in (t, a):
        p.add_argument("--json", default=None)
        p.add_argument("--srt", default=None)
    d.add_argument("--rttm", default=None)
    b = sub.add_parser("bench").add_subparsers(dest="step", required=True)
    run = b.add_parser("run", parents=[model, speakers])
    run.add_argument("--set", default="plain", choices=["plain", "overlap", "ami", "ami-dev"])
    run.add_argument("--manifest", required=True)
    run.add_argument("--collar", type=float, default=0.25)
    run.add_argument("--out", required=True)
    build = b.add_parser("build")
    build.add_argument("--corpus", required=True, help="folder of speaker/chapter/utterance.wav with *.trans.txt")
    build.add_argument("--mixtures", type=int, default=12)
    build.add_argument("--utterances", type=int, default=9)
    build.add_argument("--max-utt-seconds", type=float, default=10.0)
    build.add_argument("--seed", type=int, default=0)
    build.add_argument("--overlap-prob", type=float, default=0.0)
    build.add_argument("--out", required=True)
    grid = b.add_parser("sweep", parents=[model])
    grid.add_argument("--out", default=None, help="write the report here")
    grid.add_argument("--manifest", required=True)
    grid.add_argument("--collar", type=float, default=0.25)
    grid.add_argument("--param", default="threshold", choices=sorted(GRIDS))
    for name in ("lo", "hi", "step"):
        grid.add_argument(f"--{name}", type=float, default=None, help="of the grid; each parameter has its own defaults")
    return parser


def _models(args: argparse.Namespace):
    if not args.models:
        return models.energy_vad, models.spectral_embedding, models.silent_asr
    m = importlib.import_module(args.models)
    return m.vad, m.embed, m.transcribe


def _turns(spark: SparkSession, audio: DataFrame, args: argparse.Namespace) -> DataFrame:
    if args.backend == "rttm":
        if not args.turns:
            raise SystemExit("--backend rttm needs --turns")
        return annotations.read_rttm(spark, args.turns)
    vad, embed, _ = _models(args)
    return plans.diarize(audio, vad, embed, models.ClusteredConfig(distance_threshold=args.distance_threshold, num_speakers=args.num_speakers))


def _emit(text: str, path: str | None) -> None:
    if path is None:
        sys.stdout.write(text if text.endswith("\n") else text + "\n")
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def _write(segments: DataFrame, args: argparse.Namespace) -> None:
    """JSON unless only SRT is asked for. One recording: its text is small enough to print."""
    segments = segments.persist()
    if args.srt is None or args.json is not None:
        row = formats.segments_to_json(segments).first()
        _emit(row.json if row else '{\n  "segments": []\n}', args.json)
    if args.srt is not None:
        row = formats.segments_to_srt(segments).first()
        _emit(row.srt if row else "", args.srt)
    segments.unpersist()


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    spark = SparkSession.builder.appName("turnwise").getOrCreate()
    if args.command == "bench" and args.step == "build":
        from turnwise.plans.build import build_set

        clips = sound.read_audio(spark, f"{args.corpus}/*/*/*.wav").select(F.col("rec_id").alias("utt_id"), "path", "duration", "sample_rate", "samples", F.element_at(F.split("path", "/"), -3).alias("speaker"))
        chosen = annotations.select_utterances(clips, annotations.read_transcripts(spark, args.corpus), args.max_utt_seconds, args.utterances)
        made = build_set(chosen.withColumnRenamed("text", "transcript"), args.mixtures, args.utterances, args.seed, args.overlap_prob).persist()
        formats.write_manifest(made.drop("samples", "sample_rate"), f"{args.out}/manifest")
        sound.with_wav(made).select("id", "wav").write.mode("overwrite").parquet(f"{args.out}/audio.parquet")
        return 0
    if args.command == "bench":
        manifest = annotations.read_manifest(spark, args.manifest)
        audio = sound.read_audio(spark, f"{args.manifest.rsplit('/', 1)[0]}/audio")
        reference = annotations.manifest_turns(manifest)
        vad, embed, asr = _models(args)
        if args.step == "run":
            rows = manifest.select(F.col("id").alias("rec_id"), "duration", "num_speakers", "text")
            each, overall = plans.benchmark(rows, reference, _turns(spark, audio, args), plans.transcribe(audio, asr), args.collar)
            listed = each.agg(F.array_sort(F.collect_list(F.struct(*each.columns))).alias("per_mixture"))
            tag = formats.report_tag(args.set, args.backend, args.model, args.compute_type, args.device)
            formats.write_report(overall.select(F.struct(*overall.columns).alias("overall")).join(listed), f"{args.out}/{tag}")
            return 0
        from turnwise.operators.timeline import merge_regions, slice_windows

        c = models.ClusteredConfig()
        order = manifest.select(F.col("id").alias("rec_id"), (F.dense_rank().over(Window.orderBy("id")) - 1).alias("mix_idx"))  # a row a recording, of the manifest alone
        bounds = [given if given is not None else known for given, known in zip((args.lo, args.hi, args.step), GRIDS[args.param], strict=True)]
        values = sweep.grid(*bounds)
        if args.param == "pad":
            cells = plans.sweep_pad(audio, vad, embed, reference, values, order, args.collar).persist()
        else:
            regions = merge_regions(plans.detect_regions(audio, vad), c.min_gap, c.min_duration, c.vad_pad)
            cells = plans.sweep_threshold(plans.embed_windows(audio, slice_windows(regions), embed).persist(), reference, values, order, args.collar).persist()
        rolled = sweep.roll_up(cells).persist()
        rolled.orderBy("value", "split").show(200, truncate=False)
        if args.out:
            formats.write_report(formats.sweep_report(rolled, cells, args.param, f"{c.vad_pad if args.param == 'pad' else c.distance_threshold:.2f}"), args.out)
        return 0
    audio = sound.read_audio(spark, args.audio)
    if args.command == "diarize":
        row = formats.turns_to_rttm(_turns(spark, audio, args)).first()
        _emit(row.rttm if row else "", args.rttm)
        return 0
    words = plans.transcribe(audio, _models(args)[2]).drop("seconds")
    spoken = words.withColumn("speaker", F.lit(None).cast("string")) if args.command == "transcribe" else align.assign_words(words, _turns(spark, audio, args))
    _write(align.group_segments(spoken), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
