"""Command line: curate, inspect, doctor, pipeline run, augment."""

from __future__ import annotations

import argparse
import json
import sys

from larkspur import __version__
from larkspur.plans import machine
from larkspur.sources.audio import parse_extensions, patterns_of


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="larkspur", description="Curate audio and speech corpora on Spark.")
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("--verbose", action="store_true", help="show Spark's warnings")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("curate", help="filter a folder of audio into a manifest")
    c.add_argument("source"), c.add_argument("output")
    c.add_argument("--tts", action="store_true", help="training layout with WAV files and manifests")
    c.add_argument("--extensions", default="wav")
    c.add_argument("--checkpoint"), c.add_argument("--speaker", default="speaker_00")
    c.add_argument("--vad-threshold", type=float, default=0.3), c.add_argument("--snr-min", type=float)
    c.add_argument("--min-duration", type=float, default=2.0), c.add_argument("--max-duration", type=float, default=15.0)
    c.add_argument("--segment", action="store_true"), c.add_argument("--enhance"), c.add_argument("--transcribe")
    c.add_argument("--dedup-threshold", type=int), c.add_argument("--formats", "--format", default="ljspeech,f5tts")
    c.add_argument("--turns", help="Parquet table of speaker turns (doc_id, speaker_id, start, end), in place of a diarization model")
    c.add_argument("--min-speakers", type=int), c.add_argument("--max-speakers", type=int)
    c.add_argument("--workers", type=int, help="local worker threads"), c.add_argument("--warn-mb", type=int, help="note files over this size")
    c.add_argument("--progress", action="store_true", help="show running tasks on standard error")
    i = sub.add_parser("inspect", help="durations and formats of a folder")
    i.add_argument("source"), i.add_argument("--extensions", default="wav"), i.add_argument("--limit", type=int)
    sub.add_parser("doctor", help="capacity of this machine")
    p = sub.add_parser("pipeline", help="run the curate, train, preview machine")
    p.add_argument("action", choices=["run"]), p.add_argument("--state", required=True), p.add_argument("--curate", nargs=2, metavar=("SOURCE", "OUTPUT"))
    a = sub.add_parser("augment", help="synthetic clips from a manifest's texts")
    a.add_argument("manifest"), a.add_argument("output"), a.add_argument("--voice", default="default"), a.add_argument("--limit", type=int)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "doctor":
        print(json.dumps(machine.advise(), indent=2))
        return 0
    from pyspark.sql import SparkSession

    from larkspur.plans.curate import curate, curate_tts, inspect
    from larkspur.plans.progress import watch
    from larkspur.sources import manifests

    builder = SparkSession.builder.appName("larkspur")
    if getattr(args, "workers", None):
        builder = builder.master(f"local[{args.workers}]")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN" if args.verbose else "ERROR")
    if args.command == "curate":
        source = patterns_of(args.source, parse_extensions(args.extensions))
        reader = {"warn_bytes": args.warn_mb << 20} if args.warn_mb else {}
        with watch(spark, (lambda p: print(p, file=sys.stderr)) if args.progress else None):
            if args.tts:
                made = curate_tts(
                    spark, source, args.output, tuple(parse_extensions(args.formats)), args.checkpoint, args.speaker,
                    snr_min=20.0 if args.snr_min is None else args.snr_min, least_seconds=args.min_duration, most_seconds=args.max_duration,
                    segment=args.segment, transcriber=args.transcribe, dedup_threshold=args.dedup_threshold,
                    turns=spark.read.parquet(args.turns) if args.turns else None, min_speakers=args.min_speakers, max_speakers=args.max_speakers, **reader,
                )
            else:
                made = curate(
                    spark, source, args.output, args.checkpoint, __version__, vad_threshold=args.vad_threshold,
                    snr_min=15.0 if args.snr_min is None else args.snr_min, enhancer=args.enhance, segment=args.segment, **reader,
                )
        print(json.dumps(made, indent=2))
    elif args.command == "inspect":
        print(json.dumps(inspect(spark, patterns_of(args.source, parse_extensions(args.extensions)), args.limit), indent=2))
    elif args.command == "augment":
        rows = manifests.parse_for_augmentation(manifests.read_lines(spark, args.manifest), args.limit)
        print(manifests.synthesize(rows, args.output, args.voice).count(), "clips")
    else:
        steps = {"curated": lambda: curate_tts(spark, f"{args.curate[0]}/*.wav", args.curate[1])} if args.curate else {}
        print(machine.run_machine(args.state, steps))
    return 0


if __name__ == "__main__":
    sys.exit(main())
