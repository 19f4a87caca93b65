"""Command line: prepare a corpus, build its index, ask it."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from lexquarry.config import EngineConfig
from lexquarry.functions.quality import TierLimits
from lexquarry.plans.pipelines import AnswerPipeline, CorpusPipeline, build_index, load_search, refresh_index
from lexquarry.sources import files

LEAVE = {"exit", "quit"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lexquarry")
    commands = out.add_subparsers(dest="command", required=True)
    prepare = commands.add_parser("prepare", help="texts to graded articles")
    prepare.add_argument("--input", required=True)
    prepare.add_argument("--output-dir", required=True)
    limits = TierLimits()
    prepare.add_argument("--suspicious-threshold", type=float, default=limits.suspicious)
    prepare.add_argument("--tier-a-threshold", type=float, default=limits.trusted)
    prepare.add_argument("--tier-c-threshold", type=float, default=limits.quarantine)
    prepare.add_argument("--max-low-block-ratio", type=float, default=limits.low_ratio)
    prepare.add_argument("--critical-repeat-threshold", type=int, default=limits.critical)
    index = commands.add_parser("index", help="embed the corpus")
    index.add_argument("--force", action="store_true", help="build anew, whatever is there")
    index.add_argument("--refresh", action="store_true", help="embed the chunks that have changed, keep the others")
    ask = commands.add_parser("ask", help="one question, or a session")
    ask.add_argument("--query")
    ask.add_argument("--allow-low-confidence", action="store_true")
    ask.add_argument("--show-debug", action="store_true")
    ask.add_argument("--provider")
    return out


def show(state: dict, debug: bool) -> str:
    lines = [state["answer"]]
    if debug:
        lines += [f"confidence: {state['confidence']}", f"tiers: {state['tier_path']}", f"warnings: {' '.join(state['warnings']) or 'none'}"]
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    args, config = parser().parse_args(argv), EngineConfig.from_env()
    spark = SparkSession.builder.appName("lexquarry").getOrCreate()
    if args.command == "prepare":
        limits = TierLimits(args.tier_a_threshold, args.tier_c_threshold, args.max_low_block_ratio, args.critical_repeat_threshold, args.suspicious_threshold)
        run = CorpusPipeline(files.read_lines(spark, args.input), replace(config, tiers=limits))
        run.write(args.output_dir, source=args.input)
        print(run.report(args.input, args.output_dir).toJSON().first())
        run.release()
    elif args.command == "index":
        articles = load_search(spark, replace(config, use_vectors=False))[0].articles
        if args.refresh:
            print(f"changed: {', '.join(f'{tier}/{chunk}' for tier, chunk in refresh_index(articles, config)) or 'nothing'}")
        else:
            build_index(articles, config, args.force)
    else:
        search, warnings = load_search(spark, replace(config, generator=args.provider or config.generator))
        for w in warnings:
            print(f"warning: {w}")
        session = AnswerPipeline(search)
        while True:
            query = args.query or input("> ").strip()
            if query.lower() in LEAVE:
                return 0
            if query:
                print(show(session.ask(query, args.allow_low_confidence), args.show_debug))
            if args.query:
                return 0
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
