"""The command line: ``python -m pairloom submission|split|features``; every path may also come from the environment."""

from __future__ import annotations

import argparse
import os
from importlib import import_module

from pyspark.sql import SparkSession

from pairloom.operators import features, items, scoring, split
from pairloom.sources import io


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="pairloom", description=__doc__)
    out.add_argument("command", choices=["submission", "split", "features"])
    for name, short in (("output", "o"), ("items", "i"), ("matches", "m")):
        known = os.environ.get(f"PAIRLOOM_{name.upper()}_PATH")
        out.add_argument(f"--{name}_path", f"--{name}-path", f"-{short}", dest=f"{name}_path", default=known, required=known is None and name != "items")
    out.add_argument("--scorer", help="module:name of a scorer without arguments", default=os.environ.get("PAIRLOOM_SCORER"))
    out.add_argument("--logits", action="store_true", help="the scorer gives logits")
    out.add_argument("--fraction", type=float, default=0.2)
    out.add_argument("--seed", type=int, default=42)
    return out


def main(argv: list[str] | None = None) -> None:
    arguments = parser()
    args = arguments.parse_args(argv)
    if args.command != "split" and not args.items_path:
        arguments.error("--items_path is missing")
    spark = SparkSession.builder.getOrCreate()
    cards = io.read_items(spark, args.items_path) if args.items_path else None
    if args.command == "submission":
        if not args.scorer or ":" not in args.scorer:
            arguments.error("--scorer is no module:name")
        module, name = args.scorer.split(":")
        found = scoring.submission(cards, io.read_pairs(spark, args.matches_path, target=False), getattr(import_module(module), name)(), args.logits)
        io.write_csv(found, args.output_path, one_file=True)
    elif args.command == "split":
        pairs = io.read_pairs(spark, args.matches_path)
        named = items.with_category(pairs, cards) if cards is not None else spark.read.parquet(args.matches_path)
        io.write_parquet(split.split_pairs(named, args.fraction, args.seed), args.output_path)
    else:
        io.write_features(features.pair_features(io.read_pairs(spark, args.matches_path), items.item_records(cards)), args.output_path)


if __name__ == "__main__":
    main()
