"""topograph crawl ROOT --levels a,b --output FOLDER"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from topograph.errors import TopographError
from topograph.functions.text import level_list
from topograph.sources import artifacts
from topograph.sources.crawl import Crawler

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="topograph")
    p.add_argument("--version", action="version", version=f"%(prog)s {VERSION}")
    crawl = p.add_subparsers(dest="command", required=True).add_parser("crawl", help="crawl a folder and write its four artifacts")
    crawl.add_argument("root")
    crawl.add_argument("--levels", type=level_list, default=None, help="comma-separated level names; inferred if left out")
    crawl.add_argument("--output", required=True)
    crawl.add_argument("--text-sample-chars", type=int, default=1000)
    for flag in ("strict-unknown-extensions", "follow-symlinks", "require-text", "quiet"):
        crawl.add_argument(f"--{flag}", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done, 1: a failure of ours, 2: there is no such folder."""
    args = parser().parse_args(argv)
    root = Path(args.root).expanduser()
    if not root.is_dir():
        print(f"error: no folder {root}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("topograph").getOrCreate()
    try:
        crawler = Crawler(root, args.levels, text_sample_chars=args.text_sample_chars, follow_symlinks=args.follow_symlinks, require_text=args.require_text, strict_unknown_extensions=args.strict_unknown_extensions)
        documents = crawler.documents(spark).persist()
        built = artifacts.build(documents, crawler.level_names)
        paths = artifacts.write_json(built, Path(args.output).expanduser())
        if not args.quiet:
            print(json.dumps({"document_count": documents.count(), "corpus_version": built.version, "level_names": built.level_names, "artifacts": {k: str(v) for k, v in paths.items()}}, indent=2))
    except TopographError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
