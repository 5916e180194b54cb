"""python -m lodestone.cli embed|search|info"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .operators.embedding import CHAIN, Retrying, first_provider
from .plans import code_search

STORE = ".lodestone"


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    commands = parser.add_subparsers(dest="command", required=True)
    embed = commands.add_parser("embed", help="index the text files of a directory")
    search = commands.add_parser("search", help="search an index")
    search.add_argument("query")
    search.add_argument("-k", "--k", type=int, default=10)
    info = commands.add_parser("info", help="describe an index")
    for p in (embed, search, info):
        p.add_argument("-d", "--directory", default=".")
    for p in (embed, search):
        p.add_argument("--provider", default=",".join(CHAIN), help="providers in order of preference, comma-separated")
        p.add_argument("--url", default="http://localhost:8080")
        p.add_argument("--model", default="default")
    asked = parser.parse_args(args)
    root = os.path.abspath(asked.directory)
    store = os.path.join(root, STORE)
    if asked.command != "embed" and not os.path.exists(store):
        print(f"no index in {root}; run embed first", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if asked.command == "info":
        _, meta = code_search.load(spark, store)
        row = meta.first()
        print(f"vectors: {row.num_chunks}\ndimensions: {row.dims}\nmodel: {row.model}")
        return 0
    provider = Retrying(first_provider(asked.provider.split(","), url=asked.url, model=asked.model))
    if asked.command == "embed":
        row = code_search.build(spark, root, store, provider).first()
        print(f"indexed {row.num_chunks} chunks")
        return 0
    for r in code_search.search(spark, store, asked.query, provider, asked.k).collect():
        print(f"{r['rank']}. {r['file']}:{r['lines']}  {r['similarity']:.3f}\n   {r['preview']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
