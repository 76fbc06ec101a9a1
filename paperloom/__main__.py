"""``python -m paperloom build`` builds an index of a file of JSON lines; ``python -m paperloom ask`` answers typed queries from it."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from paperloom.config import SearchConfig, Settings
from paperloom.plans.engine import SearchEngine, build_indexes
from paperloom.sources.jsonl import read_corpus


def main(arguments: list[str]) -> None:
    command, *options = arguments or ["ask"]
    settings = Settings.read(options)
    spark = SparkSession.builder.getOrCreate()
    config = SearchConfig(shards=settings.shards)
    if command == "build":
        papers, lines = read_corpus(spark, settings.dataset, settings.max_docs)
        build_indexes(papers, settings.output, config, lines=lines)
        return
    engine = SearchEngine(spark, settings.output, config)
    while query := input("query: ").strip():
        for n, found in enumerate(engine.search(query), 1):
            print(f"{n}. {found['title']} ({found['id']})\n   {', '.join(found['authors']) or 'Unknown authors'}")


if __name__ == "__main__":
    main(sys.argv[1:])
