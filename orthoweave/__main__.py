"""Command line: build a lexicon, or print a report on a text.

    python -m orthoweave build FOLDER TARGET
    python -m orthoweave text LANG [--lexicon TARGET] [--dictionary FOLDER] [--stopwords FOLDER] [--word WORD] [--phrases N]
        [--threshold T] [--margin M] [--detect] < text
    python -m orthoweave senses WORD LANG [--lexicon TARGET]
    python -m orthoweave sources TARGET

Without ``--lexicon`` a small lexicon of our own is used, which is for trying things out.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .plans import analyses
from .sources import fixtures, tabs


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="orthoweave")
    commands = out.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("folder")
    build.add_argument("target")
    sources = commands.add_parser("sources")
    sources.add_argument("target")
    text, senses = commands.add_parser("text"), commands.add_parser("senses")
    text.add_argument("lang")
    senses.add_argument("word")
    senses.add_argument("lang")
    for command in (text, senses):
        command.add_argument("--lexicon")
        command.add_argument("--dictionary")
        command.add_argument("--stopwords")
    text.add_argument("--word")
    text.add_argument("--detect", action="store_true")
    text.add_argument("--phrases", type=int, default=1)
    text.add_argument("--threshold", type=float, default=0.0)
    text.add_argument("--margin", type=float, default=0.25)
    return out


def lexicon_of(spark: SparkSession, given: argparse.Namespace) -> fixtures.Lexicon:
    return tabs.open_lexicon(spark, given.lexicon, given.dictionary, given.stopwords) if given.lexicon else fixtures.lexicon(spark)


def frames(spark: SparkSession, given: argparse.Namespace, text: str) -> dict[str, DataFrame]:
    """What a command prints, by name."""
    if given.command == "sources":
        return {"sources": tabs.attribution(tabs.open_tables(spark, given.target)["sources"])}
    lex = lexicon_of(spark, given)
    if given.command == "senses":
        return {"senses": analyses.explored(given.word, given.lang, lex)}
    rows = spark.createDataFrame([(0, text, given.lang)], "text_id long, text string, lang string")
    found = analyses.contrast(rows, lex, given.word, analyses.Choice(given.threshold, given.margin), detect=given.detect, longest_phrase=given.phrases)
    return {name: found[name] for name in ("languages", "coverage")} | {"report": analyses.report(found).orderBy("place")}


def main(args: list[str]) -> None:
    given = parser().parse_args(args)
    spark = SparkSession.builder.appName("orthoweave").getOrCreate()
    if given.command == "build":
        print(tabs.build(spark, given.folder, given.target))
        return
    for df in frames(spark, given, sys.stdin.read() if given.command == "text" else "").values():
        df.show(100, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
