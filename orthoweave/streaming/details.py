"""Analyses over streams: what needs one text at a time runs unchanged on a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folders import shared_folder
from ..functions.joins import small
from ..operators.senses import candidates
from ..operators.tokens import bare_tokens, eligible, lemmatised
from ..operators.translations import scored_translations
from ..operators.units import nouns
from ..sources.fixtures import Lexicon


def text_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def unit_words(texts: DataFrame, lex: Lexicon) -> DataFrame:
    """(text_id, lang, lemma, target_lang, target, score) of nominal units with one sense only.

    Stateless: tokens are joined to static lexicon tables, so a stream runs in append mode. Senses of several need a
    sentence's context and are left to batch analyses.
    """
    rows = eligible(lemmatised(bare_tokens(texts)), lex.stopwords)
    table = candidates(nouns(lex.lemmas), lex.lemmas, lex.definitions, "n")
    single = table.groupBy("lang", "lemma").agg(F.count("*").alias("senses"), F.first("synset_offset").alias("synset_offset"), F.first("pos").alias("pos")).where("senses = 1")
    words = small(scored_translations(single, lex.lemmas))
    return rows.join(small(single.drop("senses")), ["lang", "lemma"]).join(words, ["lemma", "synset_offset", "pos"]).select("text_id", "lang", "lemma", "target_lang", "target", "score")


def running_ranking(details: DataFrame) -> DataFrame:
    """Mean score of each pair of languages so far; needs complete or update mode on a stream."""
    return details.groupBy("lang", "target_lang").agg(F.avg("score").alias("score"), F.count("*").alias("n"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a table in the shared folder, and return the table.

    Rows go to Parquet files by way of a checkpoint; in complete mode each batch replaces the one before. A run under a ``name`` that
    was used before goes on where that one stopped.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        running = writer.format("parquet").start(f"{path}/rows")
    else:
        running = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/rows")).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
