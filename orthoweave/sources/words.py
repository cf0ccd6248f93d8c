"""Word lists, dictionary files and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_code


def stopword_overlay(spark: SparkSession, folder: str, built_in: DataFrame) -> DataFrame:
    """Built-in stopwords and those of ``stopwords-<code>.txt`` files in folder, distinct."""
    lines = spark.read.option("pathGlobFilter", "stopwords-*.txt").text(folder).select(F.col("_metadata.file_name").alias("file"), F.lower(F.trim("value")).alias("word"))
    own = lines.where((F.col("word") != "") & ~F.col("word").startswith("#"))
    own = own.select(normal_code(F.regexp_extract("file", r"stopwords-(.+)\.txt$", 1)).alias("lang"), "word")
    return built_in.select("lang", "word").unionByName(own).distinct()


#: What the licence in every dictionary file names, and kinds of pointers. Fixed values.
DICTIONARY_VERSION = "WordNet 3.0"
POINTERS = {"@": "hypernym", "~": "hyponym"}
_PARTS = {"noun": "n", "verb": "v", "adj": "a", "adv": "r"}


def _dictionary(spark: SparkSession, folder: str, files: str) -> DataFrame:
    """(file, value): lines of dictionary files; raises unless their licence, in lines that start with a space, names the version."""
    lines = spark.read.option("pathGlobFilter", files).text(folder).select(F.col("_metadata.file_name").alias("file"), "value")
    wrong = lines.groupBy("file").agg(F.max(F.when(F.col("value").startswith(" "), F.contains("value", F.lit(DICTIONARY_VERSION)))).alias("ok")).where("not coalesce(ok, false)")
    bad = [r.file for r in wrong.limit(10).collect()]
    if bad:
        raise ValueError(f"not {DICTIONARY_VERSION}: {', '.join(sorted(bad))}")
    return lines.where(~F.col("value").startswith(" "))


def _synsets(spark: SparkSession, folder: str) -> DataFrame:
    """(synset_offset, pos, words, pointers, rest, def) of the ``data.*`` files.

    The files' public layout: offset, file number, type, word count in hex, words each with a hex number, pointer count, pointers
    of four fields, verb frames, and the gloss after ``|``.
    """
    lines = _dictionary(spark, folder, "data.*")
    halves = F.split("value", r"\|", 2)
    rows = lines.select(F.split(F.trim(F.element_at(halves, 1)), " +").alias("f"), F.trim(F.get(halves, F.lit(1))).alias("def"))
    n = F.conv(F.get("f", F.lit(3)), 16, 10).try_cast("int")
    # a row without numbers in their places, as a licence line, has none of them
    rows = rows.withColumn("n", n).withColumn("m", F.get("f", F.col("n") * 2 + 4).try_cast("int"))
    return rows.select(
        F.get("f", F.lit(0)).alias("synset_offset"),
        F.get("f", F.lit(2)).alias("pos"),
        F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.get("f", k * 2 + 4)).alias("words"),
        F.when(F.col("m") > 0, F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.slice("f", F.col("n") * 2 + k * 4 + 6, 4))).alias("pointers"),
        F.expr("slice(f, n * 2 + coalesce(m, 0) * 4 + 6, size(f))").alias("rest"),
        "def",
    )


def wordnet_data(spark: SparkSession, folder: str) -> DataFrame:
    """(synset_offset, pos, lang, lemma, sense_order, def) of the English dictionary's ``data.*`` files."""
    rows = _synsets(spark, folder).select("synset_offset", "pos", F.lit("eng").alias("lang"), F.posexplode("words").alias("sense_order", "lemma"), "def")
    return rows.withColumn("lemma", F.regexp_replace("lemma", r"\((a|p|ip)\)$", ""))


def wordnet_relations(spark: SparkSession, folder: str) -> DataFrame:
    """(synset_offset, pos, relation, to_offset, to_pos): pointers to more general and more special synsets."""
    rows = _synsets(spark, folder).select("synset_offset", "pos", F.explode("pointers").alias("p"))
    kinds = F.create_map(*[F.lit(x) for kv in POINTERS.items() for x in kv])
    rows = rows.select("synset_offset", "pos", F.element_at(kinds, F.get("p", F.lit(0)).substr(1, 1)).alias("relation"), F.get("p", F.lit(1)).alias("to_offset"), F.get("p", F.lit(2)).alias("to_pos"))
    return rows.where("relation is not null")


def wordnet_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(synset_offset, pos, frame): verb frames, as texts of ``verb.Framestext`` (``frames.vrb``) where the folder has one."""
    rows = _synsets(spark, folder).where("pos = 'v'").select("synset_offset", "pos", F.explode(F.expr("filter(transform(rest, (x, k) -> if(x = '+', try_cast(get(rest, k + 1) as int), null)), x -> x is not null)")).alias("number"))
    texts_ = spark.read.option("pathGlobFilter", "{verb.Framestext,frames.vrb}").text(folder)
    table = texts_.select(F.regexp_extract("value", r"^(\d+)", 1).cast("int").alias("number"), F.regexp_extract("value", r"^\d+[ \t]+(.*)", 1).alias("frame"))
    return rows.distinct().join(table.where("number is not null"), "number").select("synset_offset", "pos", "frame")


def wordnet_index(spark: SparkSession, folder: str) -> DataFrame:
    """(lemma, pos, synset_offset, sense_number) of the ``index.noun``, ``.verb``, ``.adj`` and ``.adv`` files; senses count from 1."""
    lines = _dictionary(spark, folder, "index.{noun,verb,adj,adv}")
    f = F.split(F.trim("value"), " +")
    n = F.get(f, F.lit(2)).try_cast("int")
    rows = lines.select(F.get(f, F.lit(0)).alias("lemma"), F.get(f, F.lit(1)).alias("pos"), F.posexplode(F.slice(f, F.size(f) - n + 1, n)).alias("k", "synset_offset"))
    return rows.select("lemma", "pos", "synset_offset", (F.col("k") + 1).alias("sense_number"))


def wordnet_exceptions(spark: SparkSession, folder: str) -> DataFrame:
    """(pos, form, base) of the ``*.exc`` files of irregular forms, as ``senses.stemmed`` takes them."""
    lines = spark.read.option("pathGlobFilter", "{noun,verb,adj,adv}.exc").text(folder).select(F.regexp_extract(F.col("_metadata.file_name"), r"(\w+)\.exc$", 1).alias("part"), F.split(F.trim("value"), " +").alias("f"))
    parts = F.create_map(*[F.lit(x) for kv in _PARTS.items() for x in kv])
    rows = lines.where(F.size("f") > 1).select(F.element_at(parts, F.col("part")).alias("pos"), F.translate(F.get("f", F.lit(0)), "_", " ").alias("form"), F.explode(F.slice("f", 2, 99)).alias("base"))
    return rows.withColumn("base", F.translate("base", "_", " ")).distinct()


def stored(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of texts, read in buffers of a few MB.

    A vectored read takes all of a row group's texts at once, through direct memory of that size which its thread then keeps:
    outside the heap, an executor holds the largest row group once more for each such thread.
    """
    return spark.read.option("parquet.hadoop.vectored.io.enabled", "false").parquet(path)


def texts(df: DataFrame, text_id: str, text: str, lang) -> DataFrame:
    """(text_id, text, lang) of any table; lang is a column or a code for all rows."""
    code = normal_code(F.col(lang) if lang in df.columns else F.lit(lang)) if isinstance(lang, str) else normal_code(lang)
    return df.select(F.col(text_id).alias("text_id"), F.col(text).alias("text"), code.alias("lang"))
