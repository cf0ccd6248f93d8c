"""Tab files of a multilingual wordnet: reading, the tables in them, and writing them out."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fixtures import Lexicon, local, stopword_rows
from .words import stopword_overlay, wordnet_frames, wordnet_relations

#: Tables of a built lexicon.
TABLES = {
    "lemmas": "synset_offset string, pos string, synset_id string, lemma string, lang string",
    "definitions": "synset_offset string, pos string, synset_id string, def string, lang string",
    "sources": "lang string, name string, url string, license string, file string",
}
FILE_NAME = r"wn-data-([a-z]{2,3})\.tab$"


def read_tab_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content) of the folder's tab files at any depth; raises if there is none."""
    found = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "wn-data-*.tab")
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))
    )
    if not found.take(1):
        raise FileNotFoundError(f"no wn-data-*.tab under {folder}")
    return found


def tab_lines(files: DataFrame) -> DataFrame:
    """(file, lang, line_no, line): stripped lines that aren't empty, of files whose name gives a language."""
    named = files.where(F.col("file").rlike(FILE_NAME)).withColumn("lang", F.regexp_extract("file", FILE_NAME, 1))
    named = named.withColumn("lang", F.when(F.col("lang") == "en", "eng").otherwise(F.col("lang")))
    lines = named.select("file", "lang", F.posexplode(F.split("content", "\n")).alias("line_no", "raw"))
    stripped = F.regexp_replace("raw", r"^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$", "")
    return lines.select("file", "lang", "line_no", stripped.alias("line")).where("line <> ''")


def _rows(files: DataFrame) -> DataFrame:
    fields = F.split("line", "\t", -1)
    rows = tab_lines(files).where(~F.col("line").startswith("#")).withColumn("fields", fields).where(F.size("fields") >= 3)
    key, dash = F.element_at("fields", 1), F.instr(F.element_at("fields", 1), "-")
    return rows.select(
        "lang",
        F.when(dash > 0, key.substr(F.lit(1), dash - 1)).otherwise(key.substr(F.lit(1), F.length(key) - 1)).alias("synset_offset"),
        F.when(dash > 0, key.substr(dash + 1, F.length(key))).otherwise(key.substr(F.length(key), F.lit(1))).alias("pos"),
        key.alias("synset_id"),
        F.element_at("fields", 2).alias("kind"),
        "fields",
    )


def _is(kind: str) -> Column:
    return (F.col("kind") == kind) | F.col("kind").endswith(":" + kind)


def lemma_rows(files: DataFrame) -> DataFrame:
    lemma = F.trim(F.element_at("fields", 3))
    return _rows(files).where(_is("lemma")).select("synset_offset", "pos", "synset_id", "lang", lemma.alias("lemma"))


def definition_rows(files: DataFrame) -> DataFrame:
    text = F.trim(F.element_at("fields", -1))
    return _rows(files).where(_is("def")).select("synset_offset", "pos", "synset_id", "lang", text.alias("def")).where(F.length("def") > 1)


def source_rows(files: DataFrame) -> DataFrame:
    """(lang, name, url, license, file) of the first remark line of each file, by language."""
    heads = tab_lines(files).where(F.col("line").startswith("#"))
    first = heads.withColumn("turn", F.row_number().over(Window.partitionBy("file").orderBy("line_no"))).where("turn = 1")
    parts = F.split(F.trim(F.col("line").substr(F.lit(2), F.length("line"))), "\t", -1)

    def part(k: int) -> Column:
        return F.nullif(F.trim(F.get(parts, F.lit(k))), F.lit(""))

    return first.select("lang", part(0).alias("name"), part(2).alias("url"), part(3).alias("license"), "file").orderBy("lang", "file")


def attribution(sources: DataFrame) -> DataFrame:
    """Lines of a markdown table of the sources."""
    cells = [F.coalesce(F.col(c), F.lit("")) for c in ("lang", "name", "license", "url")]
    body = sources.select(F.concat(F.lit("2:"), "lang").alias("rank"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = sources.sparkSession.createDataFrame([("0", "| Lang | Name | License | URL |"), ("1", "| --- | --- | --- | --- |")], "rank string, line string")
    return head.unionByName(body).orderBy("rank", "line").select("line")


def totals(lemmas: DataFrame, definitions: DataFrame, sources: DataFrame) -> DataFrame:
    named = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in (("lemmas", lemmas), ("definitions", definitions), ("sources", sources))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def tab_text(lang: str, lemmas, definitions, head: str = "") -> str:
    """A tab file of (synset_id, lemma) and (synset_id, definition) pairs of one language."""
    lines = [f"# {head}"] if head else []
    lines += [f"{i}\t{lang}:lemma\t{x}" for i, x in lemmas]
    lines += [f"{i}\t{lang}:def\t0\t{x}" for i, x in definitions]
    return "\n".join(lines) + "\n"


def _checked(spark: SparkSession, version: str) -> None:
    """Read every column of every table of a version; raises if that fails or there is no lemma."""
    for name, schema in TABLES.items():
        df = spark.read.schema(schema).parquet(f"{version}/{name}")
        n = df.agg(F.count("*"), F.max(F.xxhash64(*df.columns))).first()[0]
        if name == "lemmas" and not n:
            raise ValueError("the files hold no lemma")


def build(spark: SparkSession, folder: str, target: str) -> str:
    """Write lemmas, definitions and sources of a folder's tab files under target, and return the version's path.

    Tables go to a new version folder and are read back; only then one file that names the version is added under
    ``target/current``, by Spark's committer. Nothing that stands there is overwritten or deleted, so at every moment, and after a
    failure at any point, readers find the last version that was finished.
    """
    files = read_tab_files(spark, folder)
    version = f"{target}/{uuid.uuid4().hex}"
    lemma_rows(files).repartition("lang").sortWithinPartitions("synset_offset", "pos").write.partitionBy("lang").parquet(f"{version}/lemmas")
    definition_rows(files).repartition("lang").sortWithinPartitions("synset_offset", "pos").write.partitionBy("lang").parquet(f"{version}/definitions")
    source_rows(files).coalesce(1).write.parquet(f"{version}/sources")
    _checked(spark, version)
    spark.createDataFrame([(time.time_ns(), version)], "turn long, path string").coalesce(1).write.mode("append").parquet(f"{target}/current")
    return version


def current(spark: SparkSession, target: str) -> str:
    """Path of the newest finished version."""
    return spark.read.schema("turn long, path string").parquet(f"{target}/current").agg(F.max(F.struct("turn", "path"))).first()[0].path


def open_tables(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The tables of the current version, also as views of the same names."""
    version = current(spark, target)
    out = {name: spark.read.schema(schema).parquet(f"{version}/{name}") for name, schema in TABLES.items()}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def open_lexicon(spark: SparkSession, target: str, dictionary: str | None = None, stopwords: str | None = None, forms: DataFrame | None = None) -> Lexicon:
    """The lexicon that analyses read, from the current version of a built folder.

    dictionary: a folder of English dictionary files, which adds relations and verb frames; stopwords: a folder of word lists
    that add to the built-in ones; forms: (lang, form, lemma) for texts that are lemmatised.
    """
    tables = open_tables(spark, target)
    built_in = local(spark, stopword_rows(), "lang, word")
    if dictionary is None:
        relations = spark.createDataFrame([], "synset_offset string, pos string, relation string, to_offset string, to_pos string")
        frames = spark.createDataFrame([], "synset_offset string, pos string, frame string")
    else:
        relations, frames = wordnet_relations(spark, dictionary), wordnet_frames(spark, dictionary)
    return Lexicon(
        tables["lemmas"].select("synset_offset", "pos", "synset_id", "lang", "lemma"),
        tables["definitions"].select("synset_offset", "pos", "synset_id", "lang", "def"),
        relations,
        frames,
        built_in if stopwords is None else stopword_overlay(spark, stopwords, built_in),
        spark.createDataFrame([], "lang string, form string, lemma string") if forms is None else forms,
    )
