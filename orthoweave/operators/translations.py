"""Words of the same sense in other languages and how close they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.joins import small
from ..functions.text import normal_code, transparency


def scored_translations(pairs: DataFrame, lemmas: DataFrame, form: str = "lemma") -> DataFrame:
    """Distinct (form, synset_offset, pos) with every lexicon word of the synset: lang, target, score; repeats are kept.

    The score depends on the two forms alone, so it is computed on distinct pairs.
    """
    words = small(lemmas.select("synset_offset", "pos", F.col("lang").alias("target_lang"), F.col("lemma").alias("target")))
    distinct = pairs.select(form, "synset_offset", "pos").distinct()
    return distinct.join(words, ["synset_offset", "pos"]).withColumn("score", transparency(F.col(form), F.col("target")))


def best_per_language(translations: DataFrame, form: str = "lemma") -> DataFrame:
    return translations.groupBy(form, "synset_offset", "pos", "target_lang").agg(F.max("score").alias("score"))


def profiles(units: DataFrame, chosen: DataFrame, best: DataFrame) -> DataFrame:
    """(text_id, target_lang, score): summed best scores over all units of the text, the unresolved ones being zero.

    units: (text_id, sentence, lemma) occurrences; chosen: their selected sense by text, sentence and lemma.
    """
    counts = units.groupBy("text_id", "sentence", "lemma").agg(F.count("*").alias("times"))
    n = counts.groupBy("text_id").agg(F.sum("times").alias("n_units"))
    used = counts.join(chosen.select("text_id", "sentence", "lemma", "synset_offset", "pos"), ["text_id", "sentence", "lemma"])
    summed = used.join(small(best), ["lemma", "synset_offset", "pos"]).groupBy("text_id", "target_lang").agg(F.sum(F.col("score") * F.col("times")).alias("total"))
    return summed.join(n, "text_id").select("text_id", "target_lang", (F.col("total") / F.col("n_units")).alias("score"), "n_units")


def ranked(rows: DataFrame, keys: list[str], top: int | None = None) -> DataFrame:
    """rows with ``rank`` by score, then language; the first ``top`` if given."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "target_lang")
    out = rows.withColumn("rank", F.row_number().over(order))
    return out if top is None else out.where(F.col("rank") <= top)


def explorer(word: str, lang: str, lemmas: DataFrame, definitions: DataFrame) -> DataFrame:
    """Senses of one word: (synset_offset, pos, gloss), a row for each definition, the gloss empty without one."""
    probe = word.lower().replace("_", " ")
    own = lemmas.where((F.col("lang") == lang) & (F.translate(F.translate("lemma", "_", " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") == probe))
    defs = definitions.where(F.col("lang") == lang).select("synset_offset", "pos", F.col("def").alias("gloss"))
    return own.select("synset_offset", "pos").join(defs, ["synset_offset", "pos"], "left").withColumn("gloss", F.coalesce("gloss", F.lit("")))


def grouped(translations: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct words of each language in order of score, as one text."""
    best = translations.groupBy(*keys, "target_lang", "target").agg(F.max("score").alias("score"))
    item = F.struct((-F.col("score")).alias("less"), F.col("target"))
    return best.groupBy(*keys, "target_lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["target"]), ", ").alias("words"), F.max("score").alias("score"))


def at_synset(lemmas: DataFrame, offset: str, pos: str, lang: str) -> DataFrame:
    return lemmas.where((F.col("synset_offset") == offset) & (F.col("pos") == pos) & (F.col("lang") == lang)).select("lemma")


def other_languages(rows: DataFrame, source: str = "lang") -> DataFrame:
    """Rows in another language than the text's, with finite scores from 0 to 1."""
    return rows.where((normal_code(F.col("target_lang")) != normal_code(F.col(source))) & F.col("score").between(0.0, 1.0) & ~F.isnan("score"))
