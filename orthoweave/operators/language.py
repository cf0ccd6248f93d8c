"""Language detection from stopword shares, as the built-in detector behind the detection report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import dealt, small
from ..functions.text import SUPPORTED, clean
from .tokens import NO_SPACE, term

#: Fixed values of the report: least confidence, least lead over the runner-up, words, sentences and words in a sentence.
LEAST, LEAD, LEAST_WORDS, SENTENCES, SENTENCE_WORDS = 0.02, 1.5, 4, 16, 6
#: Sums of shares are rounded to so many digits, so that their order can't decide a comparison.
DIGITS = 9


def detect(texts: DataFrame, stopwords: DataFrame) -> DataFrame:
    """(text_id, code, confidence, alternatives, words, mixed, uncertain) of texts with words; other texts give no row.

    A text's words are cut once, by sentence. Sums by sentence and language are what is shuffled; the rest is done on the few
    sentences and languages of each text, as arrays.
    """
    parts = dealt(texts.select("text_id", "text")).select("text_id", F.posexplode(F.split(clean(F.col("text")), r"(?<=[.!?])[ \t\n\x0B\f\r]+")).alias("part", "text"))
    # sentences beyond the first ones count for the text, not for a mixture of languages
    parts = parts.withColumn("part", F.least("part", F.lit(SENTENCES)))
    tokens = parts.select("text_id", "part", F.explode(F.regexp_extract_all("text", F.lit(f"({NO_SPACE})"), F.lit(1))).alias("token"))
    words = tokens.select("text_id", "part", term(F.col("token")).alias("term")).where("term <> ''")
    table = stopwords.select("lang", F.col("word").alias("term")).distinct().groupBy("term").agg(F.collect_set("lang").alias("langs"))
    spread = words.join(small(table), "term", "left").select("text_id", "part", F.size("langs").alias("n"), F.posexplode_outer("langs").alias("turn", "lang"))
    first = F.sum(F.when(F.coalesce("turn", F.lit(0)) == 0, 1).otherwise(0)).alias("words")
    sums = spread.groupBy("text_id", "part", "lang").agg(first, F.round(F.sum(F.when(F.col("lang").isNotNull(), 1 / F.col("n"))), DIGITS).alias("hits"))
    item = F.when(F.col("lang").isNotNull(), F.struct((-F.col("hits")).alias("less"), "lang"))
    by_part = sums.groupBy("text_id", "part").agg(F.sum("words").alias("words"), F.array_sort(F.collect_list(item)).alias("found"))
    best, second = F.get("found", F.lit(0)), F.get("found", F.lit(1))
    share, next_ = -best["less"] / F.col("words"), F.coalesce(-second["less"] / F.col("words"), F.lit(0.0))
    sure = (F.col("part") < SENTENCES) & (F.col("words") >= SENTENCE_WORDS) & (share >= LEAST) & (share >= next_ * LEAD)
    by_text = by_part.groupBy("text_id").agg(F.sum("words").cast("int").alias("words"), F.flatten(F.collect_list("found")).alias("all"), F.collect_set(F.when(sure, best["lang"])).alias("langs"))
    total = F.transform(
        F.array_distinct(F.transform("all", lambda x: x["lang"])),
        lambda c: F.struct(F.round(F.aggregate(F.filter("all", lambda x: x["lang"] == c), F.lit(0.0), lambda a, x: a + x["less"]), DIGITS).alias("less"), c.alias("lang")),
    )
    top = F.transform(F.slice(F.array_sort(total), 1, 3), lambda x: F.struct(x["lang"].alias("code"), (-x["less"] / F.col("words")).alias("confidence")))
    rows = by_text.withColumn("alternatives", F.when(F.size("all") > 0, top)).withColumn("mixed", F.size("langs") > 1)
    first_, runner = F.get("alternatives", F.lit(0)), F.get("alternatives", F.lit(1))
    confidence, runner_up = F.coalesce(first_["confidence"], F.lit(0.0)), F.coalesce(runner["confidence"], F.lit(0.0))
    close = (runner_up > 0) & (confidence < LEAD * runner_up)
    uncertain = F.col("mixed") | (F.col("words") < LEAST_WORDS) | (confidence < LEAST) | close | ~F.coalesce(first_["code"].isin(*SUPPORTED), F.lit(False))
    return rows.select("text_id", first_["code"].alias("code"), confidence.alias("confidence"), "alternatives", "words", "mixed", uncertain.alias("uncertain"))
