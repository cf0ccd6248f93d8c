"""Nominal units of texts, and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import dealt, small
from ..functions.text import ascii_lower, is_word, wordnet_pos
from .tokens import bare_tokens, eligible, lemmatised, tagged, term, tokens


def nouns(lemmas: DataFrame) -> DataFrame:
    return lemmas.where("pos = 'n'").select("lang", ascii_lower(F.col("lemma")).alias("lemma")).distinct()


def known_phrases(lemmas: DataFrame) -> DataFrame:
    return lemmas.select("lang", ascii_lower(F.col("lemma")).alias("lemma")).distinct()


def with_language(texts: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Texts whose language the lexicon holds."""
    return texts.join(small(lemmas.select("lang").distinct()), "lang", "left_semi")


#: A sentence's tokens as slices of 1..longest words, each with the place of its first word.
_SLICES = (
    "flatten(transform(sequence(1, {0}), n -> if(size(s) < n, array(), transform(sequence(1, size(s) - n + 1), k -> "
    "named_struct('idx', s[k - 1].idx, 'n', n, 'begin', s[k - 1].begin, 'end', s[k + n - 2].end, 'last', s[k + n - 2].idx, "
    "'lemma', array_join(transform(slice(s, k, n), x -> x.lemma), '_'), 'nominal', n = 1 and s[k - 1].nominal)))))"
)
#: From the left, the longest phrase at a place; words in it aren't units of their own.
_FOLD = (
    "aggregate(found, named_struct('at', -1, 'kept', slice(found, 1, 0)), (a, x) -> if(x.idx < a.at, a, "
    "named_struct('at', if(x.n > 1, x.idx + x.n, a.at), 'kept', array_append(a.kept, x))), a -> a.kept)"
)
_SENTENCE = ["text_id", "lang", "row", "sentence"]


def phrase_units(flagged: DataFrame, lemmas: DataFrame, longest: int) -> DataFrame:
    """(text_id, lang, row, sentence, context, units): phrases of the lexicon up to ``longest`` words and nominal tokens outside them.

    flagged: tokens with lemma, ``nominal`` (may be a unit by itself) and ``term`` (null if it is no context). A sentence's tokens
    become one array where they lie, its slices are looked up, and the hits fold back into units in the same partitioning.
    """
    item = F.struct("idx", "begin", "end", "lemma", "nominal")
    rows = flagged.groupBy(_SENTENCE).agg(F.collect_set("term").alias("context"), F.array_sort(F.collect_list(item)).alias("s"))
    spans = rows.select(*_SENTENCE, "context", F.explode(F.expr(_SLICES.format(longest))).alias("p")).select(*_SENTENCE, "context", "p.*")
    near = spans.where((F.col("last") == F.col("idx") + F.col("n") - 1) & (F.col("nominal") | (F.col("n") > 1)))
    table = small(known_phrases(lemmas).withColumn("known", F.lit(True)))
    hits = near.join(table, ["lang", "lemma"], "left").where(F.col("nominal") | F.col("known"))
    unit = F.struct("idx", (-F.col("n")).alias("less"), "n", "begin", "end", "lemma")
    found = hits.groupBy(_SENTENCE).agg(F.first("context").alias("context"), F.array_sort(F.collect_list(unit)).alias("found"))
    return found.select(*_SENTENCE, "context", F.expr(_FOLD).alias("units"))


def phrases(placed: DataFrame, lemmas: DataFrame, longest: int = 3) -> DataFrame:
    """Phrases that the lexicon holds; of overlapping ones the first, and the longest at one place."""
    found = phrase_units(placed.withColumns({"nominal": F.lit(False), "term": F.lit(None).cast("string")}), lemmas, longest)
    return found.select(*_SENTENCE, F.explode("units").alias("x")).select(*_SENTENCE, "x.idx", "x.n", "x.begin", "x.end", "x.lemma")


def collapsed(placed: DataFrame, lemmas: DataFrame, longest: int = 3) -> DataFrame:
    """(text_id, lang, row, sentence, lemmas): each sentence's lemmas in order, phrases of the lexicon as one item."""
    every = placed.withColumns({"nominal": F.lit(True), "term": F.lit(None).cast("string")})
    return phrase_units(every, lemmas, longest).select(*_SENTENCE, F.transform("units", lambda x: x["lemma"]).alias("lemmas"))


def flagged_tokens(texts: DataFrame, lemmas: DataFrame, stopwords: DataFrame, forms: DataFrame | None = None, tags: DataFrame | None = None, mode: str = "whitespace") -> DataFrame:
    """Tokens with lemma, eligible, nominal and term; every lookup is a broadcast of a checked size or a join, no token is dropped."""
    rows = tagged(lemmatised(tokens(texts, mode), forms), tags).withColumns({"_low": F.lower("token"), "term": term(F.col("token"))})
    for column, mark in (("_low", "_a"), ("lemma", "_b"), ("term", "_c")):
        words = small(stopwords.select("lang", F.col("word").alias(column), F.lit(True).alias(mark)).distinct())
        rows = rows.join(words, ["lang", column], "left")
    rows = rows.join(small(nouns(lemmas).withColumn("_noun", F.lit(True))), ["lang", "lemma"], "left")
    ok = is_word(F.col("token")) & F.col("_a").isNull() & F.col("_b").isNull()
    noun = F.col("_noun").isNotNull() | F.coalesce(wordnet_pos(F.col("tag")) == "n", F.lit(False))
    context = F.when(ok & (F.col("term") != "") & F.col("_c").isNull(), F.col("term"))
    return rows.withColumns({"eligible": ok, "nominal": ok & noun, "term": context}).drop("_low", "_a", "_b", "_c", "_noun")


def nominal_tokens(rows: DataFrame, lemmas: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Eligible tokens that the lexicon knows as nouns, or that are tagged as nouns if rows have ``tag``."""
    kept = eligible(rows, stopwords)
    table = small(nouns(lemmas))
    if "tag" not in rows.columns:
        return kept.join(table, ["lang", "lemma"], "left_semi")
    marked = kept.join(table.withColumn("_noun", F.lit(True)), ["lang", "lemma"], "left")
    return marked.where(F.col("_noun") | (wordnet_pos(F.col("tag")) == "n")).drop("_noun")


def units(texts: DataFrame, lemmas: DataFrame, stopwords: DataFrame, forms: DataFrame | None = None, longest_phrase: int = 1, tags: DataFrame | None = None) -> DataFrame:
    """(text_id, lang, row, sentence, unit_type, lemma, begin, end, n_words): nominal units with offsets.

    Phrases are looked for only if longest_phrase is over 1; their tokens aren't units of their own. tags: a table as
    :func:`tokens.tagged` takes it; words tagged as nouns are units even where the lexicon doesn't know them.
    """
    texts = dealt(texts)
    columns = [*_SENTENCE, "unit_type", "lemma", "begin", "end", "n_words"]
    if longest_phrase < 2:
        placed = lemmatised(tokens(texts), forms)
        single = nominal_tokens(placed if tags is None else tagged(placed, tags), lemmas, stopwords)
        return single.withColumns({"unit_type": F.lit("NOMINAL_TOKEN"), "n_words": F.lit(1)}).select(columns)
    found = phrase_units(flagged_tokens(texts, lemmas, stopwords, forms, tags), lemmas, longest_phrase)
    each = found.select(*_SENTENCE, F.explode("units").alias("u")).select(*_SENTENCE, "u.*")
    return each.withColumns({"unit_type": F.when(F.col("n") > 1, "NOMINAL_MWE").otherwise("NOMINAL_TOKEN"), "n_words": F.col("n")}).select(columns)


def coverage(texts: DataFrame, lemmas: DataFrame, stopwords: DataFrame, forms: DataFrame | None = None, longest_phrase: int = 1, tags: DataFrame | None = None) -> DataFrame:
    """(text_id, lang, total_words, considered_words, n_units, coverage) of every text.

    Without phrases only counts matter, so tokens need no order: the noun lookup is a left join on distinct nouns, and one
    pass gives both counts. A phrase counts with all its words.
    """
    if longest_phrase > 1:
        rows = flagged_tokens(dealt(texts), lemmas, stopwords, forms, tags)
        words = rows.groupBy("text_id").agg(F.count_if("eligible").alias("total_words"))
        found = phrase_units(rows, lemmas, longest_phrase).select("text_id", F.explode("units").alias("u"))
        counts = words.join(found.groupBy("text_id").agg(F.sum("u.n").alias("considered_words"), F.count("*").alias("n_units")), "text_id", "left")
    else:
        rows = lemmatised(bare_tokens(dealt(texts)), forms)
        kept = eligible(rows if tags is None else tagged(rows, tags), stopwords)
        marked = kept.join(small(nouns(lemmas).withColumn("noun", F.lit(1))), ["lang", "lemma"], "left")
        if tags is not None:
            marked = marked.withColumn("noun", F.coalesce("noun", F.when(wordnet_pos(F.col("tag")) == "n", 1)))
        used = F.sum(F.coalesce("noun", F.lit(0)))
        counts = marked.groupBy("text_id").agg(F.count("*").alias("total_words"), used.alias("considered_words"), used.alias("n_units"))
    joined = texts.select("text_id", "lang").join(counts, "text_id", "left").na.fill(0, ["total_words", "considered_words", "n_units"])
    share = F.when(F.col("total_words") > 0, F.col("considered_words") / F.col("total_words")).otherwise(0.0)
    return joined.withColumn("coverage", share)
