"""Whole analyses over many texts at once, keyed by text_id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.joins import dealt, small
from ..functions.text import bar, clip, is_supported, is_word, label, wordnet_pos
from ..operators import graph as graphs
from ..operators import language
from ..operators.senses import Scorer, candidates, english_candidates, gloss_terms, overlap_scorer, phrase_in_text, scored, selected, with_missing
from ..operators.tokens import NO_SPACE, SPACE, eligible, lemmatised, sentence_pieces, sentence_strings, tagged, term, tokens
from ..operators.translations import best_per_language, explorer, grouped, other_languages, ranked, scored_translations
from ..operators.units import coverage, flagged_tokens, known_phrases, nouns, phrase_units, with_language
from ..sources.fixtures import Lexicon


@dataclass(frozen=True)
class Choice:
    """Threshold and margin that a sense must reach."""

    threshold: float = 1.0
    margin: float = 0.25


def supported_texts(texts: DataFrame, german: bool = False) -> DataFrame:
    """Texts in a language that can be analysed; German is a comparison language only, unless asked for."""
    ok = is_supported(F.col("lang"))
    return texts.where(ok | (F.col("lang") == "deu") if german else ok)


#: A sentence; texts that share a text_id have rows of their own.
_SENTENCE = ["text_id", "lang", "row", "sentence"]


def sentence_units(texts: DataFrame, lex: Lexicon, longest_phrase: int = 1, tags: DataFrame | None = None, arrow: bool = False) -> DataFrame:
    """(text_id, lang, row, sentence, context, units): one row per sentence with a nominal unit.

    context holds the sentence's distinct terms, units its occurrences (lemma, begin, end). Tokens are placed in their row and
    gathered by sentence where they lie, so the one shuffle carries sentences with a unit only. Built-in functions cut the texts, so that
    an executor holds no Python workers; with ``arrow`` workers do, in less time.
    """
    texts = dealt(texts)
    if longest_phrase > 1 or tags is not None:
        found = phrase_units(flagged_tokens(texts, lex.lemmas, lex.stopwords, tags=tags), lex.lemmas, longest_phrase)
        return found.withColumn("units", F.transform("units", lambda u: F.struct(u["lemma"].alias("lemma"), u["begin"].alias("begin"), u["end"].alias("end"))))
    # a piece of a sentence goes along with each of its units; those of one piece that have none are dropped before anything is gathered
    first = ~F.col("whole") & (F.col("at") == 0)
    if arrow:
        joined = F.array_join(F.transform("tokens", lambda t: t["token"]), " ").alias("piece")
        each = sentence_pieces(texts).select(*_SENTENCE, "whole", joined, F.posexplode("tokens").alias("at", "t")).select(*_SENTENCE, "whole", "piece", "at", "t.*")
        begin, end = F.col("begin"), F.col("end")
    else:
        each = sentence_strings(texts).select(*_SENTENCE, "whole", "begin", "piece", F.posexplode(F.regexp_extract_all("piece", F.lit(NO_SPACE), F.lit(0))).alias("at", "token"))
        # only a unit's place is looked for: what stands before it in its piece
        runs = F.regexp_extract_all("piece", F.lit(f"{SPACE}|{NO_SPACE}"), F.lit(0))
        upto = F.slice(runs, 1, 2 * F.col("at") + F.when(F.rlike("piece", F.lit(rf"\A{SPACE}")), 1).otherwise(0))
        begin = F.aggregate(upto, F.col("begin"), lambda a, x: a + F.length(x))
        end = begin + F.length("token")
    each = each.withColumn("lemma", F.lower("token"))
    near = each.join(small(nouns(lex.lemmas).withColumn("noun", F.lit(1))), ["lang", "lemma"], "left").where((F.col("noun") == 1) | first)
    stop = small(lex.stopwords.select("lang", F.col("word").alias("lemma"), F.lit(1).alias("stop")).distinct())
    is_unit = (F.col("noun") == 1) & F.col("stop").isNull() & is_word(F.col("token"))
    marked = near.join(stop, ["lang", "lemma"], "left").withColumn("unit", F.when(is_unit, F.struct("lemma", begin.alias("begin"), end.alias("end")))).where(is_unit | first)
    found = marked.groupBy(_SENTENCE).agg(F.array_join(F.collect_set("piece"), " ").alias("string"), F.collect_list("unit").alias("units")).where(F.size("units") > 0)
    lists = small(lex.stopwords.groupBy("lang").agg(F.collect_set("word").alias("stops")))
    words = found.join(lists, "lang", "left").withColumn("stops", F.coalesce("stops", F.array().cast("array<string>")))
    kept = F.filter(F.regexp_extract_all("string", F.lit(NO_SPACE), F.lit(0)), lambda t: is_word(t) & ~F.array_contains("stops", F.lower(t)))
    terms = F.transform(kept, term)
    return words.select(*_SENTENCE, F.array_except(terms, F.array_append("stops", F.lit(""))).alias("context"), "units")


def _candidates(lex: Lexicon, longest_phrase: int = 1) -> DataFrame:
    """Noun senses of the lexicon's nouns; of its phrases too, which are units whatever their part of speech, if these are looked for."""
    words = nouns(lex.lemmas) if longest_phrase < 2 else known_phrases(lex.lemmas)
    return candidates(words, lex.lemmas, lex.definitions, "n")


def chosen_senses(sentences: DataFrame, lex: Lexicon, choice: Choice = Choice(), scorer: Scorer = overlap_scorer, longest_phrase: int = 1) -> DataFrame:
    """(text_id, lang, sentence, lemma, times, synset_offset, pos): units by sentence and lemma with their sense, null if none.

    With the standard scorer a lemma's candidates come as one array from the lexicon, so scoring and choosing need no
    shuffle; any other one gets a row for each candidate.
    """
    rows = sentences.select("text_id", "lang", "row", "context", F.explode("units.lemma").alias("lemma"), "sentence")
    counted = rows.groupBy(*_SENTENCE, "lemma").agg(F.first("context").alias("context"), F.count("*").alias("times"))
    table = _candidates(lex, longest_phrase)
    if scorer is not overlap_scorer:
        keys = [*_SENTENCE, "lemma"]
        ranked_ = with_missing(selected(scorer(counted.join(small(table), ["lang", "lemma"], "left")), keys, choice.threshold, choice.margin), keys)
        pick = F.max(F.when(F.col("selected"), F.struct("synset_offset", "pos")))
        each = ranked_.groupBy(keys).agg(F.first("times").alias("times"), pick.alias("p"))
        return each.select("text_id", "lang", "sentence", "lemma", "times", "p.synset_offset", "p.pos")
    listed = table.withColumn("terms", gloss_terms(F.col("gloss"))).groupBy("lang", "lemma").agg(F.collect_list(F.struct("synset_offset", "pos", "gloss", "terms")).alias("senses"))
    joined = counted.join(small(listed), ["lang", "lemma"], "left")
    other = F.array_remove("context", F.col("lemma"))
    order = F.array_sort(F.transform("senses", lambda s: F.struct((-F.size(F.array_intersect(other, s["terms"]))).alias("less"), s["synset_offset"].alias("o"), s["pos"].alias("p"))))
    best, second = F.get("order", F.lit(0)), F.get("order", F.lit(1))
    lead = second.isNull() | ((second["less"] > best["less"]) & (second["less"] - best["less"] >= choice.margin))
    good = (-best["less"] >= choice.threshold) & lead & ~F.exists("senses", lambda s: F.trim(s["gloss"]) == "")
    ok = F.coalesce(good, F.lit(False))
    return joined.withColumn("order", order).select(
        "text_id", "lang", "sentence", "lemma", "times", F.when(ok, best["o"]).alias("synset_offset"), F.when(ok, best["p"]).alias("pos")
    )


def analysed_units(texts: DataFrame, lex: Lexicon, choice: Choice = Choice(), scorer: Scorer = overlap_scorer, longest_phrase: int = 1) -> DataFrame:
    """(text_id, n_units, analysed_units): units of each text that has any, and those with a selected sense."""
    senses = chosen_senses(sentence_units(with_language(texts, lex.lemmas), lex, longest_phrase), lex, choice, scorer, longest_phrase)
    known = F.when(F.col("synset_offset").isNotNull(), F.col("times"))
    return senses.groupBy("text_id").agg(F.sum("times").alias("n_units"), F.coalesce(F.sum(known), F.lit(0)).alias("analysed_units"))


def text_transparency(texts: DataFrame, lex: Lexicon, choice: Choice = Choice(), scorer: Scorer = overlap_scorer, longest_phrase: int = 1) -> DataFrame:
    """(text_id, target_lang, score, n_units, analysed_units, rank): mean over all units of the best score in each language.

    Best scores are a table of the lexicon's own (lemma, sense, language) triples, computed once. Rows of one text_id are one text.
    """
    senses = chosen_senses(sentence_units(with_language(texts, lex.lemmas), lex, longest_phrase), lex, choice, scorer, longest_phrase)
    best = best_per_language(scored_translations(_candidates(lex, longest_phrase), lex.lemmas)).where("target_lang is not null")
    per_lang = best.groupBy("lemma", "synset_offset", "pos").agg(F.collect_list(F.struct("target_lang", "score")).alias("best"))
    known = F.when(F.col("synset_offset").isNotNull(), F.col("times"))
    per_text = senses.groupBy("text_id").agg(
        F.sum("times").alias("n_units"), F.coalesce(F.sum(known), F.lit(0)).alias("analysed_units"), F.collect_list(F.struct("lemma", "synset_offset", "pos", "times")).alias("units")
    )
    rows = per_text.select("text_id", "n_units", "analysed_units", F.explode("units").alias("u")).select("text_id", "n_units", "analysed_units", "u.*")
    joined = rows.join(small(per_lang), ["lemma", "synset_offset", "pos"]).select("text_id", "n_units", "analysed_units", "times", F.explode("best").alias("b"))
    totals = joined.groupBy("text_id", "n_units", "analysed_units", F.col("b.target_lang").alias("target_lang")).agg(F.sum(F.col("b.score") * F.col("times")).alias("total"))
    out = totals.select("text_id", "target_lang", (F.col("total") / F.col("n_units")).alias("score"), "n_units", "analysed_units")
    return ranked(out, ["text_id"])


def comparisons(texts: DataFrame, lex: Lexicon, choice: Choice = Choice(), scorer: Scorer = overlap_scorer, longest_phrase: int = 1) -> DataFrame:
    """Every candidate of every unit occurrence: (text_id, lang, sentence, lemma, begin, end, synset_offset, pos, gloss, score, selected)."""
    sentences = sentence_units(with_language(texts, lex.lemmas), lex, longest_phrase)
    rows = sentences.select(*_SENTENCE, "context", F.explode("units").alias("u"))
    # a lemma's places in a sentence share its score; all of this stays in the sentences' partitioning
    keys = [*_SENTENCE, "lemma"]
    lemmas = rows.groupBy(*_SENTENCE, F.col("u.lemma").alias("lemma")).agg(F.first("context").alias("context"), F.collect_list("u").alias("places"))
    scored_ = scorer(lemmas.join(small(_candidates(lex, longest_phrase)), ["lang", "lemma"])).drop("context")
    judged = with_missing(selected(scored_, keys, choice.threshold, choice.margin), keys)
    return judged.withColumn("place", F.explode("places")).select(
        "text_id", "lang", "sentence", "lemma", F.col("place.begin").alias("begin"), F.col("place.end").alias("end"), "synset_offset", "pos", "gloss", "score", "selected"
    )


def details(texts: DataFrame, lex: Lexicon, choice: Choice = Choice(), scorer: Scorer = overlap_scorer, longest_phrase: int = 1) -> DataFrame:
    """Words of each selected sense in other languages, for every unit occurrence."""
    chosen = comparisons(texts, lex, choice, scorer, longest_phrase).where("selected").select("text_id", "lang", "lemma", "begin", "end", "synset_offset", "pos")
    rows = chosen.join(small(scored_translations(_candidates(lex, longest_phrase), lex.lemmas)), ["lemma", "synset_offset", "pos"])
    return other_languages(rows)


def placed_details(rows: DataFrame) -> DataFrame:
    """details with ``place``, their place in a text's report: by unit, language, score, word and where the unit stands."""
    order = Window.partitionBy("text_id").orderBy("lemma", "target_lang", F.desc("score"), "target", "begin", "synset_offset", "pos")
    return rows.withColumn("place", F.row_number().over(order))


def placed_comparisons(rows: DataFrame) -> DataFrame:
    """comparisons with ``place``: by unit, where it stands, the selected sense first, then score and sense."""
    order = Window.partitionBy("text_id").orderBy("lemma", "begin", F.desc("selected"), F.desc("score"), "synset_offset", "pos")
    return rows.withColumn("place", F.row_number().over(order))


def word_in_context(texts: DataFrame, phrase: str, lex: Lexicon, choice: Choice = Choice(), scorer: Scorer = overlap_scorer) -> DataFrame:
    """Words of the phrase's sense in other languages where it stands once in a text; scores compare its surface."""
    found = phrase_in_text(with_language(texts, lex.lemmas), phrase, lex.forms).where("matches = 1")
    # text_id names the text here: the sentences come from another pass over the tokens, whose rows needn't be numbered alike
    sentences = sentence_units(texts, lex).select("text_id", "sentence", "context")
    table = candidates(found.select("lang", "lemma"), lex.lemmas, lex.definitions, "n" if " " in phrase else None)
    keys = ["text_id", "sentence", "lemma"]
    judged = with_missing(selected(scored(found, sentences, table, scorer), keys, choice.threshold, choice.margin), keys).where("selected")
    surfaces = judged.withColumn("surface", F.lit(phrase))
    words = scored_translations(surfaces, lex.lemmas, "surface")
    return surfaces.select("text_id", "lang", "synset_offset", "pos", "surface").join(small(words), ["surface", "synset_offset", "pos"]).select("text_id", "lang", "synset_offset", "pos", "target_lang", "target", "score")


def english_senses(texts: DataFrame, lex: Lexicon, choice: Choice = Choice(), scorer: Scorer = overlap_scorer, tags: DataFrame | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """(text_id, row, sentence, lemma, tag, synset_offset, pos, gloss, score, selected): senses of the content words of English texts.

    Candidates come by form and stems, restricted by the words' tags; the scorer and the choice are those of other analyses.
    """
    rows = tagged(lemmatised(tokens(texts.where("lang = 'eng'"))), tags)
    kept = eligible(rows, lex.stopwords).withColumn("term", term(F.col("token")))
    sentences = kept.groupBy(_SENTENCE).agg(F.collect_set(F.when(F.col("term") != "", F.col("term"))).alias("context"), F.collect_set(F.struct("lemma", "tag")).alias("words"))
    words = sentences.select(*_SENTENCE, "context", F.explode("words").alias("w")).select(*_SENTENCE, "context", "w.*")
    # the table is made of the lexicon's own words and the corpus's distinct ones
    distinct = words.select("lang", "lemma", "tag").distinct()
    by_tag = english_candidates(distinct, lex.lemmas, lex.definitions, exceptions)
    ok = F.col("tag").isNull() | (wordnet_pos(F.col("tag")) == F.col("pos"))
    found = words.join(small(by_tag), ["lang", "lemma"]).where(ok)
    keys = [*_SENTENCE, "lemma", "tag"]
    return with_missing(selected(scorer(found), keys, choice.threshold, choice.margin), keys).select("text_id", "row", "sentence", "lemma", "tag", "synset_offset", "pos", "gloss", "score", "selected")


def english_transparency(texts: DataFrame, lex: Lexicon, choice: Choice = Choice(), scorer: Scorer = overlap_scorer, tags: DataFrame | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """(text_id, lemma, synset_offset, pos, target_lang, target, score) of the selected senses of English words."""
    chosen = english_senses(texts, lex, choice, scorer, tags, exceptions).where("selected").select("text_id", "lemma", "synset_offset", "pos").distinct()
    lemmas = lex.lemmas.withColumn("pos", F.when(F.col("pos") == "s", "a").otherwise(F.col("pos")))
    return chosen.join(scored_translations(chosen, lemmas), ["lemma", "synset_offset", "pos"])


def explored(word: str, lang: str, lex: Lexicon) -> DataFrame:
    """Words of every sense of one word, grouped by language."""
    senses = explorer(word, lang, lex.lemmas, lex.definitions).withColumn("lemma", F.lit(word))
    return grouped(scored_translations(senses, lex.lemmas), ["synset_offset", "pos"])


def text_graph(texts: DataFrame, lex: Lexicon, choice: Choice = Choice(), scorer: Scorer = overlap_scorer, longest_phrase: int = 1) -> tuple[DataFrame, DataFrame]:
    rows = details(texts, lex, choice, scorer, longest_phrase).select("text_id", "lang", F.col("lemma").alias("unit"), F.col("begin").alias("place"), "target_lang", "target", "score")
    return graphs.graph(rows, lex.stopwords)


def contrast(
    texts: DataFrame, lex: Lexicon, word: str | None = None, choice: Choice = Choice(), detect: bool = False, scorer: Scorer = overlap_scorer, longest_phrase: int = 1
) -> dict[str, DataFrame]:
    """The frames of one analysis: coverage always, and a word's or the whole texts' comparison.

    ``languages`` holds for each text the mode, its language, the confidence (1 where the language is given) and an error: no
    words, or a language that can't be analysed; texts with an error are in no other frame.
    """
    confidence = F.lit(1.0)
    if detect:
        found = language.detect(texts, lex.stopwords).select("text_id", F.col("code").alias("lang"), "confidence", "uncertain")
        texts = texts.drop("lang").join(found, "text_id", "left")
        confidence = F.col("confidence")
    mode = "CHOSEN_WORD" if word is not None else "NOMINAL_AGGREGATE_SUM"
    error = F.when(~F.coalesce(is_word(F.col("text")), F.lit(False)), "no words").when(~F.coalesce(is_supported(F.col("lang")), F.lit(False)), "unsupported language")
    listed = texts.select("text_id", F.lit(mode).alias("mode"), label(F.col("lang")).alias("language"), confidence.alias("confidence"), error.alias("error"))
    good = supported_texts(texts.where(is_word(F.col("text")))).select("text_id", "text", "lang")
    out = {"languages": listed, "coverage": coverage(good, lex.lemmas, lex.stopwords, longest_phrase=longest_phrase)}
    if word is not None:
        return out | {"results": word_in_context(good, word, lex, choice, scorer)}
    nodes, links = text_graph(good, lex, choice, scorer, longest_phrase)
    return out | {
        "results": text_transparency(good, lex, choice, scorer, longest_phrase),
        "analysed": analysed_units(good, lex, choice, scorer, longest_phrase),
        "details": placed_details(details(good, lex, choice, scorer, longest_phrase)),
        "comparisons": placed_comparisons(comparisons(good, lex, choice, scorer, longest_phrase)),
        "nodes": nodes,
        "links": links,
    }


def report(found: dict[str, DataFrame], top: int = 12, width: int = 60) -> DataFrame:
    """(text_id, place, line): a text's ranking as lines with bars, the first ``top`` languages, clipped to a width."""
    rows = found["results"]
    order = Window.partitionBy("text_id").orderBy(F.desc("score"), "target_lang", *(["target"] if "target" in rows.columns else []))
    words = [F.col("target")] if "target" in rows.columns else []
    line = F.concat_ws(" ", F.rpad(label(F.col("target_lang")), 18, " "), bar(F.col("score")), F.format_string("%.3f", F.col("score")), *words)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("text_id", "place", clip(line, width).alias("line"))
