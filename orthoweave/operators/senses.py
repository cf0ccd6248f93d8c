"""Candidate senses of lemmas, their scores in context, and the choice among them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.joins import dealt, small
from ..functions.text import ascii_lower, is_word, wordnet_pos
from .tokens import bare_tokens, eligible, lemmatised, sentence_pieces, tagged, term, tokens

#: Thresholds and margins of the model scorers. Fixed values.
ENGLISH_THRESHOLD, ENGLISH_MARGIN = 2.5, 0.25
OTHER_THRESHOLD, OTHER_MARGIN = 0.65, 0.001

#: A scorer adds ``score`` to rows with context (array of terms or text), lemma and gloss.
Scorer = Callable[[DataFrame], DataFrame]


def glosses(definitions: DataFrame) -> DataFrame:
    """(synset_offset, pos, lang, def): the least definition of each synset and language."""
    return definitions.groupBy("synset_offset", "pos", "lang").agg(F.min("def").alias("def"))


def candidates(words: DataFrame, lemmas: DataFrame, definitions: DataFrame, pos: str | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """(lang, lemma, synset_offset, pos, gloss) of distinct (lang, lemma) words.

    The gloss is the English definition, else the one in the words' language, else empty. English words are looked up
    in the same tables. dictionary: (synset_offset, pos, def) rows of the English dictionary, whose gloss takes the place of a blank one of
    words in other languages.
    """
    probe = F.lower(F.translate("lemma", "_", " "))
    stored = lemmas if pos is None else lemmas.where(F.col("pos") == pos)
    stored = stored.select("lang", ascii_lower(F.translate("lemma", "_", " ")).alias("probe"), "synset_offset", "pos").distinct()
    found = words.select("lang", "lemma").distinct().withColumn("probe", probe).join(small(stored), ["lang", "probe"])
    least = glosses(definitions)
    english = small(least.where("lang = 'eng'").select("synset_offset", "pos", F.col("def").alias("eng_def")))
    own = small(least.select("synset_offset", "pos", "lang", F.col("def").alias("own_def")))
    joined = found.join(english, ["synset_offset", "pos"], "left").join(own, ["synset_offset", "pos", "lang"], "left")
    gloss = F.coalesce("eng_def", "own_def", F.lit(""))
    if dictionary is not None:
        table = dictionary.groupBy("synset_offset", F.when(F.col("pos") == "s", "a").otherwise(F.col("pos")).alias("_pos")).agg(F.min("def").alias("_dict"))
        joined = joined.withColumn("_pos", F.when(F.col("pos") == "s", "a").otherwise(F.col("pos"))).join(small(table), ["synset_offset", "_pos"], "left")
        gloss = F.when((F.trim(gloss) == "") & (F.col("lang") != "eng"), F.coalesce("_dict", gloss)).otherwise(gloss)
    return joined.select("lang", "lemma", "synset_offset", "pos", gloss.alias("gloss"))


#: Endings and what takes their place when an English form is brought to its base, by part of speech. Fixed values.
ENDINGS = {
    "n": (("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")),
    "v": (("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")),
    "a": (("er", ""), ("est", ""), ("er", "e"), ("est", "e")),
    "r": (),
}


def stemmed(words: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(…, lemma, probe, pos): a word as it is and its possible bases, for each part of speech, distinct.

    exceptions: (pos, form, base) of irregular forms; a form that stands there takes its bases from there alone.
    """
    form = F.lower(F.translate("lemma", "_", " "))
    bases = F.array(*[
        F.struct(F.lit(pos).alias("pos"), F.when(form.endswith(end) & (F.length(form) > len(end)), F.concat(form.substr(F.lit(1), F.length(form) - len(end)), F.lit(new))).alias("probe"))
        for pos, pairs in ENDINGS.items()
        for end, new in pairs
    ])
    whole = F.array(*[F.struct(F.lit(pos).alias("pos"), form.alias("probe")) for pos in ENDINGS])
    rows = words.select("*", F.explode(F.concat(whole, F.filter(bases, lambda x: x["probe"].isNotNull()))).alias("x")).select(*words.columns, "x.pos", "x.probe", (F.col("x.probe") == form).alias("_own"))
    if exceptions is not None:
        known = small(exceptions.select("pos", F.col("form").alias("_form"), F.col("base").alias("_base")).distinct())
        rows = rows.withColumn("_form", form).join(known, ["pos", "_form"], "left")
        rows = rows.where("_own or _base is null").unionByName(rows.where("_own and _base is not null").withColumn("probe", F.col("_base"))).drop("_form", "_base")
    return rows.drop("_own").distinct()


def english_candidates(words: DataFrame, lemmas: DataFrame, definitions: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(lang, lemma, synset_offset, pos, gloss) of distinct English (lemma, tag) words, looked up by the form and its stems.

    A tag's part of speech restricts the senses; a null one allows all four, while a tag without a part of speech gives none. A
    sense that several stems lead to comes once; satellite adjectives count as adjectives.
    """
    rows = words.where("lang = 'eng'")
    tag = F.col("tag") if "tag" in words.columns else F.lit(None).cast("string")
    given = rows.select("lang", "lemma", tag.alias("tag")).distinct()
    probes = stemmed(given, exceptions).where(F.col("tag").isNull() | (wordnet_pos(F.col("tag")) == F.col("pos"))).drop("tag").distinct()
    stored = lemmas.where("lang = 'eng'").select(ascii_lower(F.translate("lemma", "_", " ")).alias("probe"), F.when(F.col("pos") == "s", "a").otherwise(F.col("pos")).alias("pos"), "synset_offset").distinct()
    found = probes.join(small(stored), ["probe", "pos"]).select("lang", "lemma", "synset_offset", "pos").distinct()
    return found.join(small(english_glosses(definitions)), ["synset_offset", "pos"], "left").select("lang", "lemma", "synset_offset", "pos", F.coalesce("gloss", F.lit("")).alias("gloss"))


def english_glosses(definitions: DataFrame) -> DataFrame:
    """(synset_offset, pos, gloss) in English, of offsets of eight digits only; satellite adjectives count as adjectives."""
    own = definitions.where((F.col("lang") == "eng") & F.col("synset_offset").rlike(r"^[0-9]{8}\z"))
    return own.groupBy("synset_offset", F.when(F.col("pos") == "s", "a").otherwise(F.col("pos")).alias("pos")).agg(F.min("def").alias("gloss"))


def gloss_terms(gloss: Column) -> Column:
    """Distinct lower-cased words of letters in a gloss, as an array."""
    return F.array_distinct(F.regexp_extract_all(F.lower(gloss), F.lit(r"(\p{L}+)"), F.lit(1)))


def sentence_terms(texts: DataFrame, stopwords: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """(text_id, row, sentence, context): distinct terms of each sentence that aren't stopwords, as an array."""
    rows = eligible(lemmatised(tokens(texts), forms), stopwords).withColumn("term", term(F.col("token")))
    words = small(stopwords.select("lang", F.col("word").alias("term")).distinct())
    kept = rows.where("term <> ''").join(words, ["lang", "term"], "left_anti")
    return kept.groupBy("text_id", "row", "sentence").agg(F.collect_set("term").alias("context"))


def overlap_scorer(rows: DataFrame) -> DataFrame:
    """Distinct context terms, the lemma left out, that the gloss holds."""
    shared = F.array_intersect(F.array_remove("context", F.col("lemma")), gloss_terms(F.col("gloss")))
    return rows.withColumn("score", F.coalesce(F.size(shared), F.lit(0)).cast("double"))


def scored(units: DataFrame, contexts: DataFrame, candidates_: DataFrame, scorer: Scorer = overlap_scorer) -> DataFrame:
    """Each unit occurrence with each candidate and its score.

    A score depends on the sentence and the lemma only, so it is computed once for each and joined back.
    """
    keys = [c for c in ("text_id", "row", "sentence") if c in units.columns and c in contexts.columns]
    pairs = units.select(*keys, "lang", "lemma").distinct().join(contexts.select(*keys, "context"), keys, "left")
    return scorer(pairs.join(small(candidates_), ["lang", "lemma"])).drop("context")


def selected(rows: DataFrame, keys: list[str], threshold: float, margin: float) -> DataFrame:
    """rows with ``rank`` and ``selected``: the best score if it reaches the threshold and leads by the margin.

    Ties select nothing; a score that isn't finite raises.
    """
    if not 0 <= margin < float("inf") or abs(threshold) == float("inf"):
        raise ValueError("the threshold must be finite and the margin at least 0")
    finite = F.when(F.isnan("score") | (F.abs("score") == float("inf")), F.raise_error(F.lit("a score isn't finite")).cast("double")).otherwise(F.col("score"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "synset_offset", "pos")
    ranked = rows.withColumn("score", finite).withColumns({"rank": F.row_number().over(order), "runner_up": F.lead("score").over(order)})
    lead = F.col("runner_up").isNull() | ((F.col("score") > F.col("runner_up")) & (F.col("score") - F.col("runner_up") >= margin))
    return ranked.withColumn("selected", (F.col("rank") == 1) & (F.col("score") >= threshold) & lead).drop("runner_up")


def _status(ranked: DataFrame, keys: list[str]) -> DataFrame:
    found = ranked.groupBy(*keys).agg(F.max((F.trim("gloss") == "").cast("int")).alias("unglossed"), F.max(F.col("selected").cast("int")).alias("chosen"))
    known = F.when(F.col("unglossed") == 1, "missing-english-definition").when(F.col("chosen") == 1, "resolved").otherwise("ambiguous")
    return found.select(*keys, known.alias("status"))


def statuses(words: DataFrame, ranked: DataFrame, stopwords: DataFrame, keys: list[str]) -> DataFrame:
    """keys and status: unlinked, missing-english-definition, ambiguous or resolved."""
    stop = small(stopwords.select("lang", F.col("word").alias("lemma")).distinct().withColumn("stop", F.lit(True)))
    rows = words.select(*keys).distinct().join(stop, ["lang", "lemma"], "left").join(_status(ranked, keys), keys, "left")
    unlinked = F.col("stop") | (F.trim("lemma") == "")
    return rows.select(*keys, F.when(F.coalesce(unlinked, F.lit(False)) | F.col("status").isNull(), "unlinked").otherwise(F.col("status")).alias("status"))


def text_statuses(texts: DataFrame, ranked: DataFrame, candidates_: DataFrame, stopwords: DataFrame) -> DataFrame:
    """(text_id, sentence, lang, lemma, status) as :func:`statuses` gives them, of all eligible words of texts.

    ranked: the units of these texts with each of their candidates_. Any other word is unlinked, so only ranked's own rows need a look
    at their scores; the words go to their sentence as one array for each piece of it.
    """
    keys = ["text_id", "sentence", "lang", "lemma"]
    lists = small(stopwords.groupBy("lang").agg(F.collect_set("word").alias("stops")))
    lower = F.transform("tokens", lambda t: F.lower(t["token"]))
    pieces = sentence_pieces(dealt(texts)).join(lists, "lang", "left").withColumn("words", F.array_except(lower, F.coalesce("stops", F.array().cast("array<string>"))))
    placed = pieces.where(F.size("words") > 0).select(*keys[:3], "words").repartition(*keys[:3])
    words = placed.select(*keys[:3], F.explode("words").alias("lemma")).where(is_word(F.col("lemma")))
    others = words.join(small(candidates_.select("lang", "lemma").distinct()), ["lang", "lemma"], "left_anti").distinct()
    return others.select(*keys, F.lit("unlinked").alias("status")).unionByName(_status(ranked, keys).withColumn("sentence", F.col("sentence").cast("int")))


def with_missing(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Nothing stays selected where any candidate lacks a gloss."""
    lacking = F.max((F.trim("gloss") == "").cast("int")).over(Window.partitionBy(*keys))
    return ranked.withColumn("selected", F.col("selected") & (lacking == 0))


def signatures(definitions: DataFrame, relations: DataFrame, frames: DataFrame, stopwords: DataFrame) -> DataFrame:
    """(synset_offset, pos, term, weight, direct): weights of gloss 2, verb frames 1.5, related glosses 1. Fixed values."""
    english = glosses(definitions).where("lang = 'eng'").select("synset_offset", "pos", "def")
    related = relations.where("relation in ('hypernym', 'hyponym')").join(
        english.select(F.col("synset_offset").alias("to_offset"), F.col("pos").alias("to_pos"), "def"), ["to_offset", "to_pos"]
    )
    parts = (
        english.select("synset_offset", "pos", F.col("def").alias("text"), F.lit(2.0).alias("weight"), F.lit(1).alias("direct"))
        .unionByName(frames.select("synset_offset", "pos", F.col("frame").alias("text"), F.lit(1.5).alias("weight"), F.lit(0).alias("direct")))
        .unionByName(related.select("synset_offset", "pos", F.col("def").alias("text"), F.lit(1.0).alias("weight"), F.lit(0).alias("direct")))
    )
    terms = parts.select("synset_offset", "pos", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("term"), "weight", "direct")
    words = small(stopwords.where("lang = 'eng'").select(F.col("word").alias("term")).distinct())
    kept = terms.join(words, "term", "left_anti")
    return kept.groupBy("synset_offset", "pos", "term").agg(F.sum("weight").alias("weight"), F.max("direct").alias("direct"))


def context_frequencies(texts: DataFrame, stopwords: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """(text_id, term, n): how often each term stands in an English text, stopwords left out.

    With a table of tags only tokens tagged as noun, verb, adjective or adverb count.
    """
    rows = lemmatised(bare_tokens(dealt(texts)))
    if tags is not None:
        rows = tagged(rows, tags).where(wordnet_pos(F.col("tag")).isNotNull())
    rows = eligible(rows, stopwords).withColumn("term", term(F.col("token"))).where("term <> ''")
    words = small(stopwords.select("lang", F.col("word").alias("term")).distinct())
    return rows.join(words, ["lang", "term"], "left_anti").groupBy("text_id", "term").agg(F.count("*").alias("n"))


def lesk_scores(units: DataFrame, frequencies: DataFrame, candidates_: DataFrame, signature: DataFrame) -> DataFrame:
    """(text_id, lemma, synset_offset, pos, score, direct): summed weights of shared terms, the lemma left out.

    A text's shared terms are found once per synset of the lexicon; units then take the sums of their candidates, less
    what the lemma itself adds.
    """
    hits = frequencies.join(small(signature), "term")
    sums = hits.groupBy("text_id", "synset_offset", "pos").agg(F.sum(F.col("n") * F.col("weight")).alias("all"), F.sum("direct").alias("all_direct"))
    own = hits.select("text_id", "synset_offset", "pos", F.col("term").alias("lemma"), (F.col("n") * F.col("weight")).alias("own"), F.col("direct").alias("own_direct"))
    pairs = units.select("text_id", "lang", "lemma").distinct().join(small(candidates_), ["lang", "lemma"])
    keys = ["text_id", "synset_offset", "pos"]
    joined = pairs.join(sums, keys, "left").join(own, [*keys, "lemma"], "left")
    zero = F.lit(0.0)
    return joined.select(
        "text_id", "lemma", "synset_offset", "pos",
        (F.coalesce("all", zero) - F.coalesce("own", zero)).alias("score"),
        (F.coalesce("all_direct", F.lit(0)) - F.coalesce("own_direct", F.lit(0))).cast("long").alias("direct"),
    )


def lesk_best(scores: DataFrame) -> DataFrame:
    """The best sense of each text and lemma: score, direct matches, then the first sense."""
    order = Window.partitionBy("text_id", "lemma").orderBy(F.desc("score"), F.desc("direct"), "synset_offset", "pos")
    return scores.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def phrase_in_text(texts: DataFrame, phrase: str, forms: DataFrame | None = None) -> DataFrame:
    """(text_id, lang, row, sentence, begin, end, lemma, matches): where a word or phrase stands, by surface, else by lemma.

    Texts without it give no row; ``matches`` over 1 says that the place isn't unique in its text.
    """
    want = phrase.lower().split()
    n, placed = len(want), lemmatised(tokens(texts), forms).withColumn("lower", F.lower("token"))
    if n == 1:
        found = placed.select("text_id", "lang", "row", "sentence", "begin", "end", "lemma", (F.col("lower") == want[0]).alias("surface"), (F.col("lemma") == want[0]).alias("by_lemma"))
    else:
        item = F.struct("idx", "begin", "end", "sentence", "lemma", "lower")
        rows = placed.groupBy("text_id", "lang", "row").agg(F.array_sort(F.collect_list(item)).alias("s"))
        spans = F.expr(
            f"transform(sequence(0, size(s) - {n}), k -> named_struct('sentence', s[k].sentence, 'begin', s[k].begin, 'end', s[k + {n - 1}].end, "
            f"'lower', transform(slice(s, k + 1, {n}), x -> x.lower), 'lemmas', transform(slice(s, k + 1, {n}), x -> x.lemma)))"
        )
        words = F.array(*map(F.lit, want))
        found = rows.where(F.size("s") >= n).select("text_id", "lang", "row", F.explode(spans).alias("p"))
        found = found.select("text_id", "lang", "row", "p.sentence", "p.begin", "p.end", F.array_join("p.lemmas", "_").alias("lemma"), (F.col("p.lower") == words).alias("surface"), (F.col("p.lemmas") == words).alias("by_lemma"))
    each = Window.partitionBy("text_id", "row")
    ranked = found.where("surface or by_lemma").withColumn("any_surface", F.max(F.col("surface").cast("int")).over(each)).where("surface or any_surface = 0")
    return ranked.withColumn("matches", F.count("*").over(each)).select("text_id", "lang", "row", "sentence", "begin", "end", "lemma", "matches")
