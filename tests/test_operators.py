import pytest
from pyspark.sql import functions as F

from orthoweave.operators import graph, language, nearest, senses, substitution, tokens, translations, units
from orthoweave.plans import analyses
from orthoweave.sources import fixtures


@pytest.fixture(scope="module")
def stop(spark):
    return spark.createDataFrame(fixtures.stopword_rows(), "lang string, word string")


def texts(spark, *rows, lang="eng"):
    return spark.createDataFrame([(k, t, lang) for k, t in enumerate(rows)], "text_id long, text string, lang string")


def lemmas(spark, *rows):
    return spark.createDataFrame(list(rows), "synset_offset string, pos string, lang string, lemma string")


def defs(spark, *rows):
    return spark.createDataFrame(list(rows), "synset_offset string, pos string, lang string, def string")


COVER = (("01", "n", "eng", "tree"), ("02", "n", "eng", "bank"), ("03", "n", "eng", "bank"), ("04", "v", "eng", "bank"), ("05", "n", "eng", "the"))


@pytest.mark.parametrize("text, total, used, share", [("the tree tree quickly .", 3, 2, 2 / 3), ("the and .", 0, 0, 0.0), ("", 0, 0, 0.0), ("tree tree", 2, 2, 1.0), (None, 0, 0, 0.0)])
def test_coverage(spark, stop, text, total, used, share):
    row = units.coverage(texts(spark, text), lemmas(spark, *COVER), stop).first()
    assert (row.total_words, row.considered_words) == (total, used) and row.coverage == pytest.approx(share)


def test_unit_spans(spark, stop):
    rows = units.units(texts(spark, "the tree tree quickly ."), lemmas(spark, *COVER), stop).collect()
    assert sorted((r.begin, r.end) for r in rows) == [(4, 8), (9, 13)]


def test_phrases_take_their_tokens(spark, stop):
    lex = lemmas(spark, ("1", "n", "eng", "old_gear"), ("2", "n", "eng", "gear"), ("3", "n", "eng", "old_gear_rod"))
    rows = units.units(texts(spark, "an old gear rod . gear"), lex, stop, longest_phrase=3).collect()
    assert sorted((r.begin, r.lemma, r.unit_type, r.n_words) for r in rows) == [(3, "old_gear_rod", "NOMINAL_MWE", 3), (18, "gear", "NOMINAL_TOKEN", 1)]


def test_tokens(spark):
    rows = tokens.tokens(texts(spark, "First one. The 🌊 bank\nwas  there!")).orderBy("idx").collect()
    assert [(r.token, r.begin, r.sentence) for r in rows] == [("First", 0, 0), ("one.", 6, 0), ("The", 11, 1), ("🌊", 15, 1), ("bank", 17, 1), ("was", 22, 1), ("there!", 27, 1)]
    split = [r.token for r in tokens.bare_tokens(texts(spark, "l’été, it's e-mail?"), "regex").collect()]
    assert split == ["l’été", ",", "it's", "e-mail", "?"]


def test_tokens_of_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "ab cd.", "eng"), (1, "ab cd.", "eng"), (None, "x y", None), (None, "z", "eng"), (2, None, "eng"), (3, "", "eng"), (4, " \t", "eng")], "text_id long, text string, lang string")
    for parts in (1, 3):
        found = tokens.tokens(rows.repartition(parts))
        assert "Exchange" not in tokens.tokens(rows)._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.text_id is None, r.text_id or 0, r.token, r.idx, r.begin, r.end) for r in found.collect())
        assert got == sorted([(False, 1, "ab", 0, 0, 2), (False, 1, "cd.", 1, 3, 6)] * 2 + [(True, 0, "x", 0, 0, 1), (True, 0, "y", 1, 2, 3), (True, 0, "z", 0, 0, 1)])
        assert found.select("row").distinct().count() == 4
    lex = fixtures.lexicon(spark)
    twice = texts(spark, "the ring", "the ring").withColumn("text_id", F.lit(7))
    assert analyses.sentence_units(twice, lex).count() == 2 and units.units(twice, lex.lemmas, lex.stopwords).count() == 2


@pytest.mark.parametrize("mode", ["whitespace", "regex"])
def test_tokens_against_the_pattern(spark, mode):
    import regex

    made = ["a  b\tc\n", "Ünï 🌊\u3000x.\" y!)] z", "“Hi.” (No.) end", "\x0b\x0c", "l’été, it's e-mail?", "x\u00a0y\u2028z"]
    word = {"whitespace": r"[^ \t\n\x0B\f\r]+", "regex": r"[\p{L}\p{M}\p{N}]+(?:[’'\-][\p{L}\p{M}\p{N}]+)*|[^\p{L}\p{M}\p{N} \t\n\x0B\f\r]"}[mode]
    want = []
    for k, t in enumerate(made):
        sentence = 0
        for n, m in enumerate(regex.finditer(word, t)):
            want.append((k, n, sentence, m.group(), m.start(), m.end()))
            sentence += bool(regex.search(r"[.!?][\"')\]]*\Z", m.group()))
    got = [(r.text_id, r.idx, r.sentence, r.token, r.begin, r.end) for r in tokens.tokens(texts(spark, *made), mode).collect()]
    assert sorted(got) == sorted(want)


def test_tags_make_units_and_terms(spark, stop):
    lex = lemmas(spark, ("1", "n", "eng", "tree"))
    tags = spark.createDataFrame([("eng", "Bark", "NN"), ("eng", "bark", "VB"), ("eng", "runs", "VBZ"), ("eng", "the", "NN"), ("eng", "big", "XX")], "lang string, form string, pos string")
    rows = texts(spark, "the Bark of a big tree runs")
    assert [r.lemma for r in units.units(rows, lex, stop, tags=tags).orderBy("begin").collect()] == ["bark", "tree"]
    assert [r.lemma for r in units.units(rows, lex, stop, longest_phrase=2, tags=tags).orderBy("begin").collect()] == ["bark", "tree"]
    assert units.coverage(rows, lex, stop, tags=tags).first().considered_words == 2
    assert {r.term for r in senses.context_frequencies(rows, stop, tags).collect()} == {"bark", "runs"}
    assert {r.term for r in senses.context_frequencies(rows, stop).collect()} == {"bark", "runs", "big", "tree"}


def test_phrases_of_sentences(spark, stop):
    lex = lemmas(spark, ("1", "n", "eng", "cup_of_tea"), ("2", "n", "eng", "tea"), ("3", "n", "eng", "of_tea"), ("4", "v", "eng", "tea_set"), ("5", "n", "eng", "set"))
    rows = texts(spark, "cup of tea set of tea. set", "tea set set", "")
    got = sorted((r.text_id, r.begin, r.lemma) for r in units.units(rows, lex, stop, longest_phrase=3).collect())
    assert got == [(0, 0, "cup_of_tea"), (0, 11, "set"), (0, 23, "set"), (1, 0, "tea_set"), (1, 8, "set")]
    cover = {r.text_id: (r.total_words, r.considered_words, r.n_units) for r in units.coverage(rows, lex, stop, longest_phrase=3).collect()}
    assert cover == {0: (5, 5, 3), 1: (3, 3, 2), 2: (0, 0, 0)}
    items = units.collapsed(tokens.lemmatised(tokens.tokens(rows)), lex, 3).collect()
    assert sorted((r.text_id, r.sentence, " ".join(r.lemmas)) for r in items) == [(0, 0, "cup_of_tea set of tea."), (0, 1, "set"), (1, 0, "tea_set set")]


def test_english_candidates_by_stem(spark):
    lex = lemmas(spark, ("00000001", "n", "eng", "box"), ("00000002", "v", "eng", "box"), ("00000003", "s", "eng", "big"), ("00000004", "n", "eng", "goose"), ("00000005", "n", "ita", "boxes"), ("00000006", "n", "eng", "boxes"), ("12", "n", "eng", "box"))
    table = defs(spark, ("00000001", "n", "eng", "a container"), ("00000003", "s", "eng", "large"), ("12", "n", "eng", "an odd offset"), ("00000004", "n", "ita", "oca"))
    given = spark.createDataFrame([("eng", "boxes", None), ("eng", "biggest", "JJS"), ("eng", "bigest", "JJS"), ("eng", "geese", "NNS"), ("eng", "boxing", "VBG"), ("eng", "boxing", "UH"), ("ita", "boxes", None)], "lang string, lemma string, tag string")
    irregular = spark.createDataFrame([("n", "geese", "goose"), ("a", "biggest", "big")], "pos string, form string, base string")
    got = {(r.lemma, r.synset_offset, r.pos, r.gloss) for r in senses.english_candidates(given, lex, table, irregular).collect()}
    assert got == {("boxes", "00000001", "n", "a container"), ("boxes", "00000002", "v", ""), ("boxes", "00000006", "n", ""), ("boxes", "12", "n", ""), ("bigest", "00000003", "a", "large"), ("biggest", "00000003", "a", "large"), ("geese", "00000004", "n", ""), ("boxing", "00000002", "v", "")}


def test_scorers_serve_every_analysis(spark, stop):
    lex = bank(spark, stop)
    two = texts(spark, "The bank approved it .", "no unit here")

    def second(rows):
        return rows.withColumn("score", F.when(F.col("synset_offset") == "2", 4.0).otherwise(1.0))

    assert {r.synset_offset for r in analyses.comparisons(two, lex, scorer=second).where("selected").collect()} == {"2"}
    assert {r.target for r in analyses.details(two, lex, scorer=second).collect()} == {"bank", "rive"}
    got = {r.target_lang: r.score for r in analyses.text_transparency(two, lex, scorer=second).collect()}
    assert got["ita"] == 1.0 and analyses.text_transparency(two, lex).count() == 0
    assert [(r.text_id, r.n_units, r.analysed_units) for r in analyses.analysed_units(two, lex, scorer=second).collect()] == [(0, 1, 1)]
    assert [(r.text_id, r.n_units, r.analysed_units) for r in analyses.analysed_units(two, lex).collect()] == [(0, 1, 0)]
    assert {r.target for r in analyses.word_in_context(two, "bank", lex, scorer=second).where("target_lang = 'fra'").collect()} == {"rive"}
    assert analyses.text_transparency(two, lex, analyses.Choice(5.0, 0.0), second).count() == 0


def test_nearest(spark):
    import numpy as np

    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [0.0, 2.0])], "id long, v array<double>")
    table = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 3.0])], "label string, vector array<double>")
    got = {r.id: (r.picked, round(r.score, 6)) for r in nearest.best_match(rows, "v", table, 0.2, 0.1).collect()}
    assert got == {1: ("a", 1.0), 2: (None, round(float(np.sqrt(0.5)), 6)), 3: (None, 0.0), 4: ("b", 1.0)}
    for bad in ([[1.0]], [[1.0, float("nan")]]):
        odd = spark.createDataFrame([(1, bad[0])], "id long, v array<double>")
        with pytest.raises(Exception, match="vectors"):
            nearest.best_match(odd, "v", table, 0.2, 0.1).collect()
    with pytest.raises(ValueError):
        nearest.MOST_NUMBERS, kept = 1, nearest.MOST_NUMBERS
        try:
            nearest.best_match(rows, "v", table, 0.2, 0.1)
        finally:
            nearest.MOST_NUMBERS = kept


SELECT = [(2.5, 0.25, [3.0, 4.0], 1), (2.5, 0.25, [2.49], None), (2.5, 0.25, [2.5, 2.25], 0), (2.5, 0.25, [3.0, 2.9], None), (0.0, 0.0, [3.0, 3.0], None)]


@pytest.mark.parametrize("threshold, margin, scores, want", SELECT)
def test_selection(spark, threshold, margin, scores, want):
    rows = spark.createDataFrame([(1, f"{k}", "n", s) for k, s in enumerate(scores)], "key long, synset_offset string, pos string, score double")
    got = [r.synset_offset for r in senses.selected(rows, ["key"], threshold, margin).where("selected").collect()]
    assert got == ([] if want is None else [str(want)])


def test_selection_refuses_odd_numbers(spark):
    rows = spark.createDataFrame([(1, "1", "n", float("nan"))], "key long, synset_offset string, pos string, score double")
    with pytest.raises(Exception, match="finite"):
        senses.selected(rows, ["key"], 2.5, 0.25).collect()
    with pytest.raises(ValueError):
        senses.selected(rows, ["key"], 0.0, -1.0)


BANK = (("1", "n", "eng", "bank"), ("2", "n", "eng", "bank"), ("1", "n", "ita", "banca"), ("2", "n", "ita", "bank"), ("1", "n", "fra", "banque"), ("2", "n", "fra", "rive"))
BANK_DEFS = (("1", "n", "eng", "a financial institution"), ("2", "n", "eng", "sloping land beside a river"))


def bank(spark, stop):
    lex = lemmas(spark, *BANK)
    none = spark.createDataFrame([], "lang string, form string, lemma string")
    return fixtures.Lexicon(lex, defs(spark, *BANK_DEFS), None, None, stop, none)


def test_two_senses(spark, stop):
    lex = bank(spark, stop)
    two = texts(spark, "The bank is a financial place . The river floods the bank .")
    rows = analyses.comparisons(two, lex).where("selected").orderBy("begin").collect()
    assert [(r.begin, r.synset_offset) for r in rows] == [(4, "1"), (53, "2")] or len({r.synset_offset for r in rows}) == 2
    found = analyses.details(two, lex).collect()
    assert {(r.begin, r.target) for r in found} >= {(4, "banca")} and all(r.target_lang != "eng" for r in found)
    plain = analyses.comparisons(texts(spark, "The bank approved it ."), lex)
    assert plain.count() == 2 and plain.where("selected").count() == 0


def test_statuses(spark, stop):
    lex = lemmas(spark, *BANK, ("3", "n", "eng", "shin"))
    words = spark.createDataFrame([("eng", "bank"), ("eng", "nothing"), ("eng", "the"), ("eng", "shin")], "lang string, lemma string")
    table = senses.candidates(words, lex, defs(spark, *BANK_DEFS)).withColumn("score", F.when(F.col("synset_offset") == "1", 4.0).otherwise(1.0))
    ranked = senses.selected(table, ["lang", "lemma"], 2.5, 0.25)
    got = {r.lemma: r.status for r in senses.statuses(words, ranked, stop, ["lang", "lemma"]).collect()}
    assert got == {"bank": "resolved", "nothing": "unlinked", "the": "unlinked", "shin": "missing-english-definition"}


def test_glosses_come_from_english_first(spark):
    lex = lemmas(spark, ("08420278", "n", "ita", "Banca"), ("9", "n", "ita", "banca"))
    table = defs(spark, ("08420278", "n", "eng", "a financial institution"), ("9", "n", "ita", "riva"), ("08420278", "n", "ita", "istituto"))
    rows = senses.candidates(spark.createDataFrame([("ita", "banca")], "lang string, lemma string"), lex, table).collect()
    assert {(r.synset_offset, r.gloss) for r in rows} == {("08420278", "a financial institution"), ("9", "riva")}


def test_glosses_of_the_dictionary_fill_blank_ones(spark):
    lex = lemmas(spark, ("00000001", "n", "ita", "a"), ("00000002", "s", "ita", "a"), ("00000003", "n", "ita", "a"), ("00000001", "n", "eng", "a"))
    table = defs(spark, ("00000003", "n", "ita", "nota"), ("00000001", "n", "eng", " "))
    given = spark.createDataFrame([("00000001", "n", "one"), ("00000002", "a", "two"), ("00000003", "n", "three")], "synset_offset string, pos string, def string")
    words = spark.createDataFrame([("ita", "a"), ("eng", "a")], "lang string, lemma string")
    got = {(r.lang, r.synset_offset): r.gloss for r in senses.candidates(words, lex, table, dictionary=given).collect()}
    assert got == {("ita", "00000001"): "one", ("ita", "00000002"): "two", ("ita", "00000003"): "nota", ("eng", "00000001"): " "}


def test_best_and_profile(spark):
    rows = spark.createDataFrame([("u", "1", "n", "ita", "a", 0.8), ("u", "1", "n", "ita", "b", 0.9), ("u", "1", "n", "ita", "b", 0.9), ("u", "1", "n", "fra", "c", 0.4)], "lemma string, synset_offset string, pos string, target_lang string, target string, score double")
    assert {r.target_lang: r.score for r in translations.best_per_language(rows).collect()} == {"ita": 0.9, "fra": 0.4}
    best = spark.createDataFrame([(f"u{k}", "1", "n", "ita", s) for k, s in enumerate((0.8, 0.6, 0.5, 0.4))], "lemma string, synset_offset string, pos string, target_lang string, score double")
    placed = spark.createDataFrame([(1, 0, f"u{k}") for k in range(4)], "text_id long, sentence int, lemma string")
    chosen = placed.withColumns({"synset_offset": F.lit("1"), "pos": F.lit("n")})
    assert translations.profiles(placed, chosen, best).first().score == pytest.approx(0.575)


def test_profiles_agree_with_the_analysis(spark):
    lex = fixtures.lexicon(spark)
    rows = texts(spark, "small ring and hot plate . the hand can rest", "no unit", "shin and gear")
    choice = analyses.Choice(0.0, 0.25)
    direct = {(r.text_id, r.target_lang): r.score for r in analyses.text_transparency(rows, lex, choice).collect()}
    found = analyses.comparisons(rows, lex, choice)
    placed = analyses.sentence_units(rows, lex).select("text_id", "sentence", F.explode("units.lemma").alias("lemma"))
    table = senses.candidates(units.nouns(lex.lemmas), lex.lemmas, lex.definitions, "n")
    best = translations.best_per_language(translations.scored_translations(table, lex.lemmas))
    slow = translations.profiles(placed, found.where("selected").select("text_id", "sentence", "lemma", "synset_offset", "pos").distinct(), best)
    assert {(r.text_id, r.target_lang): pytest.approx(r.score) for r in slow.collect()} == direct and direct


SENSES = "text_id long, lemma string, begin int, end int, synset_offset string, pos string, score double, selected boolean"
CLINIC = (("1", "n", "ita", "ospedale"), ("1", "n", "ita", "clinica"), ("1", "n", "fra", "hôpital"), ("2", "n", "ita", "fiume"), ("3", "n", "ita", "riviera"))


def proposed(spark, more, least=0.5):
    text = texts(spark, "The Hospital near the river")
    rows = spark.createDataFrame([(0, "hospital", 4, 12, "1", "n", 0.9, True), (0, "river", 22, 27, "2", "n", 0.8, True), (0, "river", 22, 27, "3", "n", 0.2, False)], SENSES)
    return substitution.proposals(text, rows, lemmas(spark, *CLINIC), "ita", more, least)


def test_proposals(spark):
    # scores are those of the words themselves: hospital/ospedale 0.5, hospital/clinica 0.125, river/fiume 0.2
    more = substitution.applied(proposed(spark, True)).first()
    assert more.result == "The Ospedale near the river" and more.applied == 1
    less = substitution.applied(proposed(spark, False)).first()
    assert less.result == "The Clinica near the fiume"


def test_checked_proposals(spark):
    row = substitution.applied(proposed(spark, False), lambda t: 0.1 if "fiume" in t else 0.9).first()
    assert (row.result, row.applied, row.rejected) == ("The Clinica near the river", 1, 1)

    def broken(text):
        raise RuntimeError("down")

    assert substitution.applied(proposed(spark, False), broken).first().applied == 2


HOSPITAL = (("1", "n", "eng", "hospital"), ("1", "n", "eng", "clinic"), ("1", "n", "eng", "infirmary"), ("1", "n", "ita", "clinica"), ("1", "n", "fra", "hopital"))


def test_alternatives(spark):
    given = spark.createDataFrame([("Hospital", "1", "n")], "original string, synset_offset string, pos string")
    rows = substitution.alternatives(given, lemmas(spark, *HOSPITAL), "eng", "ita").orderBy(F.desc("transparency")).collect()
    assert [(r.replacement, r.reference_form, r.validation) for r in rows][0] == ("Clinic", "clinica", "unverified") and len(rows) == 2
    back = lemmas(spark, ("1", "n", "ita", "banca"), ("1", "n", "ita", "istituto_di_credito"), ("1", "n", "eng", "bank"))
    rows = substitution.alternatives(spark.createDataFrame([("banca", "1", "n")], "original string, synset_offset string, pos string"), back, "ita", "eng").collect()
    assert [(r.replacement, r.reference_form) for r in rows] == [("istituto di credito", "bank")]
    with pytest.raises(ValueError):
        substitution.alternatives(given, back, "eng", "eng")


def plan(spark, text, more=True, least=0.0, spans=((0, None),), selected=True, lex=HOSPITAL):
    df = texts(spark, text)
    rows = spark.createDataFrame([(0, "x", b, len(text) if e is None else e, "1", "n", 1.0, selected) for b, e in spans], SENSES)
    return substitution.rewrite_plan(df, rows, lemmas(spark, *lex), "eng", "ita", more, least)


def test_rewrite_plan(spark):
    row = plan(spark, "The hospital", spans=[(4, 12)]).first()
    assert [(c.replacement, c.reference) for c in row.choices] == [("clinic", "clinica")] and row.choices[0].score > row.choices[0].baseline
    less = plan(spark, "The clinic", more=False, spans=[(4, 10)]).first()
    assert all(c.score < c.baseline and c.replacement != "clinica" for c in less.choices) and less.choices
    same = plan(spark, "hospital", lex=(HOSPITAL[0], HOSPITAL[3])).first()
    assert same.choices == [] and (same.considered, same.unavailable) == (1, 1)
    assert plan(spark, "hospital", selected=False).count() == 0
    assert [len(plan(spark, "hospital", least=x).first().choices) for x in (0.9, 0.05)] == [0, 1]
    assert plan(spark, "hospital ward", spans=[(0, 8), (0, 13)]).first().considered == 1


def test_completed(spark):
    two = plan(spark, "hospital hospital", spans=[(0, 8), (9, 17)])
    done = substitution.completed(two.withColumn("statuses", F.array(F.lit("accepted"), F.lit("unverified")))).first()
    assert (done.result, done.applied, done.requested) == ("clinic hospital", 1, 2) and len(done.warnings) == 1
    bad = substitution.completed(two.withColumn("statuses", F.array(F.lit("accepted")))).first()
    assert (bad.result, bad.applied) == ("hospital hospital", 0)
    judged = substitution.judged(two, lambda before, after, choice: "accepted").drop("x")
    assert substitution.completed(judged).first().result == "clinic clinic"
    assert substitution.judged(two, lambda *a: 1 / 0).first().statuses == ["unverified", "unverified"]


def test_lesk(spark):
    lex = fixtures.lexicon(spark)
    signature = senses.signatures(lex.definitions, lex.relations, lex.frames, lex.stopwords)
    table = senses.candidates(units.nouns(lex.lemmas), lex.lemmas, lex.definitions, "n")
    rows = texts(spark, "a metal band on one hand with a ring", "two people fight in a ring")
    found = senses.lesk_best(senses.lesk_scores(units.units(rows, lex.lemmas, lex.stopwords), senses.context_frequencies(rows, lex.stopwords), table, signature))
    assert {r.text_id: r.synset_offset for r in found.where("lemma = 'ring'").collect()} == {0: "90000001", 1: "90000002"}
    weights = {r.term: r.weight for r in signature.where("synset_offset = '90000032'").collect()}
    assert weights["metal"] == 1.5 and weights["hot"] == 2.0 and weights["thing"] == 3.5


def test_word_in_context(spark):
    lex = fixtures.lexicon(spark)
    rows = texts(spark, "The reeds stand .", "reed and reed", "no such word")
    found = analyses.word_in_context(rows, "reed", lex, analyses.Choice(0.0, 0.25)).collect()
    assert {r.text_id for r in found} == {0} and {r.target_lang for r in found} >= {"ita", "eng"}


def test_graph(spark, stop):
    schema = "text_id long, lang string, unit string, place int, target_lang string, target string, score double"
    rows = [(1, "eng", f"u{k:03d}", k, t, f"w{k}", 0.5) for k in range(50) for t in ("ita", "fra")]
    rows += [(1, "eng", "the", 0, "ita", "il", 0.9), (1, "eng", "u000", 0, "ita", "better", 0.9), (1, "eng", "u000", 0, "en", "same", 0.9), (1, "eng", "u001", 1, "spa", "odd", 1.5)]
    nodes, links = graph.graph(spark.createDataFrame(rows, schema), stop)
    assert nodes.count() == 120 and links.count() == 80
    assert {r.word for r in nodes.where("unit = 'u000' and not source").collect()} == {"better", "w0"}


SENTENCES = {
    "eng": "the water of the river and the light of the morning were in a room with her",
    "ita": "il cielo della notte e la luna che non si vede dal mare sono con le stelle",
    "fra": "la maison de la ville est dans le jardin avec les fleurs que nous avons pour vous",
    "deu": "das Haus und der Garten sind mit den Blumen in der Stadt und sie ist nicht auf dem Berg",
    "spa": "la casa de la ciudad y el jardín con las flores son para los niños que no están en el mar",
    "por": "a casa da cidade e o jardim com as flores são para os meninos que não estão no mar",
    "nld": "het huis van de stad en de tuin met het water zijn niet in een dorp maar op de berg",
}


def test_detection(spark, stop):
    rows = spark.createDataFrame([(k, t, None) for k, t in enumerate([*SENTENCES.values(), "bank", "123 https://example.org", SENTENCES["eng"] + ". " + SENTENCES["ita"] + "."])], "text_id long, text string, lang string")
    got = {r.text_id: r for r in language.detect(rows, stop).collect()}
    assert [got[k].code for k in range(7)] == list(SENTENCES)
    assert got[7].uncertain and 8 not in got and got[9].mixed and got[9].uncertain and got[3].uncertain
    assert all(0 <= a.confidence <= 1 for r in got.values() for a in r.alternatives or ())


def test_contrast(spark):
    lex = fixtures.lexicon(spark)
    rows = fixtures.samples(spark).select("text_id", "text", "lang")
    found = analyses.contrast(rows, lex, choice=analyses.Choice(0.0, 0.25), detect=True)
    assert found["coverage"].count() == 6 and found["results"].count() > 6 and found["links"].count() > 6
    assert {r.language for r in found["languages"].collect()} >= {"English (eng)", "Italian (ita)"}
    assert analyses.explored("ring", "eng", lex).where("target_lang = 'ita'").count() == 2
    assert {r.mode for r in found["languages"].collect()} == {"NOMINAL_AGGREGATE_SUM"} and found["analysed"].count() == 6
    odd = texts(spark, "the ring", "12 34", None).unionByName(texts(spark, "Ding", lang="deu"))
    listed = analyses.contrast(odd, lex, word="ring", choice=analyses.Choice(0.0, 0.25))
    got = sorted((r.language, r.mode, r.confidence, r.error or "") for r in listed["languages"].collect())
    assert got == [("English (eng)", "CHOSEN_WORD", 1.0, "")] + [("English (eng)", "CHOSEN_WORD", 1.0, "no words")] * 2 + [("German (deu)", "CHOSEN_WORD", 1.0, "unsupported language")]
    assert listed["coverage"].count() == 1
    lines = analyses.report(found, top=2, width=40).collect()
    assert max(len(r.line) for r in lines) <= 40 and {r.place for r in lines} == {1, 2}
    order = [(r.lemma, r.begin, not r.selected, -r.score) for r in found["comparisons"].where("text_id = 0").orderBy("place").collect()]
    assert order == sorted(order) and len(order) > 3


def test_tokens_come_in_slices(spark, monkeypatch):
    """A batch of texts is split a slice at a time, or two workers' arrays fill an executor."""
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark import TaskContext

    few, runs = texts(spark, "a"), []
    with monkeypatch.context() as held:
        held.setattr(type(few), "mapInArrow", lambda self, f, schema: runs.append(f) or self)
        tokens.tokens(few), tokens.sentence_pieces(few)
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    whole = ["ab cd. " * 600, "", None, "x"] * 1500
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(whole))), pa.array(["eng"] * len(whole)), pa.array(whole)], names=["text_id", "lang", "text"])
    for run in runs:
        made = list(run(iter([batch, batch.slice(0, 0)])))
        assert max(x.nbytes for x in made) < 32 << 20
        assert {(a, b) for x in made for a, b in zip(x["text_id"].to_pylist(), x["row"].to_pylist(), strict=True)} == {(k, k) for k, t in enumerate(whole) if t}


@pytest.mark.parametrize("parts", [1, 3])
def test_sentences_against_their_tokens(spark, parts):
    """Units and contexts of long, repeated, null and odd texts are those of the tokens one by one."""
    lex = fixtures.lexicon(spark)
    made = [
        (1, "ring " * 500 + "the. ring 'it's don't THE ring?", "eng"), (1, "ring ring", "eng"), (None, "ring", None), (None, "the ring . Ring ring.", "eng"), (5, None, "eng"), (6, "", "eng"), (7, " . ! ?", "eng"),
        (8, "été ring l'eau eau", "fra"), (9, "x " * 64 + "ring. " + "y " * 128 + "z. " + "a b " * 64 + " ring", "eng"), (10, "ring", "xxx"), (11, "the shed of a duck", "eng"),
    ]
    rows = spark.createDataFrame(made, "text_id long, text string, lang string").repartition(parts)
    stop, noun = {tuple(r) for r in fixtures.stopword_rows()}, {tuple(r) for r in units.nouns(lex.lemmas).collect()}
    want: dict = {}
    for r in tokens.tokens(rows).withColumns({"lemma": F.lower("token"), "term": tokens.term(F.col("token"))}).collect():
        if any(c.isalpha() for c in r.token) and (r.lang, r.lemma) not in stop:
            context, found = want.setdefault((r.text_id, r.lang, r.row, r.sentence), (set(), []))
            context |= {r.term} if (r.lang, r.term) not in stop else set()
            found += [(r.lemma, r.begin, r.end)] if (r.lang, r.lemma) in noun else []
    plain = sorted((str(k[:2]), k[3], sorted(c), sorted(u)) for k, (c, u) in want.items() if u)
    got = analyses.sentence_units(rows, lex).collect()
    assert sorted((str((r.text_id, r.lang)), r.sentence, sorted(r.context), sorted(map(tuple, r.units))) for r in got) == plain and len(plain) == 8


def test_ranked_senses_read_the_tokens_once(spark, tmp_path):
    """Scores take their context from the sentence's own row, not from another pass over all texts."""
    from orthoweave.plans import queries

    made = [(1, "a small ring of hot metal. the ring, the ring in a hand", "en"), (2, "nothing here", "en"), (3, None, "en"), (4, "l'anneau anneau", "fr")]
    spark.createDataFrame(made, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.sense_scores(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted({(r.text_id, r.sentence, r.lemma) for r in found.collect()}) == [(1, 0, "ring"), (1, 1, "hand"), (1, 1, "ring"), (4, 0, "anneau")]


def test_statuses_of_texts(spark, tmp_path):
    """Only a sentence's words as an array are shuffled, and no word is joined with the scores; the rows are those of statuses()."""
    from orthoweave.plans import queries

    made = [(1, "A small ring, ring of hot metal . the RING in a shin 12 --", "en"), (2, "x " * 70 + "y " * 70 + "ring", "en"), (3, None, "en"), (4, "l'anneau anneau", "fr"), (5, "ring ring. ring", "en"), (5, "ring ring. ring", "en")]
    spark.createDataFrame(made, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    lex, path = fixtures.lexicon(spark), str(tmp_path)
    words = tokens.eligible(tokens.lemmatised(tokens.tokens(queries._docs(spark, path))), lex.stopwords)
    keys = ["text_id", "sentence", "lang", "lemma"]
    want = senses.statuses(words, queries._ranked(spark, path, lex), lex.stopwords, keys).drop("lang")
    found = queries.sense_status(spark, path)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "LeftOuter, (text_id" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "Join LeftOuter, ((((text_id" not in plan
    assert "RepartitionByExpression [text_id" in plan and "words#" in plan


#: Queries over the sentences of documents whose executors were stopped by their memory at 1 GB.
IN_HEAP = ["graph_links", "sense_select_strict", "text_comparisons", "text_details_strict", "text_transparency_scored", "analysed_units", "comparisons_placed", "graph_nodes", "sense_select", "text_details", "text_transparency", "text_transparency_strict", "top12_report"]


@pytest.mark.parametrize("name", IN_HEAP)
def test_sentences_need_no_python_workers(spark, tmp_path, name):
    """Workers' arrays stood beside a full heap; and the texts are read once."""
    from orthoweave.plans import queries

    spark.createDataFrame([(1, "a small ring of hot metal.", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapIn" not in plan and plan.count("Relation [doc_id") == 1


@pytest.mark.parametrize("parts", [1, 3])
def test_sentence_strings_against_their_tokens(spark, parts):
    """Places of sentences and pieces, counted over blocks, are those of the tokens one by one; a piece is carried along alone."""
    odd = "  \x0b🌊 one.\" two.)]x three.) \t'four' \" . ?! e.g. été...\u2028five\u00a0six! "
    rows = spark.createDataFrame([
        (1, odd, "eng"), (2, odd * 150, "eng"), (3, "ab 🌊 " * 5000, "eng"), (4, None, "eng"), (5, "", "eng"), (6, " \n", None), (7, "x. " * 4500 + "y", "eng"), (None, "a.\nb", None), (8, "a b! " * 64, "eng"), (8, "." * 9000, "eng"),
    ], "text_id long, text string, lang string").repartition(parts)
    made = tokens.sentence_strings(rows)
    assert "parts" not in made._jdf.queryExecution().executedPlan().toString().split("Generate posexplode(zipped")[1].split(", [", 1)[1].split("]")[0]
    got = {}
    for r in made.collect():
        items = tokens._spaced(pa_texts(r.piece))
        n = len(items[4])
        assert 0 < n <= tokens.PIECE_TOKENS
        for k, t in enumerate(items[4].to_pylist()):
            got.setdefault((r.text_id, r.lang, r.row), []).append((r.sentence, t, r.begin + int(items[1][k]), r.begin + int(items[2][k])))
    want = {}
    for r in tokens.tokens(rows).collect():
        want.setdefault((r.text_id, r.lang, r.row), []).append((r.sentence, r.token, r.begin, r.end))
    plain = lambda found: sorted((str(k[:2]), sorted(v)) for k, v in found.items())
    assert plain(got) == plain(want)
    counts = made.groupBy("row", "sentence").agg(F.count("*").alias("n"), F.min("whole").alias("whole"))
    assert counts.where("whole <> (n = 1)").count() == 0


def pa_texts(*rows):
    import pyarrow as pa

    return pa.array(rows)
