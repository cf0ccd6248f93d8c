"""A small lexicon, word lists and sample texts of our own, for tests and queries without outside data."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: (offset, part of speech, lemmas by language, definitions by language).
SYNSETS: tuple[tuple[str, str, dict[str, str], dict[str, str]], ...] = (
    ("90000001", "n", {"eng": "ring band", "ita": "anello", "fra": "anneau bague", "spa": "anillo", "por": "anel", "nld": "ring", "deu": "Ring"}, {"eng": "a small round band of metal worn on the hand"}),
    ("90000002", "n", {"eng": "ring", "ita": "arena ring", "fra": "arène ring", "spa": "cuadrilátero ring", "nld": "ring"}, {"eng": "a place with a large rest area where two people fight"}),
    ("90000003", "n", {"eng": "bolt", "ita": "bullone", "fra": "boulon", "spa": "perno", "por": "parafuso", "nld": "bout", "deu": "Bolzen"}, {"eng": "a small metal rod that holds a thing together"}),
    ("90000004", "n", {"eng": "bolt thunderbolt", "ita": "fulmine", "fra": "foudre éclair", "spa": "rayo", "por": "raio", "nld": "bliksem"}, {"eng": "a hot blue flash in the sky"}),
    ("90000005", "n", {"eng": "plate dish", "ita": "piatto", "fra": "plat assiette", "spa": "plato", "por": "prato", "nld": "plaat bord", "deu": "Platte"}, {"eng": "a large flat dish, hot or cold, for food"}),
    ("90000006", "n", {"eng": "plate home_plate", "ita": "piastra", "fra": "plaque", "spa": "placa", "por": "placa", "nld": "plaat"}, {"eng": "a thin new sheet of metal"}),
    ("90000007", "n", {"eng": "rest", "ita": "riposo", "fra": "repos", "spa": "reposo descanso", "por": "repouso", "nld": "rust"}, {"eng": "a time without work, or heat, or a thing in the hand"}),
    ("90000008", "n", {"eng": "rest remainder", "ita": "resto", "fra": "reste", "spa": "resto", "por": "resto", "nld": "rest", "deu": "Rest"}, {"eng": "the thing that is left of a whole"}),
    ("90000009", "n", {"eng": "hand", "ita": "mano", "fra": "main", "spa": "mano", "por": "mão", "nld": "hand", "deu": "Hand"}, {"eng": "the end of the arm that can rest on a thing"}),
    ("90000010", "n", {"eng": "hand worker", "ita": "operaio", "fra": "ouvrier", "spa": "obrero", "por": "operário", "nld": "arbeider"}, {"eng": "a person who works in a shed or on a ship"}),
    ("90000011", "n", {"eng": "thing object", "ita": "cosa oggetto", "fra": "chose objet", "spa": "cosa objeto", "por": "coisa objeto", "nld": "ding object", "deu": "Ding Objekt"}, {"eng": "any object that a hand can hold"}),
    ("90000012", "n", {"eng": "heat", "ita": "calore", "fra": "chaleur", "spa": "calor", "por": "calor", "nld": "hitte", "deu": "Hitze"}, {"eng": "what makes a thing hot"}),
    ("90000013", "n", {"eng": "reed", "ita": "canna giunco", "fra": "roseau", "spa": "caña junco", "por": "cana junco", "nld": "riet"}, {"eng": "a tall thing that grows in water"}),
    ("90000014", "n", {"eng": "shed", "ita": "capanno", "fra": "hangar", "spa": "cobertizo", "por": "galpão", "nld": "schuur"}, {"eng": "a small old house for tools"}),
    ("90000015", "n", {"eng": "shin", "ita": "stinco", "fra": "tibia", "spa": "espinilla tibia", "por": "tíbia", "nld": "scheen", "deu": "Schienbein"}, {}),
    ("90000016", "n", {"eng": "gear cog", "ita": "ingranaggio", "fra": "engrenage", "spa": "engranaje", "por": "engrenagem", "nld": "tandwiel"}, {"eng": "a new wheel with teeth"}),
    ("90000017", "n", {"eng": "rod bar", "ita": "barra asta", "fra": "barre tige", "spa": "barra vara", "por": "barra vara", "nld": "staaf"}, {"eng": "a long thin piece of metal"}),
    ("90000018", "n", {"eng": "widget gadget", "ita": "congegno", "fra": "gadget", "spa": "artilugio", "por": "dispositivo", "nld": "apparaat gadget"}, {"eng": "a small thing whose name one forgets"}),
    ("90000019", "n", {"eng": "gizmo gadget", "ita": "aggeggio", "fra": "gadget", "spa": "aparato", "por": "engenhoca", "nld": "gadget"}, {"eng": "a new tool"}),
    ("90000020", "n", {"eng": "anvil", "ita": "incudine", "fra": "enclume", "spa": "yunque", "por": "bigorna", "nld": "aambeeld"}, {"eng": "a large block on which hot metal is shaped"}),
    ("90000021", "n", {"eng": "water", "ita": "acqua", "fra": "eau", "spa": "agua", "por": "água", "nld": "water", "deu": "Wasser"}, {"eng": "what rain is", "fra": "ce qui tombe du ciel"}),
    ("90000022", "n", {"eng": "year", "ita": "anno", "fra": "an année", "spa": "año", "por": "ano", "nld": "jaar", "deu": "Jahr"}, {"eng": "twelve months"}),
    ("90000023", "n", {"eng": "wing", "ita": "ala", "fra": "aile", "spa": "ala", "por": "asa", "nld": "vleugel"}, {"eng": "what a bird flies with"}),
    ("90000024", "n", {"eng": "area", "ita": "area", "fra": "aire", "spa": "área", "por": "área", "nld": "gebied"}, {"fra": "une partie du sol"}),
    ("90000025", "n", {"eng": "era", "ita": "era", "fra": "ère", "spa": "era", "por": "era", "nld": "tijdperk"}, {"eng": "many years"}),
    ("90000026", "n", {"eng": "mind", "ita": "mente", "fra": "esprit", "spa": "mente", "por": "mente", "nld": "geest"}, {"eng": "what thinks", "spa": "lo que piensa"}),
    ("90000027", "n", {"eng": "slice", "ita": "fetta", "fra": "tranche", "spa": "raja", "por": "fatia", "nld": "plak"}, {"spa": "un trozo de fruta"}),
    ("90000028", "n", {"eng": "ration share", "ita": "razione", "fra": "ration", "spa": "ración", "por": "ração", "nld": "rantsoen"}, {"eng": "what each one gets"}),
    ("90000029", "n", {"eng": "duck", "ita": "anatra", "fra": "canard", "spa": "pato", "por": "pato", "nld": "eend", "deu": "Ente"}, {"eng": "a bird that lives on water"}),
    ("90000030", "n", {"eng": "unit", "ita": "unità", "fra": "unité", "spa": "unidad", "por": "unidade", "nld": "eenheid", "deu": "Einheit"}, {"eng": "one thing"}),
    ("90000031", "n", {"eng": "old_gear", "fra": "vieil_engrenage"}, {"eng": "worn gear"}),
    ("90000032", "v", {"eng": "heat", "ita": "scaldare", "fra": "chauffer", "spa": "calentar"}, {"eng": "make a thing hot"}),
    ("90000033", "a", {"eng": "hot", "ita": "caldo", "fra": "chaud", "spa": "caliente"}, {"eng": "with much heat"}),
    ("90000034", "n", {"eng": "metal", "ita": "metallo", "fra": "métal", "spa": "metal", "por": "metal", "nld": "metaal", "deu": "Metall"}, {"eng": "a hard thing that melts in heat"}),
    ("90000035", "n", {"eng": "the", "fra": "le"}, {"eng": "a word that is no noun"}),
)

#: One row that stands twice, as two files of one language can hold it.
DUPLICATES = (("90000001", "n", "90000001-n", "ita", "anello"),)

#: (offset, pos, relation, offset, pos).
RELATIONS = (
    ("90000001", "n", "hypernym", "90000011", "n"),
    ("90000003", "n", "hypernym", "90000017", "n"),
    ("90000017", "n", "hyponym", "90000003", "n"),
    ("90000005", "n", "hypernym", "90000011", "n"),
    ("90000006", "n", "hypernym", "90000034", "n"),
    ("90000009", "n", "hypernym", "90000011", "n"),
    ("90000007", "n", "hypernym", "90000012", "n"),
    ("90000008", "n", "hypernym", "90000011", "n"),
)

#: (offset, pos, verb frame).
FRAMES = (("90000032", "v", "somebody heats a metal thing"), ("90000032", "v", "something heats"))

#: Our own short lists: the articles, commonest prepositions, conjunctions, pronouns and forms of "be" and "have" of each
#: language, in alphabetical order. They were written down for these tests and are taken from no published list.
STOPWORDS = {
    "eng": "a an and are as at be but by for from had has have he her his i in is it its not of on or she so that the their there these they this to was we were what which who will with would you",
    "ita": "a al alla che con da dal del della di e gli i il in la le lo ma nel non o per più si sono su un una",
    "fra": "à au aux avec ce ces dans de des du elle en est et il ils je la le les mais ne nous on ou par pas plus pour que qui sa se son sur tre un une vous",
    "deu": "aber als am an auch auf aus bei das dem den der des die ein eine einer er es für ich im in ist mit nicht sich sie und von zu",
    "spa": "a al como con de del el ella en es este la las lo los más no o para pero por que se su sus un una y",
    "por": "a ao as com da das de do dos e ela em é eu mas na não no nos o os ou para por que se um uma",
    "nld": "aan als bij dat de den die een en er het hij ik in is maar met naar niet of om op te tot van voor was zij",
}

#: (lang, form, lemma) for texts that are lemmatised.
LEMMAS = (
    ("eng", "rings", "ring"), ("eng", "bolts", "bolt"), ("eng", "plates", "plate"), ("eng", "hands", "hand"), ("eng", "things", "thing"), ("eng", "reeds", "reed"),
    ("fra", "ailes", "aile"), ("fra", "eaux", "eau"), ("ita", "anelli", "anello"),
)

#: (lang, form, tag), as a tagger's output over the forms of a corpus.
TAGS = (("eng", "small", "JJ"), ("eng", "hot", "JJ"), ("eng", "cold", "ADJ"), ("eng", "old", "NN"), ("eng", "new", "NOUN"), ("eng", "rod", "VB"), ("eng", "the", "NN"))

#: (language, comparison language, text).
SAMPLES = (
    ("eng", "ita", "The rest of the metal lies on a hot plate in the old shed ."),
    ("ita", "eng", "Il metallo e il calore sono nella mano del operaio ."),
    ("fra", "eng", "Le repos de la main est dans une aire sur eau ."),
    ("spa", "fra", "La mente y el metal son una cosa con calor ."),
    ("por", "spa", "A mente e o metal em uma barra com calor ."),
    ("nld", "eng", "De hand en het object in water met een ring ."),
)


def _gathered() -> tuple[list, list]:
    lemmas, definitions = [], []
    for offset, pos, words, glosses in SYNSETS:
        lemmas += [(offset, pos, f"{offset}-{pos}", lang, w) for lang, ws in words.items() for w in ws.split()]
        definitions += [(offset, pos, f"{offset}-{pos}", lang, g) for lang, g in glosses.items()]
    return lemmas + list(DUPLICATES), definitions


LEMMA_ROWS, DEFINITION_ROWS = _gathered()

#: Names and contents of tab files.
TAB_FILES = (
    ("wn-data-eng.tab", "# Own English\t1.0\thttps://example.org/eng\tCC0\n# a second remark\n90000001-n\teng:lemma\tring\n90000001-n\teng:def\t0\ta round band\n\n90000016n\tlemma\tgear \n90000016n\tdef\t0\tx\nshort\tline\n90000034-n\teng:exe\t0\tno lemma\n"),
    ("wn-data-ita.tab", "#Own Italian\t1.0\t\tCC BY\n90000001-n\tita:lemma\tanello\n90000016-n\tita:lemma\tingranaggio\n90000016-n\tita:def\t0\truota con denti\n"),
    ("wn-data-en.tab", "90000003-n\tlemma\tbolt\n"),
    ("wn-wikt-eng.tab", "# Other\t1\tx\ty\n90000004-n\tlemma\tnever read\n"),
    ("notes.txt", "90000005-n\tlemma\tnever read\n"),
)


@dataclass(frozen=True)
class Lexicon:
    """The tables that analyses read; each needs (synset_offset, pos, lang, lemma or def) only."""

    lemmas: DataFrame
    definitions: DataFrame
    relations: DataFrame
    frames: DataFrame
    stopwords: DataFrame
    forms: DataFrame


def stopword_rows() -> list[tuple[str, str]]:
    return [(lang, w) for lang, words in STOPWORDS.items() for w in words.split()]


def local(spark: SparkSession, rows, columns: str) -> DataFrame:
    """A table of strings whose size the optimizer knows (that of rows given as a list is unknown to it)."""
    names = columns.split(", ")
    rows = list(rows)
    return spark.createDataFrame(pa.table({n: pa.array([r[k] for r in rows], pa.string()) for k, n in enumerate(names)}))


def lexicon(spark: SparkSession) -> Lexicon:
    return Lexicon(
        local(spark, LEMMA_ROWS, "synset_offset, pos, synset_id, lang, lemma"),
        local(spark, DEFINITION_ROWS, "synset_offset, pos, synset_id, lang, def"),
        local(spark, RELATIONS, "synset_offset, pos, relation, to_offset, to_pos"),
        local(spark, FRAMES, "synset_offset, pos, frame"),
        local(spark, stopword_rows(), "lang, word"),
        local(spark, LEMMAS, "lang, form, lemma"),
    )


def samples(spark: SparkSession) -> DataFrame:
    rows = [(str(k), *r) for k, r in enumerate(SAMPLES)]
    return local(spark, rows, "text_id, lang, target, text").selectExpr("cast(text_id as bigint) as text_id", "lang", "target", "text")
