"""Scalar functions on words, codes and texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Names of languages and their three-letter codes, and the languages that texts can be in.
ALIASES = {
    "en": "eng", "english": "eng", "it": "ita", "italian": "ita", "fr": "fra", "fre": "fra", "french": "fra",
    "de": "deu", "ger": "deu", "german": "deu", "es": "spa", "spanish": "spa", "pt": "por", "portuguese": "por",
    "nl": "nld", "dut": "nld", "dutch": "nld",
}
SUPPORTED = ("eng", "ita", "fra", "spa", "por", "nld")
NAMES = {"eng": "English", "ita": "Italian", "fra": "French", "deu": "German", "spa": "Spanish", "por": "Portuguese", "nld": "Dutch"}
TWO_LETTER = {"eng": "en", "ita": "it", "fra": "fr", "deu": "de", "spa": "es", "por": "pt", "nld": "nl"}


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def ascii_lower(c: Column) -> Column:
    """Folds A-Z only, as the lexicon's stored lemmas are folded."""
    return F.translate(c, UPPER, LOWER)


def trimmed(c: Column) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def _closeness(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


def transparency(source: Column, target: Column) -> Column:
    """1 - edit distance / longer length, of lower-cased trimmed forms; equal (or both empty) forms give 1."""
    return _closeness(trimmed(F.lower(source)), trimmed(F.lower(target)))


def similarity(a: Column, b: Column) -> Column:
    """The same over code points without trimming."""
    return _closeness(F.lower(a), F.lower(b))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """NFKC; text that is ASCII already doesn't change."""
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(_nfkc(F.when(~c.rlike(r"^[\x00-\x7F]*$"), c)))


def similarity_nfkc(a: Column, b: Column) -> Column:
    return similarity(nfkc(a), nfkc(b))


def normal_code(c: Column) -> Column:
    key = F.lower(trimmed(c))
    return F.coalesce(F.element_at(_lookup(ALIASES), key), key)


def is_supported(c: Column) -> Column:
    return normal_code(c).isin(*SUPPORTED)


def label(c: Column) -> Column:
    """``Italian (ita)``; codes without a name stand alone."""
    code = normal_code(c)
    name = F.element_at(_lookup(NAMES), code)
    return F.when(name.isNotNull(), F.concat(name, F.lit(" ("), code, F.lit(")"))).otherwise(code)


def clean(c: Column) -> Column:
    """NFKC; addresses of pages and mail and control characters become spaces; white space is collapsed and trimmed."""
    x = F.regexp_replace(nfkc(c), r"(?i)(https?://|www\.)[^ \t\n\x0B\f\r]+", " ")
    x = F.regexp_replace(x, r"[^ \t\n\x0B\f\r@]+@[^ \t\n\x0B\f\r@]+", " ")
    x = F.regexp_replace(x, r"[\p{Cc}\p{Cf}]", " ")
    return F.trim(F.regexp_replace(x, r"[ \t\n\x0B\f\r]+", " "))


def is_word(c: Column) -> Column:
    return c.rlike(r"\p{L}")


def wordnet_pos(tag: Column) -> Column:
    """n, v, a or r of a part-of-speech tag (Penn or universal), else null."""
    t = F.upper(tag)
    return (
        F.when(t.startswith("NN") | t.isin("NOUN", "PROPN"), "n")
        .when(t.startswith("VB") | (t == "VERB"), "v")
        .when(t.startswith("JJ") | (t == "ADJ"), "a")
        .when(t.startswith("RB") | (t == "ADV"), "r")
    )


def pos_letter(pos: Column) -> Column:
    """Letter of a part of speech; nouns where there is none."""
    return F.coalesce(F.when(F.lower(pos).isin("noun", "n"), "n").when(F.lower(pos).isin("verb", "v"), "v").when(F.lower(pos).isin("adjective", "a", "s"), "a").when(F.lower(pos).isin("adverb", "r"), "r"), F.lit("n"))


def match_case(original: Column, word: Column) -> Column:
    """word in the case of original: all upper (more than one character), first letter upper, or as it is."""
    shouted = (F.upper(original) == original) & (F.lower(original) != original) & (F.length(original) > 1)
    first = F.substring(original, 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    return F.when(shouted, F.upper(word)).when(capital, F.concat(F.upper(F.substring(word, 1, 1)), word.substr(F.lit(2), F.length(word)))).otherwise(word)


def form(lemma: Column) -> Column:
    """A lemma as text: underscores are spaces."""
    return F.translate(lemma, "_", " ")


def tidy_form(lemma: Column) -> Column:
    return F.trim(F.regexp_replace(form(lemma), r"[ \t\n\x0B\f\r]+", " "))


def marked(text: Column, begin: Column, end: Column, before: str = "<t>", after: str = "</t>") -> Column:
    """text with its part begin..end (from 0) between marks."""
    return F.concat(text.substr(F.lit(1), begin), F.lit(before), text.substr(begin + 1, end - begin), F.lit(after), text.substr(end + 1, F.length(text)))


def bar(score: Column, width: int = 16) -> Column:
    cells = F.floor(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) * width + 0.5).cast("int")
    return F.concat(F.repeat(F.lit("#"), cells), F.repeat(F.lit("-"), F.lit(width) - cells))


def clip(text: Column, width: int) -> Column:
    plain = F.regexp_replace(text, r"\p{Cc}", " ")
    return F.when(F.length(plain) <= width, plain).otherwise(F.concat(F.substring(plain, 1, width - 3), F.lit("...")))


def color(score: Column) -> Column:
    """high from 0.7, middle from 0.4, low below."""
    return F.when(score >= 0.7, "high").when(score >= 0.4, "middle").otherwise("low")


# Least score of each band.
BANDS = (("identical", 1.0), ("very similar", 0.9), ("recognizable", 0.7), ("partial", 0.5), ("weak", 0.2), ("minimal", 0.0))


def band(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, least in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def valid_rewrite(text: Column, source: Column, target: Column, direction: Column, least_change: Column, longest: int = 1000) -> Column:
    """Whether a rewrite can be asked for: length, a letter, two different supported languages, direction, change."""
    return (
        (F.length(text) <= longest)
        & is_word(text)
        & is_supported(source)
        & is_supported(target)
        & (normal_code(source) != normal_code(target))
        & direction.isin("more", "less")
        & least_change.between(0.0, 1.0)
    )


def statuses(json: Column, size: Column) -> Column:
    """The array under ``statuses`` if it has the size and only accepted, rejected or unverified, else null."""
    found = F.from_json(json, "statuses array<string>")["statuses"]
    good = (F.size(found) == size) & F.forall(found, lambda x: F.coalesce(x.isin("accepted", "rejected", "unverified"), F.lit(False)))
    return F.when(good, found)


def _bounded(word: str) -> str:
    escaped = "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in word)
    return rf"(?iu)(?<![\p{{L}}\p{{N}}\p{{M}}_]){escaped}(?![\p{{L}}\p{{N}}\p{{M}}_])"


def occurrences(text: Column, word: str) -> Column:
    """How often a word stands in a text between word boundaries, in any case."""
    return F.regexp_count(text, F.lit(_bounded(word)))


def only_place(text: Column, word: str) -> Column:
    """Where (from 0) a word that stands once in a text begins; null if it isn't there, an error if it stands more often."""
    n = occurrences(text, word)
    return F.when(n > 1, F.raise_error(F.lit("the word occurs more than once")).cast("int")).when(n == 1, F.regexp_instr(text, F.lit(_bounded(word))) - 1)
