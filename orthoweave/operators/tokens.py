"""Tokens of texts, with offsets and sentence numbers, and the filters on them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.joins import small
from ..functions.text import is_word, marked

SPACE = r"[ \t\n\x0B\f\r]+"
NO_SPACE = r"[^ \t\n\x0B\f\r]+"
WORD = r"[\p{L}\p{M}\p{N}]+(?:[’'\-][\p{L}\p{M}\p{N}]+)*"
_MODES = {"whitespace": (NO_SPACE, SPACE), "regex": (rf"{WORD}|[^\p{{L}}\p{{M}}\p{{N}} \t\n\x0B\f\r]", SPACE)}
_BYTES = np.arange(256)
_SPACES, _CLOSES, _STOPS = (np.isin(_BYTES, list(x)) for x in (b" \t\n\x0b\f\r", b"\"')]", b".!?"))
_STOP = re.compile(r"[.!?][\"')\]]*\Z")
#: Bytes of text that are split at once: a token takes many times its bytes in arrays, and two tasks of an executor do so.
SLICE_BYTES = 1 << 20


def bare_tokens(texts: DataFrame, mode: str = "whitespace") -> DataFrame:
    """(text_id, lang, token): what needs no offsets needs no sort and no shuffle."""
    token = _MODES[mode][0]
    return texts.select("text_id", "lang", F.explode(F.regexp_extract_all("text", F.lit(f"({token})"), F.lit(1))).alias("token"))


def _breaks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which tokens end a sentence: those that end in a full stop, exclamation or question mark and closing marks."""
    last = end - 1
    while True:
        back = _CLOSES[data[last]] & (last > start)
        if not back.any():
            return _STOPS[data[last]]
        last = last - back


def _spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, begin, end, ends a sentence, token) of the whitespace tokens of a batch of texts, in one pass over its bytes."""
    column = pc.fill_null(column.cast(pa.string()), "")
    edges = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[edges[0] : edges[-1]] if raw is not None else np.zeros(0, np.uint8)
    edges -= edges[0]
    word = ~_SPACES[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[edges] = True
    start = np.flatnonzero(word & (np.r_[True, ~word[:-1]] | cut[:-1])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(word & (np.r_[~word[1:], True] | cut[1:])) + 1 if len(data) else start
    text = np.searchsorted(edges, start, side="right") - 1
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    first = points[edges[text]]
    offsets = np.r_[0, np.cumsum(end - start)].astype(np.int32)
    token = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[word].tobytes()))
    return text, points[start] - first, points[end] - first, _breaks(data, start, end), token


def _matched(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The same for tokens that are words or single marks."""
    import regex

    token = regex.compile(_MODES["regex"][0])
    rows = [(k, m.start(), m.end(), m.group()) for k, t in enumerate(column.to_pylist()) for m in token.finditer(t or "")]
    text, begin, end, found = zip(*rows, strict=True) if rows else ((), (), (), ())
    return np.array(text, np.int64), np.array(begin, np.int64), np.array(end, np.int64), np.array([bool(_STOP.search(t)) for t in found], bool), pa.array(found, pa.string())


def sliced(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """batch in slices of whole rows; the texts of a slice but its last one have less than ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // limit)) + 1
    for first, last in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
        yield batch.slice(first, last - first)


def tokens(texts: DataFrame, mode: str = "whitespace") -> DataFrame:
    """(text_id, lang, row, idx, sentence, token, begin, end): code-point offsets; idx and sentence count from 0.

    A sentence ends with a token that ends in a full stop, exclamation or question mark and closing marks. Each text is
    split where it lies, without a shuffle, a slice of a batch at a time. ``row`` tells rows of texts apart, those with equal or null text_id too.
    """
    split = {"whitespace": _spaced, "regex": _matched}[mode]
    schema = StructType([*texts.select("text_id", "lang").schema.fields, *StructType.fromDDL("row long, idx int, sentence int, token string, begin int, end int").fields])

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        for b in (x for whole in batches for x in sliced(whole, 2, SLICE_BYTES)):
            text, begin, end, ends, token = split(b.column(2))
            first = np.searchsorted(text, text)  # the first token of each one's text
            before = np.cumsum(ends) - ends
            at = pa.array(text)
            numbers = (base + text, (np.arange(len(text)) - first).astype(np.int32), (before - before[first]).astype(np.int32) if len(text) else before.astype(np.int32))
            columns = [b.column(0).take(at), b.column(1).take(at), *map(pa.array, numbers), token, pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))]
            base += b.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return texts.select("text_id", "lang", F.col("text").cast("string")).mapInArrow(run, schema)


#: Tokens of a sentence that are handed on as one array; a longer sentence has several rows.
PIECE_TOKENS = 64


def sentence_pieces(texts: DataFrame) -> DataFrame:
    """(text_id, lang, row, sentence, whole, tokens): the tokens (token, begin, end) of each sentence as arrays, numbered as in :func:`tokens`.

    A piece has ``PIECE_TOKENS`` tokens at most, so what is copied with an array stays in proportion to the text; ``whole`` says that a
    piece is all of its sentence.
    """
    schema = StructType([*texts.select("text_id", "lang").schema.fields, *StructType.fromDDL("row long, sentence int, whole boolean, tokens array<struct<token string, begin int, end int>>").fields])

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["tokens"].dataType)
        base = TaskContext.get().partitionId() << 33
        for b in (x for whole in batches for x in sliced(whole, 2, SLICE_BYTES)):
            text, begin, end, ends, token = _spaced(b.column(2))
            before = np.cumsum(ends) - ends
            fresh = np.r_[True, (np.diff(text) != 0) | ends[:-1]][: len(text)]  # the first token of each sentence
            start = np.flatnonzero(fresh)
            of = np.cumsum(fresh) - 1
            cut = np.flatnonzero((np.arange(len(text)) - start[of]) % PIECE_TOKENS == 0)
            single = np.bincount(of[cut], minlength=len(start)) == 1
            at = pa.array(text[cut])
            numbers = (base + text[cut], (before - before[np.searchsorted(text, text)])[cut].astype(np.int32), single[of[cut]])
            items = pa.StructArray.from_arrays([token, pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[cut, len(text)].astype(np.int32)), items, type=kind)
            base += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *map(pa.array, numbers), lists], names=schema.names)

    return texts.select("text_id", "lang", F.col("text").cast("string")).mapInArrow(run, schema)


#: The end of a sentence within white space, as :func:`_breaks` finds it; a sentence, up to its end and with the white space after it, or up to
#: the text's end; some of its tokens with the white space around them. Nothing is taken back once matched, so a text takes one pass.
_END = r"""[.!?]["')\]]*+"""
_SENTENCE = rf"[^.!?]*+(?:{_END}(?![ \t\n\x0B\f\r])[^.!?]*+)*+(?:{_END}[ \t\n\x0B\f\r]++|\z)"
_PIECE = rf"[ \t\n\x0B\f\r]*+(?:[^ \t\n\x0B\f\r]++[ \t\n\x0B\f\r]*+){{1,{PIECE_TOKENS}}}+"
#: Where each string of an array begins if they are joined. An array that grows is copied at each step, so it grows by blocks of 64.
_STARTS = (
    "aggregate(transform(sequence(0, (size({0}) - 1) div 64), k -> transform(slice({0}, k * 64 + 1, 64), x -> length(x))), "
    "named_struct('n', 0, 'at', cast(array() as array<array<int>>)), (a, block) -> named_struct('n', a.n + aggregate(block, 0, (n, x) -> n + x), "
    "'at', array_append(a.at, aggregate(block, named_struct('n', a.n, 'at', cast(array() as array<int>)), (b, x) -> named_struct('n', b.n + x, 'at', array_append(b.at, b.n)), b -> b.at))), "
    "a -> flatten(a.at))"
)


def _cut(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """rows for each match of a pattern whose matches cover the column: ``at`` (its number), ``of`` (how many there are), ``start`` and ``part``."""
    n = F.size("parts")
    found = rows.withColumn("parts", F.regexp_extract_all(column, F.lit(pattern), F.lit(0))).drop(column)
    starts = F.when(n == 1, F.array(F.lit(0))).when(n > 1, F.expr(_STARTS.format("parts"))).otherwise(F.array().cast("array<int>"))
    # what a row keeps stands below the generator, so that no part is copied with another one
    zipped = found.select(*found.columns, n.alias("of")).select(*found.drop("parts").columns, "of", F.arrays_zip("parts", starts.alias("starts")).alias("zipped"))
    each = zipped.select(*found.drop("parts").columns, "of", F.posexplode("zipped").alias("at", "x"))
    return each.select(*found.drop("parts").columns, "at", "of", F.col("x.starts").alias("start"), F.col("x.parts").alias("part"))


def sentence_strings(texts: DataFrame) -> DataFrame:
    """(text_id, lang, row, sentence, whole, begin, piece): the strings of sentences, with white space, numbered as in :func:`tokens`.

    A piece has ``PIECE_TOKENS`` tokens at most, so what is copied with it stays in proportion to the text; ``whole`` says that it is
    all of its sentence, ``begin`` where it begins in the text. Built-in functions only: no Python worker holds memory beside the executor's heap.
    """
    rows = texts.select("text_id", "lang", F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    found = _cut(rows, "text", _SENTENCE).select("text_id", "lang", "row", F.col("at").alias("sentence"), F.col("start").alias("first"), F.col("part").alias("string"))
    return _cut(found, "string", _PIECE).select("text_id", "lang", "row", "sentence", (F.col("of") == 1).alias("whole"), (F.col("first") + F.col("start")).alias("begin"), F.col("part").alias("piece"))


def sentences(texts: DataFrame) -> DataFrame:
    """(text_id, lang, row, sentence, begin, end) from the tokens' sentence numbers."""
    return tokens(texts).groupBy("text_id", "lang", "row", "sentence").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))


def lemmatised(rows: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """rows with lemma: from a (lang, form, lemma) table, else the lower-cased token."""
    lower = F.lower("token")
    if forms is None:
        return rows.withColumn("lemma", lower)
    table = forms.groupBy("lang", F.col("form").alias("_form")).agg(F.min("lemma").alias("_lemma"))
    joined = rows.withColumn("_form", lower).join(small(table), ["lang", "_form"], "left")
    return joined.withColumn("lemma", F.coalesce(F.when(F.col("_lemma") != "O", F.col("_lemma")), "_form")).drop("_form", "_lemma")


def tagged(rows: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """rows with ``tag`` from a (lang, form, pos) table, the least of several; null without a table or an entry.

    The table is the plug-in for taggers: any model's output over the distinct forms of a corpus has this form.
    """
    if tags is None:
        return rows.withColumn("tag", F.lit(None).cast("string"))
    table = tags.groupBy("lang", F.lower("form").alias("_form")).agg(F.min("pos").alias("tag"))
    return rows.withColumn("_form", F.lower("token")).join(small(table), ["lang", "_form"], "left").drop("_form")


def eligible(rows: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Tokens with a letter, of which neither the lower-cased form nor the lemma is a stopword."""
    words = small(stopwords.select("lang", F.col("word").alias("_w")).distinct())
    kept = rows.where(is_word(F.col("token"))).withColumn("_w", F.lower("token"))
    kept = kept.join(words, ["lang", "_w"], "left_anti").withColumn("_w", F.col("lemma"))
    return kept.join(words, ["lang", "_w"], "left_anti").drop("_w")


def stopword_tokens(rows: DataFrame, stopwords: DataFrame) -> DataFrame:
    words = small(stopwords.select("lang", F.col("word").alias("_w")).distinct())
    return rows.where(is_word(F.col("token"))).withColumn("_w", F.lower("token")).join(words, ["lang", "_w"], "left_semi").withColumnRenamed("_w", "word")


def term(token: Column) -> Column:
    """A token's letters, lower-cased."""
    return F.lower(F.regexp_replace(token, r"[^\p{L}]+", ""))


def contexts(texts: DataFrame, places: DataFrame, before: str = "<t>", after: str = "</t>") -> DataFrame:
    """places (text_id, sentence, begin, end) with ``context``: the place's sentence with the place between marks.

    A place names its text by text_id, which must be unique here. Raises where the text already holds a mark.
    """
    rows = places.join(sentences(texts).select("text_id", "sentence", F.col("begin").alias("_from"), F.col("end").alias("_to")), ["text_id", "sentence"])
    rows = rows.join(texts.select("text_id", "text"), "text_id")
    sentence = F.col("text").substr(F.col("_from") + 1, F.col("_to") - F.col("_from"))
    clean = F.when(F.contains("text", F.lit(before)) | F.contains("text", F.lit(after)), F.raise_error(F.lit("the text holds a mark")).cast("string")).otherwise(sentence)
    return rows.withColumn("context", marked(clean, F.col("begin") - F.col("_from"), F.col("end") - F.col("_from"), before, after)).drop("_from", "_to", "text")
