"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark items.

Every benchmark word gets one symbol, so the automaton runs over words: a pattern is a window of ten
consecutive item words, or all words of a shorter item. Each document is scanned once; a match ends at a word,
whose byte offsets in the original text are known from the same word pattern.

There is one automaton for the whole benchmark, of any size up to ``MOST_BYTES`` of text: its items are broadcast, each Python
worker builds it once and keeps it for its later tasks, and every document is scanned once, without a shuffle. It takes
about 500 bytes a benchmark word; a larger benchmark is refused, not cut.

Defined cases: null or wordless texts have no words and no hits; null or wordless items have no windows; very long texts
are scanned whole; rows that repeat or tie on doc_id are judged each alone; items that repeat are listed by their distinct
item_id; an item whose item_id is null marks words as hit but isn't listed; an empty benchmark leaves everything clean; extra columns
are ignored by :func:`contamination` and kept by :func:`clean_documents`.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import as_bytes, doc_text, forget_encoders, map_batches, prepared

WINDOW = 10
#: Largest benchmark (bytes of text) that is broadcast.
MOST_BYTES = 64 << 20
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Code points for benchmark words start here; one below stands for any other word.
_FIRST = 0x10000

STATE = "hits array<int>, items array<string>"


def norm_words(text: bytes | None) -> list[bytes]:
    """Words after lower-casing A-Z; every byte of a non-ASCII character is part of a word."""
    return (text or b"").translate(_FOLD).split()


def word_offsets(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets of each word in the original text."""
    return [m.span() for m in WORD.finditer(text)]


class ItemAutomaton:
    """Windows of (item_id, text) items as one automaton; a window is a number, its items stand in flat arrays."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.symbols: dict[bytes, str] = {}
        self.names: list[str] = []
        named: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        lengths, windows, owners = [], [], []
        for item, text in items:
            coded = "".join([self.symbols.setdefault(w, chr(_symbol(len(self.symbols)))) for w in norm_words(text)])
            n = min(WINDOW, len(coded))
            if item is not None and item not in named:
                named[item] = len(self.names)
                self.names.append(item)
            for k in range(len(coded) - n + 1 if n else 0):
                window = coded[k : k + n]
                number = self.automaton.get(window, -1)
                if number < 0:
                    number = len(lengths)
                    self.automaton.add_word(window, number)
                    lengths.append(n)
                if item is not None:
                    windows.append(number)
                    owners.append(named[item])
        self.lengths = np.array(lengths, dtype=np.int32)
        order = np.lexsort((owners, windows)) if owners else np.zeros(0, np.int64)
        self.owners = np.array(owners, dtype=np.int32)[order]
        self.first = np.searchsorted(np.array(windows, dtype=np.int64)[order], np.arange(len(lengths) + 1))
        self.empty = not lengths
        if lengths:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Indices of the hit words, and the items."""
        if self.empty:
            return [], set()
        get, other = self.symbols.get, chr(_FIRST - 1)
        hit, items = set(), set()
        for end, number in self.automaton.iter("".join([get(w, other) for w in words])):
            hit.update(range(end - int(self.lengths[number]) + 1, end + 1))
            items.update(self.owners[self.first[number] : self.first[number + 1]].tolist())
        return sorted(hit), {self.names[k] for k in items}


def _symbol(k: int) -> int:
    """Code point of the k-th word: those from _FIRST on, and then the ones below it that aren't surrogates."""
    if k <= 0x10FFFF - _FIRST:
        return _FIRST + k
    k -= 0x110000 - _FIRST
    if k >= 0xF000:
        raise ValueError("the benchmark has more different words than there are symbols")
    return k + 1 if k < 0xD7FF else k + 0x801


_held: dict[str, ItemAutomaton] = {}


def held_automaton(key: str, items: list[tuple[str | None, bytes]]) -> ItemAutomaton:
    """The automaton of a broadcast, built once in a worker; one is kept at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = ItemAutomaton(items)
    return _held[key]


def _items(benchmark: DataFrame) -> list[tuple[str | None, bytes]]:
    """The distinct items; their size is checked before they are gathered."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > MOST_BYTES:
        raise ValueError(f"a benchmark of {total} bytes is over the bound of {MOST_BYTES}")
    return [(r.item_id, bytes(r.text)) for r in items.collect()]


def _scanned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the columns ``STATE`` added."""
    spark = prepared(docs.sparkSession)
    at, key = docs.columns.index("text"), uuid.uuid4().hex
    shipped = spark.sparkContext.broadcast(_items(benchmark))

    def run(batches):
        forget_encoders()
        automaton = held_automaton(key, shipped.value)
        for b in batches:
            found = [automaton.scan(norm_words(t)) for t in as_bytes(b.column(at))]
            state = [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([sorted(f[1]) for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *state], names=[*b.schema.names, "hits", "items"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(STATE).fields]))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items with occurring windows and whether any word is hit."""
    scanned = _scanned(doc_text(docs), benchmark)

    def run(batches):
        for b in batches:
            hits, items = b.column(2).to_pylist(), b.column(3).to_pylist()
            yield {
                "doc_id": b.column(0),
                "n_words": [len(norm_words(t)) for t in as_bytes(b.column(1))],
                "n_hit": [len(h) for h in hits],
                "n_items": [len(x) for x in items],
                "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items],
                "contaminated": [len(h) > 0 for h in hits],
            }

    return map_batches(scanned, run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def hit_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, begin, end, passage): maximal hit passages with character offsets in the original text."""
    scanned = _scanned(doc_text(docs), benchmark)

    def run(batches):
        for b in batches:
            rows = []
            for i, t, hits in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                if hits:
                    at, h = word_offsets(t), np.array(hits)
                    cuts = np.flatnonzero(np.diff(h) > 1) + 1
                    for run_ in np.split(h, cuts):
                        x, y = at[run_[0]][0], at[run_[-1]][1]
                        rows.append((i, len(t[:x].decode()), len(t[:y].decode()), t[x:y].decode()))
            yield dict(zip(("doc_id", "begin", "end", "passage"), zip(*rows) if rows else [[]] * 4, strict=True))

    return map_batches(scanned, run, "doc_id long, begin long, end long, passage string")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit word, with all their columns; no shuffle."""
    own = [f"_c{k}" if c != "text" else "text" for k, c in enumerate(docs.columns)]
    kept = _scanned(docs.toDF(*own), benchmark).where(F.size("hits") == 0).drop("hits", "items")
    return kept.toDF(*docs.columns)
