"""Substring dedup by suffix automata of reference shards.

A word is removed if a window of ``WINDOW`` consecutive words around it also starts in a document with a smaller
doc_id. The window is found by matching statistics: documents are streamed through the suffix automaton of reference
text, and every maximal match of at least ``WINDOW`` words is removed.

All documents are the reference of all, so shipping every automaton to every task would cost the square of the
corpus. Instead a reference shard holds what one anchor selects, and only text with that anchor is sent there:

1. The anchor of a window is the smallest hash of its 5-word grams, so equal windows have equal anchors. Anchors
   are counted (partial aggregation); those in one document only are dropped. A Bloom filter sized by their number holds the
   others and only saves shuffling.
2. Runs of windows with one repeated anchor go, with their words, to that anchor's shard. There they are streamed in ascending
   order of doc_id through the suffix automaton of the runs of all smaller documents: matching statistics first, then
   what is new extends the automaton. (A run that a smaller document has word for word matches as a whole and adds nothing.)
3. Anchors with many runs are split by document into parts, and the runs of the smallest document go to each part, so a
   shard's size is bounded by a document. Windows that no smaller document of the part holds can still be in one of another part: these
   windows, of split anchors only, are compared among themselves by a 128-bit hash: minimum id by aggregation, then a join that
   Spark can split when skewed.
4. The spans are joined to their documents; documents that no span can be in skip this join.

Defined cases: null and wordless texts have no windows; very long texts are read whole, their runs cut between windows; a null doc_id counts as larger than any other (such rows
remove nothing from each other); rows with equal doc_id don't remove from each other; repeats within one
document stay; windows are judged on the input; an empty table gives no rows; extra columns are ignored by
:func:`removals` and kept by :func:`without_repeats`.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, as_bytes, discard, kept, map_batches, mix64, prepared, release, sliced, split_words, spread, written

WINDOW, GRAM = 13, 5
_SPAN = WINDOW - GRAM + 1
#: Bloom filters: bits for each key, the exponents of the least and the most bits (64 MB, the bound of what is broadcast),
#: and the parts they are made in. A full filter lets everything through, which costs shuffling and changes no result.
KEY_BITS, LEAST_BITS, MOST_BITS, BLOOM_PARTS = 16, 20, 29, 1024
#: Runs of one anchor in a shard part. The anchors beyond it are broadcast, MOST_SPLIT of them at most (24 MB): from 2e9 runs on the
#: bound grows with the corpus.
PART_RUNS, MOST_SPLIT = 2_000, 1_000_000
#: Windows in one run at most.
RUN_WINDOWS = 64
_RNG = np.random.default_rng(20240501)
_MULT = _RNG.integers(1, 1 << 62, size=(3, WINDOW), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = re.compile(rb"[^ \t-\r]+")


class SuffixAutomaton:
    """Suffix automaton of a sequence of words (or any hashable items)."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, item) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur, p = len(nxt), self.last
        nxt.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p >= 0 and item not in nxt[p]:
            nxt[p][item] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][item]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(item) == q:
                    nxt[p][item] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        self.last = cur

    def extend(self, items, separator=None) -> SuffixAutomaton:
        """Add a sequence; no match reaches over the separator put after it."""
        for x in items:
            self.add(x)
        self.add((separator, len(self.next)))
        return self

    def matching_statistics(self, items) -> list[int]:
        """For each position, the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for x in items:
            while state and x not in nxt[state]:
                state = link[state]
                n = length[state]
            if x in nxt[state]:
                state = nxt[state][x]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def _keyed(docs: DataFrame) -> DataFrame:
    """(d, t, text): order of the document, hash of its text, text."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))


class Windows:
    """Windows of a batch of texts."""

    def __init__(self, texts: list[bytes | None]):
        self.words, self.codes, counts = split_words(texts)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.words], dtype=np.uint64)
        self.hash = hashes[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        self.begin = np.cumsum(counts) - counts
        self.doc = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(self.codes)) - self.begin[self.doc]
        #: Positions where a window starts.
        self.at = np.flatnonzero(place <= (counts - WINDOW)[self.doc])
        self.place = place

    def _rolling(self, k: int, mult: np.ndarray) -> np.ndarray:
        n = max(0, len(self.hash) - k + 1)
        total = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                total += self.hash[j : j + n] * mult[j]
        return mix64(total)

    def anchors(self) -> np.ndarray:
        """The anchor of each window."""
        m = self._rolling(GRAM, _MULT[0])
        if not len(self.at):
            return np.zeros(0, np.uint64)
        width = 1
        while 2 * width <= _SPAN:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < _SPAN:
            m = np.minimum(m[: len(m) - (_SPAN - width)], m[_SPAN - width :])
        return m[self.at]


class WindowHashes:
    """128-bit hashes of windows, as two signed longs; a worker remembers word hashes."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, spans: list[list[bytes]], at: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows at (span, place)."""
        if len(self.known) > 300_000:
            self.known.clear()
        known = self.known
        for w in {w for s in spans for w in s if w not in known}:
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.array([known[w] for s in spans for w in s], dtype=np.uint64)
        begin = np.cumsum([0, *map(len, spans)])
        where, n = np.array([begin[i] + p for i, p in at], dtype=np.int64), max(0, len(h) - WINDOW + 1)
        with np.errstate(over="ignore"):
            return tuple(mix64(sum(h[j : j + n] * _MULT[k][j] for j in range(WINDOW))).view(np.int64)[where] for k in (1, 2))


def bloom_bits(keys: int) -> int:
    """Exponent of the bits of a filter for so many keys."""
    return min(MOST_BITS, max(LEAST_BITS, (KEY_BITS * keys).bit_length()))


def bloom(keys: DataFrame, column: str) -> np.ndarray:
    """Bytes of a one-hash filter over a column of well-mixed longs, its size by their number."""
    bits = bloom_bits(keys.count())
    low = bits - BLOOM_PARTS.bit_length() + 1
    bit = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(1 << low, dtype=np.uint8)
        found[pdf["bit"].to_numpy() & ((1 << low) - 1)] = 1
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "data": [np.packbits(found, bitorder="little").tobytes()]})

    rows = keys.select(bit.alias("bit")).distinct().withColumn("part", F.shiftright("bit", low).cast("int"))
    out = np.zeros((BLOOM_PARTS, 1 << (low - 3)), dtype=np.uint8)
    for r in rows.groupBy("part").applyInPandas(packed, "part int, data binary").toLocalIterator():
        out[r.part] = np.frombuffer(bytes(r.data), dtype=np.uint8)
    return out.ravel()


def in_bloom(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys.view(np.uint64) & np.uint64(8 * len(filter_) - 1)
    return (filter_[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _repeated_anchors(rows: DataFrame) -> DataFrame:
    """(h, owner, n): anchors of more than one document, the smallest of these, and the runs."""

    def run(batches):
        for b in sliced(batches, 2, 2 << 20):
            w = Windows(as_bytes(b.column(2)))
            h, doc = w.anchors(), w.doc[w.at]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, np.int64)
            yield {"h": h[first].view(np.int64), "d": b.column(0).to_numpy()[doc[first]]}

    found = map_batches(rows, run, "h long, d long").groupBy("h").agg(F.min("d").alias("owner"), F.max("d").alias("last"), F.count("*").alias("n"))
    return kept(found.where("owner < last").select("h", "owner", "n"))


def _runs(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """(h, part, d, t, s, words, split): runs of windows whose anchor may be repeated, s the place of their first word."""
    spark = rows.sparkSession
    total = anchors.agg(F.sum("n")).first()[0] or 0
    bound = max(PART_RUNS, -(-total // MOST_SPLIT))
    split = sorted((r.h, r.owner, -(-r.n // bound)) for r in anchors.where(F.col("n") > bound).toLocalIterator())
    shipped = spark.sparkContext.broadcast((bloom(anchors, "h"), *(np.array([x[k] for x in split], dtype=np.int64) for k in range(3))))
    discard(anchors)  # all that is needed of them is in the broadcast

    def run(batches):
        filter_, keys, owners, parts = shipped.value
        for b in sliced(batches, 2, 2 << 20):
            d, t = b.column(0).to_numpy(), b.column(1).to_numpy()
            w = Windows(as_bytes(b.column(2)))
            h = w.anchors()
            some = np.flatnonzero(in_bloom(filter_, h)) if len(h) else np.zeros(0, np.int64)
            at, h = w.at[some], h[some].view(np.int64)
            if not len(at):
                continue
            new = np.r_[True, (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1) | (w.doc[at[1:]] != w.doc[at[:-1]])]
            start = np.flatnonzero(new)
            n = np.diff(np.r_[start, len(at)])
            pieces = -(-n // RUN_WINDOWS)  # long runs of one anchor are cut between windows
            ordinal = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = np.repeat(start, pieces) + ordinal * RUN_WINDOWS
            n = np.minimum(np.repeat(n, pieces) - ordinal * RUN_WINDOWS, RUN_WINDOWS) + WINDOW - 1
            h, at = h[first], at[first]
            doc = w.doc[at]
            part, copies, hot = np.zeros(len(h), dtype=np.int64), np.ones(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
            if len(keys):
                found = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hot = keys[found] == h
                many = np.where(hot, parts[found], 1)
                part = (mix64(d[doc].view(np.uint64)) % many.astype(np.uint64)).astype(np.int64)
                copies = np.where(hot & (owners[found] == d[doc]), many, 1)
            words, codes = w.words, w.codes
            text = [b" ".join([words[c] for c in codes[a : a + k].tolist()]) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
            rep = np.repeat(np.arange(len(h)), copies)
            turn = np.arange(len(rep)) - np.repeat(np.cumsum(copies) - copies, copies)
            yield {
                "h": h[rep],
                "part": np.where(copies[rep] > 1, turn, part[rep]),
                "d": d[doc[rep]],
                "t": t[doc[rep]],
                "s": w.place[at[rep]],
                "words": [text[i] for i in rep.tolist()],
                "split": hot[rep],
            }

    return map_batches(rows, run, "h long, part int, d long, t long, s int, words binary, split boolean")


class Shard:
    """The runs of one anchor, given in ascending order of documents."""

    def __init__(self):
        self.automaton, self.seen, self.queued = SuffixAutomaton(), set(), []
        self.document, self.waiting = None, []

    def matched(self, d: int, text: bytes) -> tuple[list[tuple[int, int]], list[int]]:
        """(maximal spans of text that runs of smaller documents hold, places of its windows that they don't)."""
        if d != self.document:  # what waited is of a smaller document now
            fresh = [t for t in dict.fromkeys(self.waiting) if t not in self.seen]
            self.seen.update(fresh)
            self.queued += fresh
            self.document, self.waiting = d, []
        self.waiting.append(text)
        words = text.split(b" ")
        if text in self.seen:
            return [(0, len(words))], []
        for t in self.queued:
            self.automaton.extend(t.split(b" "))
        self.queued = []
        return _spans(self.automaton.matching_statistics(words) if self.seen else [0] * len(words))


def _matched(runs: DataFrame) -> DataFrame:
    """(d, t, s, e, w1, w2): spans s..e that a smaller document of the shard holds; and other windows at s of split anchors, with e null."""
    dealt = runs.repartition(spread(runs), "h", "part").sortWithinPartitions("h", "part", "d")

    def run(batches):
        key, shard, hashes = None, Shard(), WindowHashes()
        for b in batches:
            held, single = [], []  # spans as (d, t, s, e); other windows as (d, t, s, number of the words, place in them)
            texts: list[list[bytes]] = []
            for h, part, d, t, s, text, split in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (h, part) != key:
                    key, shard = (h, part), Shard()
                spans, places = shard.matched(d, text)
                held += [(d, t, s + x, s + y) for x, y in spans]
                if split and places:
                    single += [(d, t, s + x, len(texts), x) for x in places]
                    texts.append(text.split(b" "))
            w1, w2 = hashes.of(texts, [x[3:] for x in single]) if single else ((), ())
            both = held + single
            none = np.full(len(held), 0)
            yield {
                "d": [x[0] for x in both],
                "t": [x[1] for x in both],
                "s": [x[2] for x in both],
                "e": [x[3] for x in held] + [None] * len(single),
                "w1": np.concatenate([none, w1]).astype(np.int64),
                "w2": np.concatenate([none, w2]).astype(np.int64),
            }

    return map_batches(dealt, run, "d long, t long, s int, e int, w1 long, w2 long")


def _spans(statistics: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """(maximal matched spans, places of the windows that aren't matched)."""
    spans: list[tuple[int, int]] = []
    places = []
    for end, n in enumerate(statistics):
        begin = end - WINDOW + 1
        if begin < 0:
            continue
        if n < WINDOW:
            places.append(begin)
        elif spans and begin <= spans[-1][1]:
            spans[-1] = (spans[-1][0], end + 1)
        else:
            spans.append((begin, end + 1))
    return spans, places


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(d, t, spans): the word spans to remove, by document."""
    prepared(docs.sparkSession)
    rows = _keyed(docs)
    runs = _runs(rows, _repeated_anchors(rows))
    release(docs.sparkSession)  # the anchors' shuffle
    matches = kept(_matched(runs))
    rest = matches.where("e is null")
    low = rest.groupBy("w1", "w2").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low < high").select("w1", "w2", "low")
    late = rest.join(low, ["w1", "w2"]).where("d > low").select("d", "t", "s", (F.col("s") + WINDOW).alias("e"))
    spans = matches.where("e is not null").select("d", "t", "s", "e").unionByName(late)
    # a written table, so that the shuffles behind the spans can go before whole texts are joined
    files = -(-rows.rdd.getNumPartitions() // 4)
    found = written(spans.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans")), "spans", files)
    discard(matches)
    return found


def _with_spans(docs: DataFrame) -> DataFrame:
    """docs (with columns d and t) and their spans; documents without any skip the join."""
    spans = repeated_spans(docs)
    own = docs.withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "t": F.xxhash64(F.col("text").cast("string"))})
    shipped = docs.sparkSession.sparkContext.broadcast(bloom(spans, "t"))
    at = own.columns.index("t")

    def marked(batches, wanted: bool):
        for b in batches:
            may = in_bloom(shipped.value, b.column(at).to_numpy().astype(np.int64))
            yield b.filter(pa.array(may == wanted))

    some = own.mapInArrow(lambda x: marked(x, True), own.schema)
    none = own.mapInArrow(lambda x: marked(x, False), own.schema)
    joined = some.join(spans, ["d", "t"], "left").select(*own.columns, "spans")
    return joined.unionByName(none.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))


def _removed(n: int, spans: list | None) -> np.ndarray:
    gone = np.zeros(n + 1, dtype=np.int64)
    for x in spans or ():
        gone[x["s"]] += 1
        gone[x["e"]] -= 1
    return np.cumsum(gone)[:n] > 0


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            n, gone, sha = [], [], []
            for text, spans in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                n.append(len(words))
                if spans:
                    out = _removed(len(words), spans)
                    words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                gone.append(n[-1] - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield {"doc_id": b.column(0), "n_words": n, "n_removed": gone, "kept_sha256": sha}

    return map_batches(_with_spans(rows).select("doc_id", "text", "spans"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(text: bytes, spans: list | None) -> bytes:
    """The text without the spans' words; what is kept keeps its own white space, with a space at each cut."""
    at = [m.span() for m in _WORD.finditer(text)]
    kept = np.flatnonzero(~_removed(len(at), spans))
    if not len(kept):
        return b""
    runs = np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1)
    return b" ".join(text[at[r[0]][0] : at[r[-1]][1]] for r in runs)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, their text without the repeated spans; n_chars, if there, follows the text."""
    own = docs.toDF(*[c if c in ("doc_id", "text", "n_chars") else f"_c{k}" for k, c in enumerate(docs.columns)])
    found = _with_spans(own).select(*own.columns, "spans")
    names, at = own.columns, own.columns.index("text")

    def run(batches):
        for b in batches:
            texts = [cut(t, s) if s and t else t for t, s in zip(as_bytes(b.column(at)), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            columns = [*b.columns[:at], pa.array(texts, type=pa.binary()).cast(b.schema.field(at).type), *b.columns[at + 1 : -1]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = found.mapInArrow(run, own.schema)
    if "n_chars" in own.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(own.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)
