"""Token ids in Re-Pair compressed shards.

Documents are ordered by doc_id over range partitions; each write task encodes its texts and closes a shard every
``SHARD_TOKENS`` ids. A shard is compressed by Re-Pair: round by round the most frequent id pairs become
nonterminals (a round replaces many pairs at once, the more frequent pair winning where two overlap, and
no pair reaches over the end of a document), until no pair has ``LEAST`` places that don't overlap, or all symbols
of the shard's width are taken. The shard stores the rules and
the length of each rule's expansion, and for each document where its symbols and its ids begin, so that one
document or any slice of ids is decoded without the rest.

Layout of a shard (little-endian): magic ``RPS1``; uint32 symbol width (2 or 4 bytes), documents, rules, symbols,
first nonterminal; uint64 ids before this shard in its partition, ids in it; then the arrays doc_id (int64,
the smallest value for null), ids per document (uint32), symbols per document (uint32), left and right of each
rule (uint32), expansion length of each rule (uint32), symbols (uint16 or uint32).

Shards are the rows of a Parquet table in the shared folder, written by Spark's own committer, which works on
any file system and drops what lost or repeated tasks left behind.

Defined cases: null texts count as empty and have the end id alone; very long texts are encoded whole, and a document longer than
a shard is a shard of its own; null doc_ids come first; rows with equal doc_ids are ordered by a hash of their text; pairs of equal
count become rules in order of their hash; an empty table gives no shards; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, doc_text, map_batches, ranges, sliced, spread, written
from .textcode import encoder

END_ID = 2
SHARD_TOKENS = 1 << 19
ROUND_RULES, LEAST = 2000, 6
#: Chunks whose ids a worker remembers; beside its arrays it has room for more than other operators' workers.
KNOWN_CHUNKS = 1_000_000
_HEAD = struct.Struct("<4sIIIIIQQ")
_NULL = -(1 << 63)


def _frequent_pairs(key: np.ndarray, at: np.ndarray, next_: np.ndarray, rules: int, exact: bool):
    """(pairs from the most frequent on, their places in order, the number of the pair at each, places that later rounds need).

    key: the pair at each of the places ``at``, in ascending order. Pairs are counted in hashed buckets, each standing for one of its
    pairs; or, if exact, by sorting. A pair that is too rare now is never frequent later, as replacing only takes places away.
    """
    if exact:
        holder, h = np.unique(key, return_inverse=True)
        buckets = len(holder)
    else:
        buckets = max(1 << 12, min(1 << 18, 1 << len(key).bit_length()))  # few enough for a core's cache
        h = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - buckets.bit_length())).astype(np.int64)
    counts = np.bincount(h, minlength=buckets)
    often = counts[counts >= LEAST]
    least = max(LEAST, int(np.partition(often, -rules)[-rules])) if len(often) > rules else LEAST
    live = at[(counts >= LEAST)[h]]
    some = np.flatnonzero((counts >= least)[h])
    key, at, h = key[some], at[some], h[some]
    if not exact:
        holder = np.zeros(buckets, dtype=np.int64)
        holder[h] = key  # one pair stands for a bucket; another pair in it waits for a later round
        own = holder[h] == key
        key, at, h = key[own], at[own], h[own]
    # in a run of one pair, every second place overlaps the one before
    change = np.append(True, (next_[at[:-1]] != at[1:]) | (key[1:] != key[:-1])) if len(at) else np.ones(0, dtype=bool)
    if not change.all():
        change = np.flatnonzero(change)
        apart = (np.arange(len(at)) - np.repeat(change, np.diff(change, append=len(at)))) & 1 == 0
        at, h = at[apart], h[apart]
    counts = np.bincount(h, minlength=buckets)
    found = np.flatnonzero(counts >= LEAST)
    found = found[np.argsort(-counts[found], kind="stable")][:rules]
    rank = np.full(buckets, -1, dtype=np.int64)
    rank[found] = np.arange(len(found))
    mine = rank[h]
    return holder[found], at[mine >= 0], mine[mine >= 0], live


def _merged(n: int, *places: np.ndarray) -> np.ndarray:
    """Distinct places of a sequence of n, in order."""
    if 16 * sum(map(len, places)) < n:
        x = np.sort(np.concatenate(places))
        return x[np.append(True, x[1:] != x[:-1])] if len(x) else x
    found = np.zeros(n, dtype=bool)
    for p in places:
        found[p] = True
    return np.flatnonzero(found)


def re_pair(ids: np.ndarray, last: np.ndarray, first_free: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, their ``last`` flags, left, right) of ids; last marks the end of each document.

    Symbols stay in place and know their neighbours; a round looks only at places where a pair can still be frequent: those that
    were frequent before, and those beside a replacement.
    """
    n = len(ids)
    seq, last = ids.astype(np.int32), last.copy()
    next_, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    alive, at = np.ones(n, dtype=bool), np.flatnonzero(~last)
    none_ = 1 << 30
    prior = np.full(n + 1, none_, dtype=np.int32)  # the last one stands for no neighbour, on either side
    left, right = [], []
    made, exact = 0, False
    while made < limit:
        pairs, at, mine, live = _frequent_pairs(seq[at].astype(np.int64) << 32 | seq[next_[at]], at, next_, min(ROUND_RULES, limit - made), exact)
        if not len(pairs):
            if exact:
                break
            exact, at = True, live  # hashing may hide a pair behind another one
            continue
        # where pairs overlap the more frequent one wins; in a run of one pair every second place is left out already
        prior[at] = mine
        chosen = (mine < prior[before[at]]) & (mine < prior[next_[at]])
        prior[at] = none_
        at, mine = at[chosen], mine[chosen]
        good = np.bincount(mine, minlength=len(pairs)) >= LEAST
        new = np.cumsum(good) - 1 + made
        left.append(pairs[good] >> 32)
        right.append(pairs[good] & 0xFFFFFFFF)
        made += int(good.sum())
        at, mine = at[good[mine]], mine[good[mine]]
        gone = next_[at]
        seq[at] = first_free + new[mine]
        last[at] = last[gone]
        alive[gone] = False
        after = next_[gone]
        next_[at] = after
        inside = after < n
        before[after[inside]] = at[inside]
        beside = before[at]
        at = _merged(n, live, at, beside[beside >= 0])
        at = at[alive[at] & ~last[at]]
    none = np.zeros(0, dtype=np.int64)
    return seq[alive].astype(np.int64), last[alive], np.concatenate(left) if left else none, np.concatenate(right) if right else none


def expansions(left: np.ndarray, right: np.ndarray, first_free: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, start, length): the ids that each symbol stands for; terminals stand for themselves."""
    flat = [np.arange(first_free, dtype=np.int64)]
    n = first_free + len(left)
    start, length = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
    start[:first_free] = flat[0]
    done, used = first_free, first_free
    while done < n:  # a rule names earlier symbols only; all rules over what is expanded come at once
        later = np.flatnonzero(np.maximum(left[done - first_free :], right[done - first_free :]) >= done)
        upto = done + (int(later[0]) if len(later) else n - done)
        both = np.stack([left[done - first_free : upto - first_free], right[done - first_free : upto - first_free]], axis=1).ravel()
        everything = np.concatenate(flat)
        flat = [everything, everything[ranges(start[both], length[both])]]
        length[done:upto] = length[both].reshape(-1, 2).sum(1)
        start[done:upto] = used + np.cumsum(length[done:upto]) - length[done:upto]
        used += int(length[done:upto].sum())
        done = upto
    return np.concatenate(flat), start, length


def pack_shard(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray, before: int, vocabulary: int) -> bytes:
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(lengths) - 1] = True
    width = 2 if vocabulary < 60_000 else 4
    symbols, ends, left, right = re_pair(ids, last, vocabulary, (1 << 16) - vocabulary if width == 2 else 1 << 20)
    _, _, length = expansions(left, right, vocabulary)
    per_doc = np.diff(np.flatnonzero(ends), prepend=-1)
    head = _HEAD.pack(b"RPS1", width, len(lengths), len(left), len(symbols), vocabulary, before, len(ids))
    numbers = np.array([_NULL if i is None else i for i in doc_ids], dtype="<i8")
    arrays = [numbers, lengths.astype("<u4"), per_doc.astype("<u4"), left.astype("<u4"), right.astype("<u4"), length[vocabulary:].astype("<u4"), symbols.astype(f"<u{width}")]
    return b"".join([head, *(a.tobytes() for a in arrays)])


class Shard:
    """A shard's bytes, read without decoding its symbols."""

    def __init__(self, data: bytes):
        magic, width, docs, rules, symbols, self.first_free, self.before, self.n_tokens = _HEAD.unpack_from(data)
        if magic != b"RPS1":
            raise ValueError("not a shard")
        at = _HEAD.size
        found = []
        for n, kind in ((docs, "<i8"), (docs, "<u4"), (docs, "<u4"), (rules, "<u4"), (rules, "<u4"), (rules, "<u4"), (symbols, f"<u{width}")):
            found.append(np.frombuffer(data, dtype=kind, count=n, offset=at))
            at += found[-1].nbytes
        ids, self.lengths, self.symbols_per_doc, left, right, self.rule_lengths, self.symbols = found
        self.doc_ids = [None if i == _NULL else int(i) for i in ids]
        self.left, self.right = left.astype(np.int64), right.astype(np.int64)
        self.lengths = self.lengths.astype(np.int64)

    def all_ids(self) -> np.ndarray:
        flat, start, length = expansions(self.left, self.right, self.first_free)
        s = self.symbols.astype(np.int64)
        return flat[ranges(start[s], length[s])]

    def _expand(self, symbol: int, out: list[int]):
        stack = [symbol]
        while stack:
            s = stack.pop()
            if s < self.first_free:
                out.append(s)
            else:
                stack += [int(self.right[s - self.first_free]), int(self.left[s - self.first_free])]

    def document(self, k: int, begin: int = 0, end: int | None = None) -> list[int]:
        """Ids begin to end of the k-th document; only the symbols that cover them are expanded."""
        first = int(self.symbols_per_doc[:k].sum(dtype=np.int64))
        s = self.symbols[first : first + int(self.symbols_per_doc[k])].astype(np.int64)
        nonterminal = s >= self.first_free
        length = np.ones(len(s), dtype=np.int64)
        length[nonterminal] = self.rule_lengths[s[nonterminal] - self.first_free]
        ends = np.cumsum(length)
        end = int(ends[-1]) if end is None else min(end, int(ends[-1]))
        if begin >= end:
            return []
        lo, hi = int(np.searchsorted(ends, begin, side="right")), int(np.searchsorted(ends, end, side="left")) + 1
        out: list[int] = []
        for x in s[lo:hi].tolist():
            self._expand(x, out)
        skip = begin - int(ends[lo] - length[lo])
        return out[skip : skip + end - begin]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The table (part, seq, n_tokens, data) of shards of docs in ascending doc_id order."""
    rows = doc_text(docs).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(spread(docs), F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def run(batches):
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), encoder(tokenizer, KNOWN_CHUNKS)
        vocabulary = max(coder.tokenizer.get_vocab_size(), end_id + 1)
        held, size, before, seq = [], 0, 0, 0

        def closed():
            nonlocal held, size, before, seq
            numbers, ids, lengths = [i for h in held for i in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            data = pack_shard(numbers, ids, lengths, before, vocabulary)
            out = {"part": [part], "seq": [seq], "n_tokens": [len(ids)], "data": [data]}
            held, size, before, seq = [], 0, before + len(ids), seq + 1
            return out

        for b in sliced(batches, limit=14 << 20):
            ids, lengths = coder.encode(as_bytes(b.column(1)))
            ends = np.cumsum(lengths)
            ids, lengths = np.insert(ids, ends, end_id), lengths + 1
            numbers, stops = b.column(0).to_pylist(), np.cumsum(lengths)
            at = 0
            while at < len(lengths):  # documents at..upto fill this shard
                base = int(stops[at] - lengths[at])
                upto = max(at + 1, int(np.searchsorted(stops, base + shard_tokens - size, side="right")))
                held.append((numbers[at:upto], ids[base : int(stops[upto - 1])], lengths[at:upto]))
                size += int(stops[upto - 1]) - base
                at = upto
                if size >= shard_tokens or at < len(lengths):
                    yield closed()
        if held:
            yield closed()

    run.encodes = True
    return written(map_batches(ordered, run, "part int, seq int, n_tokens long, data binary"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the shards alone: doc_id, start, n_tokens, ids_crc32."""
    spark = shards.sparkSession
    # one row for each write task; ranges of doc_id ascend with the task's number
    totals = {r.part: r.n for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]
    shipped = spark.sparkContext.broadcast(base)

    def run(batches):
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = Shard(data.as_py())
                ids, ends = shard.all_ids().astype("<u4"), np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                yield {
                    "doc_id": shard.doc_ids,
                    "start": begins + (shipped.value[part] + shard.before),
                    "n_tokens": shard.lengths,
                    "ids_crc32": [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(begins, ends, strict=True)],
                }

    return map_batches(shards.select("part", "data"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


