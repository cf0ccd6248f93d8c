"""Token counts by distinct pre-tokens.

A tokenizer's pieces of a pre-token depend on nothing around it, so they are counted once per distinct
pre-token. A first pass finds the frequent pre-tokens (each task names its ``TASK_TOP`` most frequent); at most
``HOT`` of them, counted once, are broadcast, and a task adds them up for its documents. What is left are
rarer pre-tokens with their frequencies in each document: they are shuffled by pre-token, where each
distinct one is counted once and joined to its documents' frequencies, and then summed by document. Which
way a pre-token takes changes nothing in the sums. No ids are kept.

Special strings, and white space that tokenizers treat differently, matter only up to the next plain space between
two characters that aren't white space: a text with such things is cut there, and only the parts that hold them are
counted by the library as they are, like a pre-token each. Only for tokenizers that aren't byte-level ones, or have special strings with
spaces, whole texts take the place of pre-tokens.

Defined cases: very long texts are read whole; a count of exactly the limit isn't over it; null texts are empty (0 bytes, 0 tokens); repeated rows and doc_ids are rows of their own; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, doc_text, kept, map_batches, prepared, ranges, spread
from .sampling import most_frequent
from .textcode import _MARKS, _PLAIN, _SPACE, encoder, odd

LIMIT_TOKENS = 512
HOT, TASK_TOP = 200_000, 60_000
#: Times a chunk stands in a batch before its pre-tokens are thought of as frequent.
OFTEN = 3
#: Longest pre-token (bytes) that is broadcast.
HOT_BYTES = 64
#: The byte-level pre-token pattern for ASCII text; other text is split by the library. Fixed values.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
_WORD = _PLAIN["led"].fullmatch
#: A space that nothing can reach over.
_PLAIN_SPACE = re.compile(r"(?<=\S) (?=\S)")
_ROW = b"\xff"  # starts the key of a document's own row; no UTF-8 text holds it


class PreTokens:
    """Splits chunks into pre-tokens; a worker remembers ``limit`` chunks."""

    def __init__(self, path: str, limit: int = 400_000):
        self.coder, self.limit, self.known = encoder(path), limit, {}

    def of(self, chunk: bytes) -> tuple[bytes, ...]:
        found = self.known.get(chunk)
        if found is None:
            if len(self.known) > self.limit:
                self.known.clear()
            if _WORD(chunk):
                found = (chunk,)
            elif chunk[-1:] in _MARKS and _WORD(chunk[:-1]):
                found = (chunk[:-1], chunk[-1:])
            elif chunk.isascii():
                text = chunk.decode()
                found = tuple(x.encode() for x in _ASCII.findall(text))
            else:
                text = chunk.decode()
                found = tuple(text[a:b].encode() for _, (a, b) in self.coder.tokenizer.pre_tokenizer.pre_tokenize_str(text))
            self.known[chunk] = found
        return found

    def cut(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        return self.coder._pieces(texts)

    def apart(self, text: bytes) -> bool:
        return self.coder.kind != "led" or odd(text)

    def segments(self, text: bytes) -> tuple[list[bytes], list[bytes]]:
        """(parts of an odd text that may be cut as usual, parts that the library must see as they are)."""
        if self.coder.kind != "led" or any(" " in t.content for t in self.coder.tokenizer.get_added_tokens_decoder().values()):
            return [], [text]
        usual, strange, held = [], [], []
        for k, part in enumerate(_PLAIN_SPACE.split(text.decode())):
            part = (" " * (k > 0) + part).encode()
            if odd(part):
                strange.append(part)
                if held:
                    usual.append(b"".join(held))
                held = []
            else:
                held.append(part)
        return (usual + [b"".join(held)] if held else usual), strange

    def counts(self, pre_tokens: list[bytes]) -> np.ndarray:
        """Pieces of each pre-token."""
        out = np.zeros(len(pre_tokens), dtype=np.int64)
        strange = np.array([self.apart(p) for p in pre_tokens], dtype=bool)
        out[strange] = [len(x) for x in self.coder._library([p for p, x in zip(pre_tokens, strange.tolist(), strict=True) if x])]
        led = np.array([p[:1] in _SPACE and p[-1:] not in _SPACE and not p.strip() == b"" for p in pre_tokens], dtype=bool)
        for group in (np.flatnonzero(led & ~strange), np.flatnonzero(~led & ~strange)):
            for k in range(0, len(group), 2000):
                at = group[k : k + 2000]
                out[at] = self.coder._encode_chunks([pre_tokens[i] for i in at])[0]
        return out


def frequent(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(pre_token, n): the most frequent pre-tokens of the corpus, HOT of them at most."""

    def run(batches):
        splitter, seen = PreTokens(tokenizer), Counter()
        for b in batches:
            distinct, codes, _ = splitter.cut([t for t in as_bytes(b.column(1)) if t and not splitter.apart(t)])
            counts = np.bincount(codes, minlength=len(distinct))
            for k in np.flatnonzero(counts >= OFTEN).tolist():
                for p in splitter.of(distinct[k]):
                    if len(p) <= HOT_BYTES:
                        seen[p] += int(counts[k])
            if len(seen) > 8 * TASK_TOP:
                seen = Counter(dict(seen.most_common(4 * TASK_TOP)))
        top = seen.most_common(TASK_TOP)
        yield {"pre_token": [p.decode() for p, _ in top], "n": [n for _, n in top]}

    run.encodes = True
    named = map_batches(doc_text(docs), run, "pre_token string, n long")
    return most_frequent(kept(named.groupBy("pre_token").agg(F.sum("n").alias("n"))), "n", HOT)


def token_counts(docs: DataFrame, tokenizer: str, limit_tokens: int = LIMIT_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every document."""
    spark = prepared(docs.sparkSession)
    names = [r.pre_token.encode() for r in frequent(docs, tokenizer).select("pre_token").toLocalIterator()]
    shipped = spark.sparkContext.broadcast((names, PreTokens(tokenizer).counts(names).astype(np.int32)))

    def frequencies(batches):
        """A row for each document, and one for each rarer pre-token of a document."""
        from pyspark import TaskContext

        splitter = PreTokens(tokenizer)
        hot = dict(zip(shipped.value[0], shipped.value[1].tolist(), strict=True))
        resolved: dict[bytes, tuple[int, tuple[bytes, ...]]] = {}
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            texts = [t or b"" for t in as_bytes(b.column(1))]
            pieces, owner, strange, owner_of_strange = [], [], [], []
            for i, t in enumerate(texts):
                usual, others = splitter.segments(t) if splitter.apart(t) else ([t], [])
                pieces += usual
                owner += [i] * len(usual)
                strange += others
                owner_of_strange += [i] * len(others)
            distinct, codes, counts = splitter.cut(pieces) if pieces else ([], np.zeros(0, np.int64), np.zeros(0, np.int64))
            doc_of = np.concatenate([np.repeat(np.array(owner, dtype=np.int64), counts), np.array(owner_of_strange, dtype=np.int64)])
            first = {c: len(distinct) + k for k, c in enumerate(dict.fromkeys(strange))}
            codes = np.concatenate([codes, np.array([first[c] for c in strange], dtype=np.int64)])
            n_usual, distinct = len(distinct), [*distinct, *first]
            if len(resolved) > splitter.limit:
                resolved.clear()
            own, rare, at = np.zeros(len(distinct), dtype=np.int64), [], np.zeros(len(distinct) + 1, dtype=np.int64)
            for k, chunk in enumerate(distinct):
                found = resolved.get(chunk)
                if found is None:
                    parts = splitter.of(chunk) if k < n_usual else (chunk,)
                    found = resolved[chunk] = (sum(hot.get(p, 0) for p in parts), tuple(p for p in parts if p not in hot))
                own[k] = found[0]
                rare += found[1]
                at[k + 1] = len(rare)
            known = np.bincount(doc_of, weights=own[codes], minlength=len(texts)).astype(np.int64)
            # occurrences of rarer pre-tokens: (document, number of the pre-token), counted
            some = np.flatnonzero(np.diff(at)[codes])
            n_rare = np.diff(at)[codes[some]]
            number: dict[bytes, int] = {}
            names_ = np.array([number.setdefault(p, len(number)) for p in rare], dtype=np.int64)
            which = names_[ranges(at[codes[some]], n_rare)] if len(some) else np.zeros(0, np.int64)
            key, freq = np.unique(np.repeat(doc_of[some], n_rare) * max(1, len(number)) + which, return_counts=True)
            n = max(1, len(number))
            rows = np.arange(len(texts)) + row
            row += len(texts)
            none = pa.nulls(len(key), pa.int64())
            yield {
                "k": pa.concat_arrays([pa.array([_ROW + r.tobytes() for r in rows], pa.binary()), pa.array(list(number), pa.binary()).take(pa.array(key % n))]),
                "row": np.concatenate([rows, rows[key // n]]),
                "doc_id": pa.concat_arrays([b.column(0), none]),
                "n_bytes": pa.concat_arrays([pa.array([len(t) for t in texts], pa.int64()), none]),
                "n": np.concatenate([known, freq]),
            }

    def joined(batches):
        splitter, known = PreTokens(tokenizer), {}
        for b in batches:
            keys = b.column(0).dictionary_encode()
            distinct = keys.dictionary.to_pylist()
            if len(known) > splitter.limit:
                known.clear()
            fresh = [p for p in distinct if p[:1] != _ROW and p not in known]
            known.update(zip(fresh, splitter.counts(fresh).tolist(), strict=True))
            times = np.array([1 if p[:1] == _ROW else known[p] for p in distinct], dtype=np.int64)
            yield {"row": b.column(1), "doc_id": b.column(2), "n_bytes": b.column(3), "n": times[keys.indices.to_numpy()] * b.column(4).to_numpy()}

    frequencies.encodes = joined.encodes = True
    fields = "row long, doc_id long, n_bytes long, n long"
    rows = map_batches(doc_text(docs), frequencies, "k binary, " + fields)
    dealt = rows.repartition(spread(docs), "k")
    each = map_batches(dealt, joined, fields)
    total = each.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit_tokens).alias("over_limit"))
