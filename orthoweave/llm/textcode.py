"""Token ids of whole texts by the tokenizers library, with pieces remembered.

For the two pre-tokenizers known here a text can be cut at white space without changing any id, so a worker
encodes each distinct chunk once through the library and then only looks it up. Texts with anything that
might reach over such a cut (special strings, rarer white space) and tokenizers of another make go to the
library whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ranges, split_words, sums

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_ODD = re.compile(rb"<\||[\x0b\x0c\x1c-\x1f\x01\x02]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: What every longer match of ``_ODD`` begins with: most texts hold none, and a search for fixed bytes is fast.
_ODD_LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_CONTROL = bytes(range(0x1C, 0x20)) + b"\x0b\x0c\x01\x02"
_SPACE = (b" ", b"\t", b"\r", b"\n")
_MARKS = (b".", b",")
#: What a tail of marks may hold that is one pre-token after letters: ASCII but the apostrophe, which can begin a pre-token with letters.
_TAIL = np.isin(np.arange(256), list(rb"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""))
#: Words of Latin letters, one pre-token each and the same after normalising (in lower case where that is done).
_PLAIN = {
    "led": re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+"),
    "apart": re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+"),
}
_BYTES = np.arange(256)
#: By kind: bytes that are letters alone, those that follow 0xC3 in a letter, and bytes that lead any two-byte letter.
_ALONE = {"led": np.isin(_BYTES, list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")), "apart": np.isin(_BYTES, list(b"abcdefghijklmnopqrstuvwxyz"))}
_AFTER_C3 = {"led": np.isin(_BYTES, [*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]), "apart": np.isin(_BYTES, [*range(0x9F, 0xB7), *range(0xB8, 0xC0)])}
_LEADS = {"led": (_BYTES >= 0xC4) & (_BYTES <= 0xC8), "apart": np.zeros(256, dtype=bool)}
_LED = re.compile(rb"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")


def has_runs(t: bytes) -> bool:
    """Whether any white-space character doesn't stand alone, or is neither a space nor a line end."""
    return b"  " in t or b" \n" in t or b"\n " in t or b"\n\n" in t or b"\t" in t or b"\r" in t


def _letters(chunks: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all chunks, the place of each one's last byte, its bytes but a leading space, those of them that are in no letter)."""
    sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
    data = np.frombuffer(b"".join(chunks), dtype=np.uint8)
    if not len(data):
        return np.zeros(1, dtype=np.uint8), sizes, sizes, sizes
    after = np.append(data[1:], np.uint8(0))
    first = (data == 0xC3) & _AFTER_C3[kind][after] | _LEADS[kind][data]
    letter = _ALONE[kind][data] | first
    letter[1:] |= first[:-1]
    wrong = np.append(0, np.cumsum(~letter))
    ends = np.cumsum(sizes)
    begins = np.minimum(ends - sizes, len(data) - 1)
    led = (data[begins] == 32) & (sizes > 0) if kind == "led" else np.zeros(len(chunks), dtype=bool)
    return data, np.maximum(ends - 1, 0), sizes - led, wrong[ends] - wrong[ends - sizes] - led


def words_and_marked(chunks: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Which chunks are words of letters as ``_PLAIN`` has them, and which are such a word and one closing mark."""
    data, last, size, bad = _letters(chunks, kind)
    mark = np.isin(data[last], [m[0] for m in _MARKS])
    return (bad == 0) & (size > 0), mark & (bad == 1) & (size > 1)


def words_and_tails(chunks: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Which chunks are words of letters, and how many bytes of marks follow the word in those that are a word and marks (else 0).

    The marks are one closing mark where words are led by white space, and any number of ``_TAIL`` where it is dropped.
    """
    if kind == "led":
        plain, marked = words_and_marked(chunks, kind)
        return plain, marked.astype(np.int64)
    data, last, size, bad = _letters(chunks, kind)
    tail = np.minimum(last - np.maximum.accumulate(np.where(_TAIL[data], -1, np.arange(len(data))))[last], size)
    return (bad == 0) & (size > 0), np.where((bad == tail) & (size > tail), tail, 0)


def odd(text: bytes) -> bool:
    """Whether a cut at white space could change ids."""
    return _leads_to_odd(text) and _ODD.search(text) is not None


def _leads_to_odd(text: bytes) -> bool:
    """Whether a text, or one of several joined by line ends, can be odd."""
    if b"<|" in text or len(text.translate(None, _CONTROL)) != len(text):
        return True
    return not text.isascii() and any(map(text.__contains__, _ODD_LEADS))


def _byte_alphabet() -> dict[int, int]:
    """Byte to the character that stands for it in byte-level vocabularies; a line end becomes the space between words.

    The rule is public: printable bytes stand for themselves, the others take the characters from U+0100 on in order.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)} | {10: 32}


_ALPHABET = _byte_alphabet()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts; ``limit`` chunks are remembered before the memory starts anew."""

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        spec = json.loads(open(path, encoding="utf-8").read())
        pre, steps = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not steps:
            self.kind = "led"  # a word keeps the white space before it
            units = sorted(spec["model"]["vocab"].items(), key=lambda x: x[1])
            self.unit_bytes = np.array([len(u) for u, _ in units], dtype=np.int64)
        elif "Replace" in str(steps) and "Lowercase" in str(steps) and str((pre.get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex", "")).endswith("[^\\s\\p{L}\\p{N}]+"):
            self.kind = "apart"  # white space is dropped
            self.mark = self.tokenizer.encode("\x01", add_special_tokens=False).ids
            if len(self.mark) != 1:
                self.kind = "whole"
        if self.kind != "whole":
            # words of letters are one pre-token each: the model alone does for them
            self.model = Tokenizer.from_file(path)
            self.model.normalizer = None
            self.model.pre_tokenizer = WhitespaceSplit()
            names = sorted(self.model.get_vocab().items(), key=lambda x: x[1])
            self.unit_ends = np.array([n.endswith("</w>") for n, _ in names], dtype=bool)
        self._forget()

    def _forget(self, keep: int = 0):
        """Keeps the chunks met first, which are the frequent ones."""
        if keep:
            self.known = dict(islice(self.known.items(), keep))
            old, index = self.flat, np.arange(keep)
            ids = old[ranges(self.start[:keep], self.length[:keep])]
            lengths, self.used = self.length[:keep].copy(), 0
            self._store(index, lengths, ids)
            return
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.start, self.length = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)

    def _library(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _joined(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _store(self, at: np.ndarray, lengths: np.ndarray, ids: np.ndarray):
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while at.max(initial=-1) >= len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[at] = lengths
        self.start[at] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)

    def _encode_plain(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = b"\n".join(chunks).decode("latin-1").translate(_ALPHABET)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
        if self.kind == "led":
            ends = np.searchsorted(np.cumsum(self.unit_bytes[ids]), np.cumsum([len(c) for c in chunks]), side="left") + 1
        else:
            ends = np.flatnonzero(self.unit_ends[ids]) + 1
        lengths = np.diff(ends, prepend=0)
        return (lengths, ids) if len(lengths) == len(chunks) else self._encode_chunks(chunks)

    def _encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of chunks that hold no white space but at their start."""
        if self.kind == "apart":
            ids = np.array(self._joined((b" \x01 ".join(chunks)).decode()), dtype=np.uint32)
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids))
            lengths = np.diff(ends, prepend=-1) - 1
            if len(lengths) == len(chunks):
                return lengths, ids[ids != self.mark[0]]
        elif all(c[:1] in _SPACE and c[-1:] not in _SPACE for c in chunks):
            ids = np.array(self._joined(b"".join(chunks).decode()), dtype=np.uint32)
            ends = np.searchsorted(np.cumsum(self.unit_bytes[ids]), np.cumsum([len(c) for c in chunks]), side="left") + 1
            return np.diff(ends, prepend=0), ids
        each = self._library(chunks)
        return np.array([len(x) for x in each], dtype=np.int64), np.array([i for x in each for i in x], dtype=np.uint32)

    def _pieces(self, texts: list[bytes], runs: bool | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct chunks, their numbers in order, and chunks a text, of texts that may be cut."""
        if self.kind == "apart":
            return split_words(texts, lower=True)
        if runs is False or runs is None and not any(map(has_runs, texts)):  # every piece keeps the white space before it
            split = pc.split_pattern(pa.array([t.replace(b" ", b"\x02 ").replace(b"\n", b"\x02\n") for t in texts], type=pa.binary()), b"\x02")
            flat = split.flatten().dictionary_encode()
            return flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int64), pc.list_value_length(split).to_numpy().astype(np.int64)
        number: dict[bytes, int] = {}
        chunks = [_LED.findall(t) for t in texts]
        codes = np.array([number.setdefault(c, len(number)) for x in chunks for c in x], dtype=np.int64)
        return list(number), codes, np.array([len(x) for x in chunks], dtype=np.int64)

    def _numbers(self, chunks: list[bytes]) -> np.ndarray:
        """Numbers of distinct chunks among those known, after the library has encoded the new ones."""
        known, first = self.known, len(self.known)
        numbers = np.fromiter(map(known.get, chunks, repeat(-1)), dtype=np.int64, count=len(chunks))
        unknown = np.flatnonzero(numbers < 0)
        if not len(unknown):
            return numbers
        fresh = [chunks[i] for i in unknown.tolist()]
        numbers[unknown] = first + np.arange(len(unknown))
        known.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        plain, tails = words_and_tails(fresh, self.kind)
        # letters and the marks after them are two pre-tokens: the ids of both in turn
        split = np.flatnonzero(tails)
        cuts = list(zip(split.tolist(), tails[split].tolist(), strict=True))
        stems, marks = [fresh[i][:-n] for i, n in cuts], [fresh[i][-n:] for i, n in cuts]
        more = [c for c in dict.fromkeys(stems + marks) if c not in known]
        known.update(zip(more, range(len(known), len(known) + len(more)), strict=True))
        if more:
            plain, tails = np.append(plain, words_and_tails(more, self.kind)[0]), np.append(tails, np.zeros(len(more), dtype=np.int64))
            fresh += more
        groups = [(np.flatnonzero(plain), self._encode_plain)]
        rest = (tails == 0) & ~plain
        if self.kind == "led":  # only chunks that start with white space can be joined for one call
            inner = np.zeros(len(fresh), dtype=bool)
            inner[rest] = [c[:1] in _SPACE and c[-1:] not in _SPACE for c in (fresh[i] for i in np.flatnonzero(rest).tolist())]
            groups += [(np.flatnonzero(inner), self._encode_chunks), (np.flatnonzero(rest & ~inner), self._encode_chunks)]
        else:
            groups += [(np.flatnonzero(rest), self._encode_chunks)]
        for group, encode in groups:
            for k in range(0, len(group), 2000):
                at = group[k : k + 2000]
                self._store(first + at, *encode([fresh[i] for i in at.tolist()]))
        if len(split):
            both = np.array([list(map(known.__getitem__, stems)), list(map(known.__getitem__, marks))], dtype=np.int64).T
            lengths = self.length[both]
            ids = self.flat[ranges(self.start[both.ravel()], lengths.ravel())]
            self._store(first + split, lengths.sum(1), ids)
        return numbers

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order as uint32, number of ids of each text)."""
        if len(self.known) > self.limit:
            self._forget(self.limit // 3)
        texts = [t or b"" for t in texts]
        if self.kind == "apart" and not _leads_to_odd(b"\n".join(texts)):
            return self._cut(texts, False)
        # 0: may be cut; 1: may be cut, with runs of white space; 2: for the library as it is
        way = np.array([2 if self.kind == "whole" or odd(t) else int(self.kind == "led" and has_runs(t)) for t in texts])
        if not len(texts) or not way.any():
            return self._cut(texts, False)
        groups = [(np.flatnonzero(way == w), w) for w in (0, 1, 2)]
        pieces: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for at, w in groups:
            if len(at):
                own = [texts[i] for i in at]
                if w == 2:
                    parts = [np.array(x, dtype=np.uint32) for x in self._library(own)]
                else:
                    ids, per = self._cut(own, w == 1)
                    parts = np.split(ids, np.cumsum(per)[:-1])
                for i, p in zip(at, parts, strict=True):
                    pieces[i] = p
        return np.concatenate(pieces), np.array([len(p) for p in pieces], dtype=np.int64)

    def _cut(self, texts: list[bytes], runs: bool) -> tuple[np.ndarray, np.ndarray]:
        distinct, codes, counts = self._pieces(texts, runs)
        index = self._numbers(distinct).astype(np.int32)[codes]
        del codes
        lengths = self.length[index].astype(np.int32)
        return self.flat[ranges(self.start[index], lengths)], sums(lengths, counts)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, limit: int = 500_000) -> Encoder:
    """This worker's encoder for a file, kept from task to task."""
    if (path, limit) not in _encoders:
        _encoders.clear()
        _encoders[path, limit] = Encoder(path, limit)
    return _encoders[path, limit]
