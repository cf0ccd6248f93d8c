"""Quality rules by compression bands.

Zstandard ratios of the whole text and of fixed chunks reject text that is repetitive (ratio under the
band) or incompressible (over it); the limits depend on the length, and so does the size of the chunks of
texts under 2 KB. Beside them stand plain counts of
words, symbols, repeated lines and repeated 3-word windows.

Defined cases: a null or empty text has zero counts, fails the base rule and isn't kept; texts shorter than
the first band are judged by the base rule alone; very long texts are read whole; a ratio on a limit is within the
band; equal rows get equal results, rows that tie on doc_id are judged each alone; an empty table gives no rows; extra columns are ignored by
:func:`quality` and kept by :func:`kept_documents`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import as_bytes, doc_text, forget_encoders, map_batches, prepared

#: (least bytes, lowest ratio, highest ratio) for whole texts; shorter texts than the first are not judged by ratio.
BANDS = (
    (128, 0.38, 1.05),
    (256, 0.40, 0.92),
    (512, 0.39, 0.86),
    (1024, 0.37, 0.80),
    (2048, 0.35, 0.75),
    (4096, 0.33, 0.72),
    (8192, 0.31, 0.70),
    (16384, 0.29, 0.68),
    (32768, 0.27, 0.66),
)
#: (least bytes of the text, bytes of its chunks, lowest ratio, highest ratio of a chunk); shorter texts have no chunks.
CHUNKS = (
    (128, 128, 0.33, 1.05),
    (512, 256, 0.35, 0.95),
    (1024, 512, 0.34, 0.89),
    (2048, 2048, 0.30, 0.78),
)
#: The share of chunks that may lie outside.
CHUNK_SHARE = 0.25
LEVEL = 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Numbers below this have cubes of less than 63 bits.
_CUBED = 2_000_000
SYMBOL = re.compile(rb"[#*$%&|<>]")

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, chunk_low_share double, chunk_high_share double"
)


def measures(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or b""
    words = text.split()
    chars = sum(map(len, words))
    if not text.isascii():
        chars -= int(np.count_nonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) == 0x80))
    lines = [x for x in text.split(b"\n") if x.strip()]
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    repeated = 0
    if len(a) > 3 and len(ids) < len(a):
        m = len(ids)
        pairs = a[:-1] * m + a[1:]
        if m > _CUBED:  # pairs are numbered first, so that a triple stays within 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, inverse, counts = np.unique(pairs[:-1] * m + a[2:], return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        hit = np.zeros(len(a), dtype=bool)
        for k in range(3):
            hit[k : len(a) - 2 + k] |= twice
        repeated = int(hit.sum())
    return len(words), chars, len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated


def ratios(text: bytes | None, packer: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """Ratio of the whole text, and the shares of chunks under and over the chunk band.

    Every byte is in a chunk: the last one ends with the text and overlaps the one before where the length asks for it.
    """
    if not text:
        return 0.0, 0.0, 0.0
    whole = len(packer.compress(text)) / len(text)
    found = next((c for c in reversed(CHUNKS) if len(text) >= c[0]), None)
    if found is None:
        return whole, 0.0, 0.0
    _, size, lowest, highest = found
    each = [len(packer.compress(text[k : k + size])) / size for k in (*range(0, len(text) - size, size), len(text) - size)]
    return whole, sum(x < lowest for x in each) / len(each), sum(x > highest for x in each) / len(each)


def in_bands(n_bytes: int, ratio: float, low_share: float, high_share: float) -> bool:
    band = next((b for b in reversed(BANDS) if n_bytes >= b[0]), None)
    return band is None or (band[1] <= ratio <= band[2] and max(low_share, high_share) <= CHUNK_SHARE)


def judged(text: bytes | None, packer: zstandard.ZstdCompressor) -> tuple:
    n, chars, symbols, dup, rep = measures(text)
    failed = n < MIN_WORDS or 100 * rep > MAX_REPEAT_PERCENT * n
    ratio, low, high = ratios(text, packer)
    return n, chars, symbols, dup, rep, failed, not failed and in_bands(len(text or b""), ratio, low, high), ratio, low, high


def quality(docs: DataFrame) -> DataFrame:
    """One row per document with the counts, the ratios and the verdict ``kept``."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=LEVEL)
        names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
        for b in batches:
            rows = [judged(t, packer) for t in as_bytes(b.column(1))]
            yield {"doc_id": b.column(0)} | dict(zip(names, zip(*rows) if rows else [[]] * len(names), strict=True))

    return map_batches(doc_text(docs), run, SCHEMA)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns unchanged; no shuffle."""
    prepared(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        forget_encoders()
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            keep = [judged(t, packer)[6] for t in as_bytes(b.column(at))]
            yield b.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
