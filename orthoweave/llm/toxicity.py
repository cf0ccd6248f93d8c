"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between, of lower-cased text, each hashed to one of
``2 ** BITS`` places. Training runs over a bounded sample of labelled documents (``SAMPLE_PER_LABEL`` of each label, those
that come first by a hash of their id, and of each its first ``SAMPLE_FEATURES`` distinct features in order of hash, every
place of the text having the same chance); each coordinate has its own rate, and the L1 term leaves a few weights, which are broadcast. All
features take part, however few documents have them. Scoring takes every feature of the whole text once per document, so long texts
aren't pushed to either side by length alone.

The constants ALPHA, L1 and EPOCHS were chosen by :func:`cross_validated` over the training rows alone (four folds of them); no held-out
label was looked at.

Defined cases: null and empty texts have no features and get the score of the bias alone; without labels of both
kinds every score is the share of label 1 (0 if there are none); a document with several labels is toxic if
any of them is; labels that are null don't count; of rows that share a labelled doc_id one is trained on, that with the least hash of
its text; a score of exactly 0.5 counts as toxic; very long texts are scored whole; repeated rows get equal scores; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, as_bytes, doc_text, in_fold, map_batches, mix64, prepared
from .sampling import first_by_hash

FOLDS, HELD_OUT = 5, 0
#: Bounds of the training sample: documents of each label, and features of one document.
SAMPLE_PER_LABEL, SAMPLE_FEATURES = 3000, 20_000
#: Features are hashed to so many bits.
BITS = 24
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 10.0, 0.1, 8


class Features:
    """Hashed features of texts; words are hashed once while the worker remembers them."""

    def __init__(self):
        self.words, self.hashes = Words(), np.zeros(1 << 12, dtype=np.uint64)

    def word_hashes(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if self.words.full():
            self.words = Words()
        before = len(self.words.ids)
        ids = np.array(self.words.of(words), dtype=np.int64)
        after = len(self.words.ids)
        if after > len(self.hashes):
            self.hashes = np.resize(self.hashes, max(after, 2 * len(self.hashes)))
        if after > before:
            fresh = list(islice(reversed(self.words.ids), after - before))[::-1]
            raw = np.array([zlib.crc32(w) | zlib.crc32(w, 0x9E3779B9) << 32 for w in fresh], dtype=np.uint64)
            self.hashes[before:after] = mix64(raw)
        return self.hashes[ids]

    def of(self, text: bytes | None) -> np.ndarray:
        h = self.word_hashes(text)
        with np.errstate(over="ignore"):
            pairs = mix64(h[:-1] * np.uint64(3) + h[1:] * np.uint64(5))
            skips = mix64(h[:-2] * np.uint64(7) + h[2:] * np.uint64(11))
        return (np.concatenate([h, pairs, skips]) >> np.uint64(64 - BITS)).astype(np.uint32)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, alpha: float = ALPHA, l1: float = L1) -> tuple[np.ndarray, np.ndarray, float]:
    """Places in ascending order with weights that aren't zero, and the bias."""
    bias = 1 << BITS
    z, n = np.zeros(bias + 1, dtype=np.float32), np.zeros(bias + 1, dtype=np.float32)
    rng = np.random.default_rng(7)

    def weights(zz, nn, shrink):
        w = -(zz - np.sign(zz) * shrink) / ((BETA + np.sqrt(nn)) / alpha + L2)
        return np.where(np.abs(zz) <= shrink, 0.0, w)

    parts = [np.append(r, np.uint32(bias)) for r in rows]
    shrink = np.full(max(map(len, parts), default=1), l1)
    for _ in range(epochs):
        for k in rng.permutation(len(parts)):
            at = parts[k]
            zz, nn = z[at].astype(np.float64), n[at].astype(np.float64)
            own = shrink[: len(at)]
            own[-1] = 0.0  # the bias isn't shrunk
            w = weights(zz, nn, own)
            own[-1] = l1
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            sigma = (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha
            z[at] = zz + g - sigma * w
            n[at] = nn + g * g
    some = np.flatnonzero(np.abs(z[:-1]) > l1)
    return some.astype(np.uint32), weights(z[some].astype(np.float64), n[some].astype(np.float64), l1), float(weights(float(z[-1]), float(n[-1]), 0.0))


def raw_scores(model: tuple[np.ndarray, np.ndarray, float], rows: list[np.ndarray]) -> np.ndarray:
    """Sums of weights and bias of rows of distinct features."""
    places, weights, bias = model
    table = np.zeros(1 << BITS, dtype=np.float32)
    table[places] = weights
    return np.array([bias + float(table[r].sum(dtype=np.float64)) for r in rows])


def cross_validated(rows: list[np.ndarray], labels: np.ndarray, folds: int = 4, **constants) -> tuple[float, float]:
    """(mean log loss, share of wrong verdicts) over folds of the given rows, each scored by a model of the others."""
    fold = np.random.default_rng(3).permutation(len(rows)) % folds
    loss, wrong = [], []
    for k in range(folds):
        inside = np.flatnonzero(fold != k)
        x = raw_scores(ftrl([rows[i] for i in inside], labels[inside], **constants), [rows[i] for i in np.flatnonzero(fold == k)])
        y = labels[fold == k]
        loss.append(np.logaddexp(0, np.where(y > 0, -x, x)))
        wrong.append((x >= 0) != (y > 0))
    return float(np.concatenate(loss).mean()), float(np.concatenate(wrong).mean())


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """(doc_id, text, toxic): at most per_label documents of each label outside the held-out fold, a row each."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(~in_fold(FOLDS, HELD_OUT))
    chosen = first_by_hash(known.withColumn("kind", F.col("toxic") > 0), "kind", per_label).drop("kind")
    # at most twice per_label ids
    rows = doc_text(docs).where("text is not null").join(F.broadcast(chosen), "doc_id")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    return rows.withColumn("_turn", turn).where("_turn = 1").select("doc_id", "text", "toxic")


def sample_features(sample: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct features of each row of the sample, in order of doc_id, and the labels."""

    def run(batches):
        features = Features()
        for b in batches:
            yield {"doc_id": b.column(0), "f": [np.unique(features.of(t))[:SAMPLE_FEATURES].tobytes() for t in as_bytes(b.column(1))], "toxic": b.column(2)}

    found = sorted(((r.doc_id, bytes(r.f), r.toxic) for r in map_batches(sample, run, "doc_id long, f binary, toxic int").toLocalIterator()), key=lambda r: r[0])
    return [np.frombuffer(f, dtype=np.uint32) for _, f, _ in found], np.array([float(toxic > 0) for _, _, toxic in found])


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> tuple[np.ndarray, np.ndarray, float]:
    rows, y = sample_features(training_sample(docs, labels, per_label))
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return np.zeros(0, np.uint32), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    return ftrl(rows, y)


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    spark = prepared(docs.sparkSession)
    shipped = spark.sparkContext.broadcast(train(docs, labels, per_label))

    def run(batches):
        features, (places, weights, bias) = Features(), shipped.value
        table = np.zeros(1 << BITS, dtype=np.float32)  # pages that hold no weight take no memory
        table[places] = weights
        for b in batches:
            scores = []
            for t in as_bytes(b.column(1)):
                f = features.of(t)
                f = np.unique(f[table[f] != 0])
                scores.append(1 / (1 + np.exp(-np.clip(bias + float(table[f].sum(dtype=np.float64)), -35, 35))))
            yield {"doc_id": b.column(0), "held_out": b.column(2), "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    rows = doc_text(docs).withColumn("held_out", in_fold(FOLDS, HELD_OUT))
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")
