"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the running text, white space and all, from both ends: windows of ``CORE`` bytes with ``CONTEXT`` more bytes
on each side, so that every position is labelled with what stands before and after it, over word ends. Every position gets
language probabilities, and a document's are their mean over all positions of letters (bytes of A-Z, a-z and from 128 on). Bytes are
read as they are but for A-Z, which are lower-cased, and white space, which is a space. It is trained in numpy by backpropagation
through time (Adam) on a bounded sample: ``DOCS_PER_LANGUAGE`` documents of each language, those first by a hash of their
id, and ``DOC_WINDOWS`` windows of each, spread over the whole text; of lang values the ``LANGUAGES`` commonest are learned.
Every byte of every text is read when predicting.

Defined cases: texts that are null or hold no letter get ``und`` and score 0; without any labelled row every
document does; rows whose lang or doc_id is null are not trained on; of rows that share doc_id and lang one is; very long texts
are read whole, window by window; repeated rows get equal results; ties between languages go to the first in alphabetical order;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, doc_text, in_fold, map_batches, prepared, sliced, text_bytes
from .sampling import first_by_hash

FOLDS, HELD_OUT = 4, 2
#: Bounds of the training sample.
LANGUAGES, DOCS_PER_LANGUAGE, DOC_WINDOWS = 200, 150, 24
#: Bytes whose labels a window gives, bytes of context on each side of them, windows run at a time.
CORE, CONTEXT, AT_A_TIME = 240, 8, 2048
_LENGTHS = np.array([16, 48, 112, CORE])
HIDDEN, TRAIN_BYTES = 16, 48
STEPS, BATCH, RATE = 700, 96, 0.02
_BYTES = np.arange(256)
_READ = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, np.where((_BYTES >= 9) & (_BYTES <= 13), 32, _BYTES)).astype(np.uint8)
_LETTERS = (_BYTES >= 128) | ((_READ >= 97) & (_READ <= 122))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class BiGru:
    """Parameters: per direction an input table by byte, recurrent weights; and the output layer."""

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = 5):
        rng, h = np.random.default_rng(seed), hidden
        self.h = h
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (256, 3 * h))
            self.p["u" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))
        self.p["o"] = rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, n_labels))
        self.p["c"] = np.zeros(n_labels)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _direction(self, d: str, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States of windows x [n, time] in reading order of direction d, as [n, time, h]."""
        n, steps = x.shape
        h, table, u = self.h, self.p["x" + d], self.p["u" + d]
        state, out = np.zeros((n, h), dtype=np.float32), np.empty((n, steps, h), dtype=np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, g = table[x[:, t]], state @ u
            rz = _sigmoid(a[:, : 2 * h] + g[:, : 2 * h])
            r, z = rz[:, :h], rz[:, h:]
            new = np.tanh(a[:, 2 * h :] + r * g[:, 2 * h :])
            if trace is not None:
                trace.append((t, state, r, z, new, g[:, 2 * h :]))
            state = new + z * (state - new)
            out[:, t] = state
        return out

    def labels(self, x: np.ndarray, traces: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities [n, time, labels], states) of windows of one length."""
        states = np.concatenate([self._direction(d, x, None if traces is None else traces.setdefault(d, [])) for d in "fb"], axis=2)
        logits = states @ self.p["o"] + self.p["c"]
        e = np.exp(logits - logits.max(2, keepdims=True))
        return e / e.sum(2, keepdims=True), states

    def _steps(self, d: str, x: np.ndarray):
        """(time, states of all windows) of x [time, n], in the order that direction d reads; the states are overwritten later."""
        h, n = self.h, x.shape[1]
        # sigmoid(v) is (tanh(v / 2) + 1) / 2, so the gates' halves are in their tables; each gate has arrays of its own
        scale = (0.5, 0.5, 1.0)
        tables = [np.ascontiguousarray(self.p["x" + d][:, k * h : (k + 1) * h] * np.float32(c)) for k, c in enumerate(scale)]
        inner = [np.ascontiguousarray(self.p["u" + d][:, k * h : (k + 1) * h] * np.float32(c)) for k, c in enumerate(scale)]
        state, r, z, new, g = (np.zeros((n, h), dtype=np.float32) for _ in range(5))
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            at = x[t]
            for gate, table, u in ((r, tables[0], inner[0]), (z, tables[1], inner[1])):
                np.take(table, at, axis=0, out=gate, mode="clip")
                gate += np.matmul(state, u, out=g)
                np.tanh(gate, out=gate)
                gate += 1
                gate *= 0.5
            np.take(tables[2], at, axis=0, out=new, mode="clip")
            r *= np.matmul(state, inner[2], out=g)
            new += r
            np.tanh(new, out=new)
            state -= new
            state *= z
            state += new
            yield t, state

    def sums(self, x: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """[n, labels] sums of the position probabilities of windows x [time, n] where counted [time, n]."""
        h, out = self.h, np.ascontiguousarray(self.p["o"].T)
        forward = np.empty((len(x), len(out), x.shape[1]), dtype=np.float32)
        for t, state in self._steps("f", x):
            np.matmul(out[:, :h], state.T, out=forward[t])
        forward += self.p["c"].astype(np.float32)[:, None]
        total = np.zeros(forward.shape[1:], dtype=np.float32)
        for t, state in self._steps("b", x):
            logits = forward[t]
            logits += out[:, h:] @ state.T
            logits -= logits.max(0)
            np.exp(logits, out=logits)
            logits *= counted[t] / logits.sum(0)
            total += logits
        return total.T

    def gradients(self, x: np.ndarray, y: np.ndarray, counted: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over the counted positions (all if not given), by backpropagation through time."""
        traces: dict[str, list] = {}
        prob, states = self.labels(x, traces)
        n, steps = x.shape
        delta = prob.copy()
        delta[np.arange(n)[:, None], np.arange(steps)[None, :], y[:, None]] -= 1
        if counted is not None:
            delta *= counted[:, :, None]
        delta /= n * steps if counted is None else max(1, counted.sum())
        grads = {"o": np.einsum("ntk,ntl->kl", states, delta), "c": delta.sum((0, 1))}
        back, h = delta @ self.p["o"].T, self.h
        for k, d in enumerate("fb"):
            gx, gu, u = np.zeros_like(self.p["x" + d]), np.zeros_like(self.p["u" + d]), self.p["u" + d]
            carry = np.zeros((n, h), dtype=np.float32)
            for t, before, r, z, new, gn in reversed(traces[d]):
                dh = carry + back[:, t, k * h : (k + 1) * h]
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (before - new) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                da = np.concatenate([dr, dz, dn], axis=1)
                np.add.at(gx, x[:, t], da)
                dg = np.concatenate([dr, dz, dn * r], axis=1)
                gu += before.T @ dg
                carry = dh * z + dg @ u.T
            grads["x" + d], grads["u" + d] = gx, gu
        return grads


def training_windows(text: bytes) -> list[bytes]:
    """``DOC_WINDOWS`` windows of ``TRAIN_BYTES`` bytes at most, each with a letter, evenly spread from before the text to behind it."""
    around = b" " * CONTEXT
    data = _READ[np.frombuffer(around + text + around, dtype=np.uint8)]
    last = max(0, len(data) - TRAIN_BYTES)
    starts = np.unique(np.linspace(0, last, min(DOC_WINDOWS, 2 + last // (TRAIN_BYTES // 2))).astype(np.int64))
    parts = [data[k : k + TRAIN_BYTES] for k in starts]
    return [p.tobytes().ljust(TRAIN_BYTES) for p in parts if _LETTERS[p].any()]


def fit(parts: list[bytes], langs: list[str], steps: int = STEPS) -> tuple[list[str], BiGru]:
    """Languages in alphabetical order, and the network trained on windows of texts. Every language weighs the same."""
    names = sorted(set(langs))
    rng = np.random.default_rng(11)
    pools: list[list[bytes]] = [[] for _ in names]
    for part, lang in zip(parts, langs, strict=True):
        pools[names.index(lang)].append(part)
    net = BiGru(len(names))
    share = -(-BATCH // len(pools))
    mean, square = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        picks = [(i, p[j]) for i, p in enumerate(pools) for j in rng.integers(0, len(p), share)]
        x = np.frombuffer(b"".join(w for _, w in picks), dtype=np.uint8).reshape(-1, TRAIN_BYTES)
        y = np.array([i for i, _ in picks])
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in net.gradients(x, y, _LETTERS[x]).items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            net.p[k] = (net.p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return names, net


def pooled(net: BiGru, texts: pa.Array) -> np.ndarray:
    """[texts, labels]: mean probabilities over the positions of letters; zeros where there is none."""
    edges, raw = text_bytes(texts)
    data = _READ[raw]
    letter = _LETTERS[data]
    sizes = np.diff(edges)
    each = -(-sizes // CORE)
    doc = np.repeat(np.arange(len(sizes)), each)
    start = edges[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) * CORE
    stop = np.minimum(start + CORE, edges[doc + 1])
    total = np.zeros((len(sizes), net.p["o"].shape[1]))
    # windows are run with others of their class of length, and nothing in a window depends on the others
    kind = np.searchsorted(_LENGTHS, stop - start)
    most = AT_A_TIME * 8 // max(8, total.shape[1])
    for length, some in ((_LENGTHS[c], part[k : k + most]) for c in range(len(_LENGTHS)) for part in [np.flatnonzero(kind == c)] for k in range(0, len(part), most)):
        low, high = edges[doc[some]], edges[doc[some] + 1]
        at = start[some] + np.arange(-CONTEXT, length + CONTEXT)[:, None]
        inside = (at >= low) & (at < high)
        x = np.where(inside, data.take(at, mode="clip"), np.uint8(32))
        counted = inside & (at >= start[some]) & (at < stop[some])
        counted[counted] = letter[at[counted]]
        np.add.at(total, doc[some], net.sums(x, counted))
    n = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=letter, minlength=len(sizes)) if len(data) else np.zeros(len(sizes))
    return total / np.maximum(n, 1)[:, None]


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    if re.search(rb"[A-Za-z]", text):
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode())


def training_sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """(doc_id, text, lang): at most per_language documents of each language learned, outside the held-out fold, a row each."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(FOLDS, HELD_OUT))
    ids = known.select("doc_id", "lang").distinct()
    common = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    chosen = first_by_hash(ids.join(F.broadcast(common), "lang"), "lang", per_language)
    rows = known.join(F.broadcast(chosen), ["doc_id", "lang"])
    turn = F.row_number().over(Window.partitionBy("doc_id", "lang").orderBy(F.xxhash64("text"), "text"))
    return rows.withColumn("_turn", turn).where("_turn = 1").select("doc_id", "text", "lang")


def sample_windows(sample: DataFrame) -> list[tuple[str, int, bytes]]:
    """(lang, doc_id, window) of the sample, in order; a bounded number of bytes for each document."""

    def run(batches):
        for b in batches:
            rows = [(i, lang, w) for i, t, lang in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True) for w in training_windows(t)]
            yield dict(zip(("doc_id", "lang", "window"), zip(*rows, strict=True) if rows else [[]] * 3, strict=True))

    return sorted((r.lang, r.doc_id, bytes(r.window)) for r in map_batches(sample, run, "doc_id long, lang string, window binary").toLocalIterator())


def predicted(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    spark = prepared(docs.sparkSession)
    sample = sample_windows(training_sample(docs, per_language))
    shipped = spark.sparkContext.broadcast(fit([s[2] for s in sample], [s[0] for s in sample]) if sample else None)

    def run(batches):
        model = shipped.value
        for b in sliced(batches, limit=1 << 20):
            lettered = np.array([model is not None and has_letter(t) for t in as_bytes(b.column(1))], dtype=bool)
            names, scores = np.array(["und"] * b.num_rows, dtype=object), np.zeros(b.num_rows)
            if lettered.any():
                found = pooled(model[1], b.column(1))
                names[lettered] = np.array(model[0], dtype=object)[found.argmax(1)[lettered]]
                scores[lettered] = np.clip(found.max(1)[lettered], 0, 1)
            yield {"doc_id": b.column(0), "held_out": b.column(2), "lang_pred": names.tolist(), "score": scores}

    rows = doc_text(docs).withColumn("held_out", in_fold(FOLDS, HELD_OUT))
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
