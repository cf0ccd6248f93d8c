"""Plug-in models: scorers of senses in context, and judges of replacements."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .senses import Scorer

#: Tokens that the English and the multilingual model read, and threads of each. Fixed values.
ENGLISH_TOKENS, OTHER_TOKENS, THREADS = 512, 256, 2
#: Alternatives that a judge sees for one place, and characters of context on each side. Fixed values.
JUDGED, AROUND = 12, 1000

_sessions: dict[str, tuple] = {}


def find_model(folder: str, lang: str, kind: str) -> str:
    """The model folder ``<lang>-<kind>``, else the first, in order of name, whose ``model.properties`` names both; raises without one."""
    exact = os.path.join(folder, f"{lang}-{kind}")
    if os.path.isdir(exact):
        return exact
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name, "model.properties")
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as lines:
                found = dict(line.strip().split("=", 1) for line in lines if "=" in line and not line.startswith("#"))
            if found.get("language") == lang and found.get("type") == kind:
                return os.path.join(folder, name)
    raise FileNotFoundError(f"no {kind} model for {lang} under {folder}")


def load(folder: str, tokens: int) -> tuple:
    """(session, tokenizer) of a folder with model.onnx and tokenizer.json, once per worker.

    Of a pair only the second text, the gloss, is cut to the limit.
    """
    if folder not in _sessions:
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = THREADS
        tokenizer = Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))
        tokenizer.enable_padding()
        _sessions[folder] = onnxruntime.InferenceSession(os.path.join(folder, "model.onnx"), options), tokenizer
    return _sessions[folder]


def _inputs(session, encoded: list) -> dict[str, np.ndarray]:
    given = {"input_ids": [e.ids for e in encoded], "attention_mask": [e.attention_mask for e in encoded], "token_type_ids": [e.type_ids for e in encoded]}
    return {x.name: np.array(given[x.name], dtype=np.int64) for x in session.get_inputs() if x.name in given}


def _limited(tokenizer, tokens: int | None, strategy: str):
    if tokens is not None and hasattr(tokenizer, "enable_truncation"):
        tokenizer.enable_truncation(tokens, strategy=strategy)
    return tokenizer


def pair_scores(session, tokenizer, contexts: list[str], glosses: list[str]) -> np.ndarray:
    """The first logit of each (context, gloss) pair."""
    out = session.run(None, _inputs(session, tokenizer.encode_batch(list(zip(contexts, glosses, strict=True)))))[0]
    return np.asarray(out, dtype=np.float64).reshape(len(contexts), -1)[:, 0]


def embedded(session, tokenizer, texts: list[str]) -> np.ndarray:
    """Mean of the token vectors under the mask, scaled to length 1."""
    given = _inputs(session, tokenizer.encode_batch(texts))
    states, mask = np.asarray(session.run(None, given)[0], dtype=np.float64), given["attention_mask"][:, :, None]
    mean = (states * mask).sum(1) / np.maximum(mask.sum(1), 1)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def cosine_scores(session, tokenizer, contexts: list[str], glosses: list[str]) -> np.ndarray:
    distinct = sorted({*contexts, *glosses})
    vectors = embedded(session, tokenizer, distinct)
    at = {t: k for k, t in enumerate(distinct)}
    return (vectors[[at[c] for c in contexts]] * vectors[[at[g] for g in glosses]]).sum(1)


def model_scorer(folder: str, tokens: int, score: Callable = pair_scores, loader: Callable = load) -> Scorer:
    """Scorer over rows with ``context`` (text, or terms that are joined) and ``gloss``; the model runs in Arrow batches."""

    @F.pandas_udf(DoubleType())
    def scored(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        session, tokenizer = loader(folder, tokens)
        _limited(tokenizer, tokens, "only_second" if score is pair_scores else "longest_first")
        for contexts, glosses in frames:
            yield pd.Series(score(session, tokenizer, contexts.fillna("").tolist(), glosses.fillna("").tolist()))

    def add(rows: DataFrame) -> DataFrame:
        listed = rows.schema["context"].dataType.typeName() == "array"
        context = F.concat_ws(" ", "context") if listed else F.col("context")
        return rows.withColumn("score", scored(context, F.col("gloss")))

    return add


def validated(alternatives: DataFrame, judge: Callable[[str, str, str], bool], text: str = "text") -> DataFrame:
    """alternatives with ``validation`` accepted or rejected by a judge of (context before, context after, replacement).

    alternatives: (text_id, text, begin, end, replacements array). The first JUDGED of each place are asked; what the judge
    isn't asked, or raises on, stays unverified.
    """

    def run(frames):
        for pdf in frames:
            out = []
            for t, begin, end, words in zip(pdf[text], pdf["begin"], pdf["end"], pdf["replacements"], strict=True):
                left, right = t[max(0, begin - AROUND) : begin], t[end : end + AROUND]
                found = []
                for k, word in enumerate(words):
                    status = "unverified"
                    if k < JUDGED:
                        try:
                            status = "accepted" if judge(left + t[begin:end] + right, left + word + right, word) else "rejected"
                        except Exception:  # noqa: BLE001  the judge is somebody else's code
                            status = "unverified"
                    found.append(status)
                out.append(found)
            yield pdf.assign(validation=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in alternatives.schema.fields)
    return alternatives.mapInPandas(run, fields + ", validation array<string>")


def text_probability(session, tokenizer, text: str, boundary: int = 0, tokens: int = 1024) -> float:
    """exp of the mean log probability of a text's tokens under a causal model, read after its boundary token; 1 without tokens."""
    ids = np.array([boundary, *tokenizer.encode(text).ids][:tokens], dtype=np.int64)
    if len(ids) < 2:
        return 1.0
    known = {"input_ids": ids, "attention_mask": np.ones_like(ids), "position_ids": np.arange(len(ids))}
    out = session.run(None, {x.name: known[x.name][None, :] for x in session.get_inputs()})[0]
    logits = np.asarray(out, dtype=np.float64)[0, :-1]
    top = logits.max(1)
    log_p = logits[np.arange(len(logits)), ids[1:]] - top - np.log(np.exp(logits - top[:, None]).sum(1))
    return float(np.exp(log_p.mean()))


def coherence_checker(folder: str, boundary: int = 0, tokens: int = 1024, loader: Callable = load) -> Callable[[str], float]:
    """Checker of texts for ``substitution.applied``: the probability that a causal language model in ``folder`` gives them.

    The model is loaded once in each worker that checks.
    """

    def check(text: str) -> float:
        return text_probability(*loader(folder, tokens), text, boundary, tokens)

    return check
