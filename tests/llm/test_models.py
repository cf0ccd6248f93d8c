"""Trained operators: contract columns on odd rows, and accuracy on held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from orthoweave.llm import language_id, toxicity

from .conftest import frame


def fold_of(i, m):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


def test_language(docs, rows, empty):
    out = language_id.predicted(docs).collect()
    assert len(out) == len(rows)
    lang = {i: x for i, _, x in rows}
    for r in out:
        assert 0 <= r.score <= 1 and r.held_out == (fold_of(r.doc_id, 4) == 2)
    plain = [r for r in out if r.doc_id is not None and r.doc_id < 60]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in plain]) > 0.9
    got = {r.doc_id: (r.lang_pred, r.score) for r in out if r.doc_id is not None}
    assert got[100] == got[101] == got[102] == got[104] == ("und", 0.0)
    assert language_id.predicted(empty).count() == 0


def test_language_without_labels(spark):
    rows = [(1, "some text", None), (2, None, None)]
    assert {r.lang_pred for r in language_id.predicted(frame(spark, rows)).collect()} == {"und"}


def test_gradients_are_those_of_the_loss():
    net = language_id.BiGru(3, 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.random.default_rng(0).integers(0, 256, (5, 6)).astype(np.uint8), np.array([0, 1, 2, 0, 1])

    def loss():
        return -np.log(net.labels(x)[0][np.arange(5)[:, None], np.arange(6)[None, :], y[:, None]]).mean()

    for name, g in net.gradients(x, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = net.p[name][at]
        net.p[name][at] = kept + 1e-3
        up = loss()
        net.p[name][at] = kept - 1e-3
        down = loss()
        net.p[name][at] = kept
        assert abs((up - down) / 2e-3 - g[at]) < 1e-5


def test_gradients_of_counted_positions():
    net = language_id.BiGru(3, 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.random.default_rng(0).integers(0, 256, (5, 6)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    counted = np.random.default_rng(1).random((5, 6)) < 0.5

    def loss():
        return -np.log(net.labels(x)[0][np.arange(5)[:, None], np.arange(6)[None, :], y[:, None]])[counted].mean()

    for name, g in net.gradients(x, y, counted).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = net.p[name][at]
        net.p[name][at] = kept + 1e-3
        up = loss()
        net.p[name][at] = kept - 1e-3
        down = loss()
        net.p[name][at] = kept
        assert abs((up - down) / 2e-3 - g[at]) < 1e-5


def plain_labels(net, window):
    """Label probabilities of each byte of a window, a number at a time."""
    h = net.h

    def states(d, order):
        state, out = [0.0] * h, {}
        for t in order:
            a = net.p["x" + d][window[t]].tolist()
            g = [sum(state[i] * float(net.p["u" + d][i, j]) for i in range(h)) for j in range(3 * h)]
            r = [1 / (1 + math.exp(-(a[j] + g[j]))) for j in range(h)]
            z = [1 / (1 + math.exp(-(a[h + j] + g[h + j]))) for j in range(h)]
            new = [math.tanh(a[2 * h + j] + r[j] * g[2 * h + j]) for j in range(h)]
            state = [new[j] + z[j] * (state[j] - new[j]) for j in range(h)]
            out[t] = state
        return out

    forward, back = states("f", range(len(window))), states("b", range(len(window) - 1, -1, -1))
    out = []
    for t in range(len(window)):
        s = forward[t] + back[t]
        e = [math.exp(sum(s[i] * float(net.p["o"][i, k]) for i in range(2 * h)) + float(net.p["c"][k])) for k in range(len(net.p["c"]))]
        out.append([x / sum(e) for x in e])
    return out


def test_language_scores_equal_a_plain_network(spark, monkeypatch):
    fitted = []
    fit = language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda *a: fitted.append(fit(*a, steps=15)) or fitted[0])
    base = [(k, ("the water and the stone " if k % 2 else "la maison et la lumière ") * (1 + k % 3), "en" if k % 2 else "fr") for k in range(12)]
    odd = [(50, "x", None), (51, "Été 漢字 12!", None), (52, "a\tB\n" * 70, None), (53, "w" * 241 + " the end", None)]
    found = {r.doc_id: r for r in language_id.predicted(frame(spark, base + odd)).collect()}
    names, net = fitted[0]
    for i, text, _ in base[:3] + odd:
        data = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in text.encode())
        letters = [c >= 128 or 97 <= c <= 122 for c in data]
        total, n = [0.0] * len(names), sum(letters)
        for begin in range(0, len(data), 240):
            end = min(begin + 240, len(data))
            length = next(x for x in (16, 48, 112, 240) if x >= end - begin)
            window = [data[t] if 0 <= t < len(data) else 32 for t in range(begin - 8, begin + length + 8)]
            each = plain_labels(net, window)
            for t in range(begin, end):
                if letters[t]:
                    total = [x + y for x, y in zip(total, each[t - begin + 8], strict=True)]
        pooled = [x / n for x in total]
        assert found[i].lang_pred == names[pooled.index(max(pooled))] and abs(found[i].score - max(pooled)) < 1e-4


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    rows = [(k, "some text " * 5000, f"odd{k}") for k in range(30)] + [(100 + k % 40, f"plain text {k}", "en" if k % 2 else "fr") for k in range(160)]
    sample = language_id.training_sample(frame(spark, rows), 10)
    got = {r.lang: (r.n, r.ids) for r in sample.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).collect()}
    assert got == {"en": (10, 10), "fr": (10, 10)}
    windows = language_id.training_windows(b"some text " * 5000)
    assert len(windows) == language_id.DOC_WINDOWS and {len(w) for w in windows} == {language_id.TRAIN_BYTES}
    assert language_id.training_windows(b"12 .") == [] and len(language_id.training_windows(b"a")) == 1


def test_toxicity(spark, docs, rows, empty):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(300)]
    made, labels = [], []
    for i in range(500):
        text = [rng.choice(words) for _ in range(rng.choice([20, 80, 400]))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["awful", "stupid", "horrid"]))
        made.append((i, " ".join(text), "en"))
        labels.append((i, 1, int(toxic)))
    labels += [(1, 1, None), (None, 1, 1), (7, 0, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(frame(spark, made), table).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (fold_of(r.doc_id, 5) == 0) for r in out) and len(held) > 50
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.95
    odd = toxicity.toxicity(docs, table).collect()
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert toxicity.toxicity(empty, table).count() == 0


def plain_ftrl(rows, labels, epochs, alpha, l1):
    """FTRL-proximal with dictionaries, a coordinate at a time; the bias is coordinate None and isn't shrunk."""
    z, n = Counter(), Counter()

    def weight(i):
        shrink = 0.0 if i is None else l1
        if abs(z[i]) <= shrink:
            return 0.0
        return -(z[i] - math.copysign(shrink, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / alpha + toxicity.L2)

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at = [*rows[k].tolist(), None]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[k]
            for i in at:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def test_ftrl_equals_a_plain_version_and_drops_no_feature():
    rng = np.random.default_rng(5)
    features = toxicity.Features()
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, 30)) for _ in range(40)]
    texts[3] += " planted"
    texts[4] += " planted"  # in two documents only
    labels = np.array([float(k in (3, 4)) for k in range(40)])
    rows = [np.unique(features.of(t.encode())) for t in texts]
    for alpha, l1 in ((1.0, 0.5), (2.0, 2.0)):
        places, weights, bias = toxicity.ftrl(rows, labels, 8, alpha, l1)
        want = plain_ftrl(rows, labels, 8, alpha, l1)
        got = dict(zip(places.tolist(), weights.tolist(), strict=True))
        assert abs(bias - want.pop(None)) < 1e-3
        assert all(abs(got.get(i, 0.0) - w) < 1e-3 for i, w in want.items())
        assert got[int(features.of(b"planted")[0])] > 0.5


def test_toxicity_scores_equal_a_plain_version(spark):
    rng = random.Random(9)
    words = [f"word{k}" for k in range(40)]
    made = [(i, " ".join(["Awful"] * (i % 4 == 0) + [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 30]))]), "en") for i in range(120)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(120)]
    out = toxicity.toxicity(frame(spark, made), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    features = toxicity.Features()
    rows = {i: np.unique(features.of(t.encode())) for i, t, _ in made}
    train = sorted(i for i in rows if fold_of(i, 5) != 0)
    model = plain_ftrl([rows[i] for i in train], [float(i % 4 == 0) for i in train], toxicity.EPOCHS, toxicity.ALPHA, toxicity.L1)
    for r in out:
        total = model[None] + sum(model.get(x, 0.0) for x in rows[r.doc_id].tolist())
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-3


def test_constants_of_toxicity_can_be_compared_inside_the_training_rows():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.r_[rng.integers(0, 1 << 20, 50), 7 if k % 3 == 0 else 9]).astype(np.uint32) for k in range(90)]
    labels = np.array([float(k % 3 == 0) for k in range(90)])
    good, bad = toxicity.cross_validated(rows, labels, l1=1.0), toxicity.cross_validated(rows, labels, l1=1e6)
    assert good[0] < bad[0] and good[1] == 0.0


def test_rows_that_share_a_labelled_id_are_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert {r.doc_id: r["count"] for r in toxicity.training_sample(docs, labels).groupBy("doc_id").count().collect()} == {1: 1, 2: 1}


def test_toxicity_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert max(r.score for r in toxicity.toxicity(docs, none).collect()) < 1e-6


def test_toxicity_sample_holds_3000_documents_a_label(spark):
    docs = spark.range(9000).selectExpr("id as doc_id", "'some text' as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    found = toxicity.training_sample(docs, labels).groupBy("toxic").count().collect()
    assert {r.toxic: r["count"] for r in found} == {0: 3000, 1: 3000}
