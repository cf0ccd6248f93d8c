import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoweave.functions import text as T
from orthoweave.operators import models, senses, tokens


class Encoded:
    def __init__(self, text):
        self.ids = [ord(c) % 7 for c in str(text)][:4] + [0] * (4 - len(str(text)))
        self.attention_mask, self.type_ids = [1] * 4, [0] * 4


class Tokenizer:
    def encode_batch(self, texts):
        return [Encoded(t) for t in texts]


class Input:
    def __init__(self, name):
        self.name = name


class Session:
    def get_inputs(self):
        return [Input("input_ids"), Input("attention_mask")]

    def run(self, _, given):
        return [np.stack([given["input_ids"], 1 + given["input_ids"]], axis=2).astype(float)]


def test_vectors_have_length_one():
    assert np.allclose(np.linalg.norm(models.embedded(Session(), Tokenizer(), ["abcd", "xyz"]), axis=1), 1)
    same = models.cosine_scores(Session(), Tokenizer(), ["abcd", "a"], ["abcd", "zzzz"])
    assert same[0] == pytest.approx(1) and same[1] < 1


def test_model_scorer(spark):
    rows = spark.createDataFrame([(["b", "a"], "gloss"), ([], "other")], "context array<string>, gloss string")
    scorer = models.model_scorer("nowhere", 8, lambda s, t, c, g: np.array([len(x) + len(y) for x, y in zip(c, g, strict=True)], float), lambda folder, n: (None, None))
    assert sorted(r.score for r in scorer(rows).collect()) == [5.0, 8.0]
    assert callable(senses.overlap_scorer)


def test_failing_model_names_its_cause(spark):
    def down(folder, n):
        raise RuntimeError("backend down")

    rows = spark.createDataFrame([("c", "g")], "context string, gloss string")
    with pytest.raises(Exception, match="backend down"):
        models.model_scorer("x", 8, models.pair_scores, down)(rows).collect()


def test_judged_alternatives(spark):
    rows = spark.createDataFrame([(1, "a hospital here", 2, 10, ["clinic", "ward", "bad"] + ["x"] * 12)], "text_id long, text string, begin int, end int, replacements array<string>")

    def judge(before, after, word):
        if word == "bad":
            raise RuntimeError
        return word == "clinic" and after == "a clinic here"

    got = models.validated(rows, judge).first().validation
    assert got[:3] == ["accepted", "rejected", "unverified"] and got[12:] == ["unverified"] * 3


def test_contexts(spark):
    text = "First sentence. The 🌊 bank was beside another bank."
    df = spark.createDataFrame([(1, text, "eng")], "text_id long, text string, lang string")
    at = text.rindex("bank")
    places = spark.createDataFrame([(1, 1, at, at + 4)], "text_id long, sentence int, begin int, end int")
    assert tokens.contexts(df, places).first().context == "The 🌊 bank was beside another <t>bank</t>."
    with pytest.raises(Exception, match="mark"):
        tokens.contexts(df.withColumn("text", F.concat("text", F.lit(" <t>"))), places).collect()


def test_only_place(spark):
    rows = spark.createDataFrame([("The bank. Banks banked",), ("bank Bank",), ("no",)], "t string")
    assert [r.n for r in rows.select(T.occurrences(F.col("t"), "bank").alias("n")).collect()] == [1, 2, 0]
    assert [r.p for r in rows.where("t <> 'bank Bank'").select(T.only_place(F.col("t"), "bank").alias("p")).collect()] == [4, None]
    with pytest.raises(Exception, match="more than once"):
        rows.select(T.only_place(F.col("t"), "bank")).collect()


def test_text_probability():
    class One:
        def get_inputs(self):
            return [Input("input_ids"), Input("position_ids")]

        def run(self, _, given):
            assert given["position_ids"].tolist() == [[0, 1, 2]]
            logits = np.full((1, 3, 4), -50.0)
            for k, (token, p) in enumerate(((1, 0.5), (2, 0.125))):
                logits[0, k, token], logits[0, k, 3] = np.log(p), np.log(1 - p)
            return [logits]

    class Ids:
        def encode(self, text):
            out = Encoded("")
            out.ids = [1, 2] if text else []
            return out

    assert models.text_probability(One(), Ids(), "two tokens") == pytest.approx(0.25)
    assert models.text_probability(None, Ids(), "") == 1.0
    check = models.coherence_checker("nowhere", loader=lambda folder, n: (One(), Ids()))
    assert check("two tokens") == pytest.approx(0.25)


def test_model_folders(tmp_path):
    (tmp_path / "eng-sense").mkdir()
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "model.properties").write_text("language=ita\ntype=sense\n")
    assert models.find_model(str(tmp_path), "eng", "sense").endswith("eng-sense") and models.find_model(str(tmp_path), "ita", "sense").endswith("other")
    with pytest.raises(FileNotFoundError):
        models.find_model(str(tmp_path), "fra", "sense")


def test_glosses_are_cut_and_contexts_are_not(spark):
    seen = []

    class Limited(Tokenizer):
        def enable_truncation(self, tokens, strategy):
            seen.append((tokens, strategy))

    models._limited(Limited(), 8, "only_second")
    assert seen == [(8, "only_second")]
