import pytest
from pyspark.sql import functions as F

from orthoweave.functions import text as T
from orthoweave.functions import vectors as V


def one(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], list(given)) if given else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("a, b, want", [("Hotel", " hotel ", 1.0), ("", "", 1.0), ("kitten", "sitting", 1 - 3 / 7), ("été", "ete", 1 / 3), ("a_b", "a b", 2 / 3), ("\tx\x01", "x", 1.0)])
def test_transparency(spark, a, b, want):
    assert one(spark, T.transparency(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_similarities(spark):
    assert one(spark, T.similarity(F.col("a"), F.col("b")), a=" x", b="x") == 0.5
    assert one(spark, T.similarity_nfkc(F.col("a"), F.col("b")), a="ﬁ①", b="FI1") == 1.0


def test_codes(spark):
    for given, want in ((" English ", "eng"), ("fre", "fra"), ("DE", "deu"), ("jpn", "jpn")):
        assert one(spark, T.normal_code(F.col("a")), a=given) == want
    assert one(spark, T.label(F.col("a")), a="it") == "Italian (ita)" and one(spark, T.label(F.col("a")), a="xx") == "xx"
    assert [one(spark, T.is_supported(F.col("a")), a=x) for x in ("en", "de", "jpn", "nl")] == [True, False, False, True]


def test_clean(spark):
    assert one(spark, T.clean(F.col("a")), a="Hello\nhttps://example.org/test world user@example.com") == "Hello world"
    assert one(spark, T.clean(F.col("a")), a="ﬁne\x00​ text www.x.y") == "fine text"


def test_tags(spark):
    got = [one(spark, T.wordnet_pos(F.col("a")), a=x) for x in ("NNS", "VBD", "JJR", "RB", "PROPN", "DT")]
    assert got == ["n", "v", "a", "r", "n", None]
    assert [one(spark, T.pos_letter(F.col("a")), a=x) for x in ("VERB", "?")] == ["v", "n"]


@pytest.mark.parametrize("original, word, want", [("Hospital", "clinic", "Clinic"), ("HOSPITAL", "clinic", "CLINIC"), ("hospital", "Clinic", "Clinic"), ("A", "clinic", "Clinic"), ("12", "clinic", "clinic")])
def test_match_case(spark, original, word, want):
    assert one(spark, T.match_case(F.col("a"), F.col("b")), a=original, b=word) == want


def test_display(spark):
    assert one(spark, T.bar(F.lit(0.5))) == "#" * 8 + "-" * 8 and one(spark, T.bar(F.lit(7.0))) == "#" * 16
    assert one(spark, T.clip(F.lit("abc\tdefgh"), 8)) == "abc d..." and one(spark, T.clip(F.lit("abc"), 8)) == "abc"
    assert [one(spark, T.color(F.lit(x))) for x in (0.7, 0.4, 0.39)] == ["high", "middle", "low"]
    assert [one(spark, T.band(F.lit(x))) for x in (1.0, 0.95, 0.7, 0.5, 0.2, 0.1)] == [n for n, _ in T.BANDS]
    assert one(spark, T.marked(F.lit("a bank b"), F.lit(2), F.lit(6))) == "a <t>bank</t> b"
    assert one(spark, T.tidy_form(F.lit(" a_b  c"))) == "a b c"


def test_valid_rewrite(spark):
    def ok(text="x", source="eng", target="ita", direction="more", change=0.1):
        return one(spark, T.valid_rewrite(F.lit(text), F.lit(source), F.lit(target), F.lit(direction), F.lit(change)))

    assert ok() and not ok(direction="neutral") and not ok(source="xx") and not ok(text="a" * 1001) and not ok(change=1.1) and not ok(source="de") and not ok(target="en") and not ok(text="12")


def test_statuses(spark):
    assert one(spark, T.statuses(F.lit('{"statuses": ["accepted", "rejected"]}'), F.lit(2))) == ["accepted", "rejected"]
    for bad in ('{"statuses": ["accepted"]}', '{"statuses": ["accepted", "maybe"]}', "no json", '{"statuses": ["accepted", null]}'):
        assert one(spark, T.statuses(F.lit(bad), F.lit(2))) is None


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0))
    assert one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(1.0)))) == 0 and one(spark, V.cosine(a, b)) == 1
    with pytest.raises(Exception, match="vectors must be"):
        one(spark, V.cosine(a, F.array(F.lit(1.0))))
    pooled = one(spark, V.mean_pool(F.array(a, b, F.array(F.lit(9.0), F.lit(9.0))), F.array(F.lit(1), F.lit(1), F.lit(0))))
    assert pooled == [1.0, 0.0]
    p = one(spark, V.token_probability(F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), F.array(F.lit(0), F.lit(1))))
    assert p == pytest.approx(0.5)
