import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import orthoweave.__main__ as command
from orthoweave.plans import analyses
from orthoweave.sources import fixtures, tabs, words
from orthoweave.streaming import details


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for k, (name, text) in enumerate(fixtures.TAB_FILES):
        (tmp_path / "in" / ("deep" if k % 2 else ".") / name).write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_build(spark, folder):
    version = tabs.build(spark, f"{folder}/in", f"{folder}/out")
    got = tabs.open_tables(spark, f"{folder}/out")
    rows = {(r.lang, r.lemma, r.synset_offset, r.pos) for r in got["lemmas"].collect()}
    assert rows == {("eng", "ring", "90000001", "n"), ("eng", "gear", "90000016", "n"), ("ita", "anello", "90000001", "n"), ("ita", "ingranaggio", "90000016", "n"), ("eng", "bolt", "90000003", "n")}
    assert {r["def"] for r in got["definitions"].collect()} == {"a round band", "ruota con denti"}
    assert [(r.lang, r.name, r.url, r.license) for r in got["sources"].orderBy("lang").collect()] == [("eng", "Own English", "https://example.org/eng", "CC0"), ("ita", "Own Italian", None, "CC BY")]
    lines = [r.line for r in tabs.attribution(got["sources"]).collect()]
    assert lines[0].startswith("| Lang") and any("CC0" in x for x in lines)
    with pytest.raises(FileNotFoundError):
        (Path(folder) / "none").mkdir()
        tabs.build(spark, f"{folder}/none", f"{folder}/out")
    assert tabs.current(spark, f"{folder}/out") == version
    again = tabs.build(spark, f"{folder}/in", f"{folder}/out")
    assert tabs.current(spark, f"{folder}/out") == again != version
    assert spark.read.parquet(f"{version}/lemmas").count() == 5  # readers of the version before go on


def test_a_build_that_fails_at_any_step_leaves_the_last_version(spark, folder, monkeypatch):
    version = tabs.build(spark, f"{folder}/in", f"{folder}/out")
    for name in ("lemma_rows", "definition_rows", "source_rows", "_checked"):
        with monkeypatch.context() as m:
            m.setattr(tabs, name, lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                tabs.build(spark, f"{folder}/in", f"{folder}/out")
        assert tabs.current(spark, f"{folder}/out") == version
    (Path(folder) / "bare").mkdir()
    (Path(folder) / "bare" / "wn-data-eng.tab").write_text("# head\n")
    with pytest.raises(ValueError, match="lemma"):
        tabs.build(spark, f"{folder}/bare", f"{folder}/out")
    assert tabs.current(spark, f"{folder}/out") == version


def test_a_built_lexicon_serves_the_analyses(spark, folder, tmp_path):
    tabs.build(spark, f"{folder}/in", f"{folder}/out")
    (tmp_path / "stop").mkdir()
    (tmp_path / "stop" / "stopwords-en.txt").write_text("Gear\n")
    lex = tabs.open_lexicon(spark, f"{folder}/out", stopwords=str(tmp_path / "stop"))
    rows = spark.createDataFrame([(1, "a ring and a gear and a bolt", "eng")], "text_id long, text string, lang string")
    choice = analyses.Choice(0.0, 0.25)
    got = {r.target_lang: (r.score, r.n_units, r.analysed_units) for r in analyses.text_transparency(rows, lex, choice).collect()}
    assert got["ita"][1:] == (2, 1) and got["eng"][0] == 0.5  # gear is a stopword, bolt has no definition
    given = command.parser().parse_args(["text", "eng", "--lexicon", f"{folder}/out", "--phrases", "2"])
    made = command.frames(spark, given, "a ring and a gear")
    assert made["coverage"].first().considered_words == 2 and any("Italian" in r.line for r in made["report"].collect())
    listed = command.frames(spark, command.parser().parse_args(["senses", "ring", "eng", "--lexicon", f"{folder}/out"]), "")["senses"]
    assert {r.words for r in listed.collect()} == {"ring", "anello"}
    table = command.frames(spark, command.parser().parse_args(["sources", f"{folder}/out"]), "")["sources"]
    assert any("CC0" in r.line for r in table.collect())


def test_stopword_files(spark, tmp_path):
    (tmp_path / "stopwords-en.txt").write_text("# own\n\n Foo \nthe\n")
    built_in = spark.createDataFrame(fixtures.stopword_rows(), "lang string, word string")
    got = words.stopword_overlay(spark, str(tmp_path), built_in)
    assert got.where("lang = 'eng' and word = 'foo'").count() == 1 and got.where("lang = 'eng' and word = 'the'").count() == 1
    assert got.count() == built_in.distinct().count() + 1


LICENCE = "  1 This software is WordNet 3.0 Copyright\n"


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "data.noun").write_text(LICENCE + "00001740 03 n 02 entity 0 good_thing(a) 1 001 ~ 00001930 n 0000 | that which is | so\n00001930 03 n 01 being 0 002 @ 00001740 n 0000 + 00002000 v 0101 | what is\n")
    (tmp_path / "data.verb").write_text(LICENCE + "00002000 29 v 01 be 0 000 02 + 08 00 + 01 01 | exist\n")
    (tmp_path / "index.noun").write_text(LICENCE + "entity n 1 1 ~ 1 0 00001740  \nbeing n 2 2 @ + 2 1 00001930 00001740  \n")
    (tmp_path / "noun.exc").write_text("geese goose\nmice mouse\n")
    (tmp_path / "verb.Framestext").write_text("1  Something ----s\n8  Somebody ----s something\n")
    folder = str(tmp_path)
    rows = words.wordnet_data(spark, folder).where("pos = 'n'").orderBy("synset_offset", "sense_order").collect()
    assert [(r.synset_offset, r.pos, r.lemma, r["def"]) for r in rows] == [("00001740", "n", "entity", "that which is | so"), ("00001740", "n", "good_thing", "that which is | so"), ("00001930", "n", "being", "what is")]
    assert {tuple(r) for r in words.wordnet_relations(spark, folder).collect()} == {("00001740", "n", "hyponym", "00001930", "n"), ("00001930", "n", "hypernym", "00001740", "n")}
    assert {r.frame for r in words.wordnet_frames(spark, folder).collect()} == {"Something ----s", "Somebody ----s something"}
    assert {tuple(r) for r in words.wordnet_index(spark, folder).collect()} == {("entity", "n", "00001740", 1), ("being", "n", "00001930", 1), ("being", "n", "00001740", 2)}
    assert {tuple(r) for r in words.wordnet_exceptions(spark, folder).collect()} == {("n", "geese", "goose"), ("n", "mice", "mouse")}
    (tmp_path / "data.adv").write_text("  1 This software is WordNet 2.1 Copyright\n")
    with pytest.raises(ValueError, match="data.adv"):
        words.wordnet_data(spark, folder)


def test_stream_is_the_batch(spark, tmp_path):
    lex = fixtures.lexicon(spark)
    rows = spark.createDataFrame([(1, "a reed and gear", "eng"), (2, "the anvil", "eng"), (3, "nothing", "eng")], "text_id long, text string, lang string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = details.text_stream(spark, f"{tmp_path}/in", "text_id long, text string, lang string")
    got = details.drained(details.unit_words(stream, lex), f"stream-{uuid.uuid4().hex}")
    want = details.unit_words(rows, lex)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 10
    ranking = details.drained(details.running_ranking(details.unit_words(stream, lex)), f"ranking-{uuid.uuid4().hex}", "complete")
    assert ranking.count() == details.running_ranking(want).count()


def test_german_is_for_comparison_only(spark):
    rows = words.texts(spark.createDataFrame([(1, "x", "de"), (2, "y", "en")], "id long, body string, lang string"), "id", "body", "lang")
    assert [r.lang for r in analyses.supported_texts(rows).collect()] == ["eng"] and analyses.supported_texts(rows, german=True).count() == 2


def test_a_row_group_of_texts_is_not_held_outside_the_heap(spark, tmp_path):
    """The direct memory of the JVM doesn't grow by the size of a row group that is read."""
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    from orthoweave.plans import queries

    draw = random.Random(3)
    rows = [draw.randbytes(1 << 17).hex() for _ in range(256)]
    table = pa.table({"doc_id": pa.array(range(len(rows)), pa.int64()), "text": rows, "lang": ["en"] * len(rows)})
    pq.write_table(table, tmp_path / "documents.parquet", compression="none", use_dictionary=False)
    java = spark._jvm.java.lang
    pools = java.management.ManagementFactory.getPlatformMXBeans(java.Class.forName("java.lang.management.BufferPoolMXBean"))
    direct = next(p for p in pools if p.getName() == "direct")
    held = direct.getMemoryUsed()
    docs = queries._docs(spark, str(tmp_path))
    assert docs.agg(F.sum(F.length("text"))).first()[0] == 256 << 18
    assert direct.getMemoryUsed() - held < 16 << 20


def test_a_large_row_group_is_dealt_out(spark, tmp_path, monkeypatch):
    """Rows of one large row group get to all cores, none lost; a table in small row groups is read where it lies."""
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    from orthoweave.functions import joins

    monkeypatch.setattr(joins, "DEALT_BYTES", 1 << 10)
    monkeypatch.setattr(joins, "COARSE_BYTES", 1 << 18, raising=False)
    draw = random.Random(5)
    rows = [draw.randbytes(64).hex() for _ in range(8192)]
    table = pa.table({"text_id": pa.array([k // 2 for k in range(len(rows))], pa.int64()), "text": rows})
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 17)
    try:
        for name, size in (("large", len(rows)), ("small", 512)):
            pq.write_table(table, tmp_path / name, row_group_size=size, compression="none", use_dictionary=False)
        large, small = words.stored(spark, f"{tmp_path}/large"), words.stored(spark, f"{tmp_path}/small")
        got = joins.dealt(large)
        counts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(counts) == 4 and max(counts) < 0.4 * len(rows)
        assert got.columns == large.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, large.collect()))
        assert joins.dealt(small) is small
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
