"""Helpers of the text operators against plain versions."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orthoweave.llm import common, sampling, textcode, token_counts
from orthoweave.llm.textcode import Encoder, tokenizer_path

PIECES = st.sampled_from(["a", "Word", "é", "É", "œ", "×", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "'s", "'", "1", "23", "<|endoftext|>", "<|", ".", ",", "!!", "\x01", "\x02", "\x0b", "\x1f", "\x85", "漢字", "ß", "İ", "́", "한", "🙂", "_", "\x00"])
TEXT = st.lists(PIECES, max_size=25).map("".join)
_made: dict = {}


def both(name):
    from tokenizers import Tokenizer

    if name not in _made:
        _made[name] = Encoder(tokenizer_path(name), limit=40), Tokenizer.from_file(tokenizer_path(name))
    return _made[name]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(TEXT, max_size=6))
def test_encoder_is_the_library(name, texts):
    coder, library = both(name)
    ids, lengths = coder.encode([t.encode() for t in texts])
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=200, deadline=None)
@given(text=TEXT)
def test_odd_texts_are_cut_where_nothing_reaches_over(text):
    _, library = both("byte_bpe_50k.json")
    usual, strange = token_counts.PreTokens(tokenizer_path("byte_bpe_50k.json")).segments(text.encode())
    count = lambda x: len(library.encode(x, add_special_tokens=False).ids)
    assert sum(count(p.decode()) for p in usual + strange) == count(text)
    assert sorted("".join(p.decode() for p in usual + strange)) == sorted(text)


@pytest.mark.parametrize("kind", ["led", "apart"])
@settings(max_examples=200, deadline=None)
@given(chunks=st.lists(st.text(alphabet="aZéÉœ×÷ ǿɏɐß.,!漢", max_size=5).map(str.encode), max_size=8))
def test_words_and_marks(kind, chunks):
    word = textcode._PLAIN[kind].fullmatch
    plain, marked = textcode.words_and_marked(chunks, kind)
    assert plain.tolist() == [word(c) is not None for c in chunks]
    assert marked.tolist() == [c[-1:] in (b".", b",") and word(c[:-1]) is not None for c in chunks]


@settings(max_examples=200, deadline=None)
@given(chunks=st.lists(st.text(alphabet="aZé$&!'\"|>._9 漢", max_size=6).map(str.encode), max_size=8))
def test_words_and_tails_of_marks(chunks):
    tail = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]+)").fullmatch
    plain, tails = textcode.words_and_tails(chunks, "apart")
    assert plain.tolist() == [textcode._PLAIN["apart"].fullmatch(c) is not None for c in chunks]
    assert tails.tolist() == [len(m[2]) if (m := tail(c)) else 0 for c in chunks]


def test_a_word_with_a_tail_of_marks_takes_its_ids_from_the_known_word(monkeypatch):
    coder, library = both("word_bpe_49k.json")
    texts = ["reed", "reed$$$ reed.%%% reed!! reed&&& reed***"]
    coder._forget()
    coder.encode([texts[0].encode(), b"$$$ .%%% !! &&& ***"])
    asked = []
    encode = coder._encode_chunks
    monkeypatch.setattr(coder, "_encode_chunks", lambda chunks: asked.append(chunks) or encode(chunks))
    ids, _ = coder.encode([texts[1].encode()])
    assert ids.tolist() == library.encode(texts[1], add_special_tokens=False).ids and not asked


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words(texts):
    distinct, codes, counts = common.split_words([None if t is None else t.encode() for t in texts])
    want = [[w.encode() for w in re.findall("[^\x20\x09-\x0d]+", t or "")] for t in texts]
    assert counts.tolist() == [len(w) for w in want] and [distinct[c] for c in codes] == [x for w in want for x in w]


def test_slices_hold_every_row():
    b = pa.RecordBatch.from_pydict({"id": list(range(9)), "text": ["x" * n for n in (1, 50, 3, 0, 200, 7, 7, 7, 7)]})
    parts = list(common.sliced([b], limit=40))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(9)) and len(parts) > 3
    assert list(common.sliced([b.slice(0, 0)])) == []


def test_ranges_and_sums():
    assert common.ranges(np.array([5, 1, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert common.sums(np.array([1, 2, 3, 4]), np.array([2, 0, 2])).tolist() == [3, 0, 7]


def test_first_by_hash(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "if(id % 100 = 0, 'rare', 'common') as kind")
    got = sampling.first_by_hash(rows, "kind", 40)
    assert {r.kind: r["count"] for r in got.groupBy("kind").count().collect()} == {"rare": 40, "common": 40}
    assert sampling.first_by_hash(rows, "kind", 10_000).count() == 5000


def test_most_frequent(spark):
    counts = spark.createDataFrame([(f"w{k}", n) for k, n in enumerate([1000, 500, 500, 40, 3, 3, 3, 1])], "word string, n long")
    got = {most: sorted(r.n for r in sampling.most_frequent(counts, "n", most).collect()) for most in (0, 1, 2, 3, 5, 100)}
    assert got[0] == [] and got[1] == [1000] and got[2] == [1000] and got[3] == [500, 500, 1000] and got[5] == [40, 500, 500, 1000] and len(got[100]) == 8
    assert sampling.most_frequent(counts.limit(0), "n", 3).count() == 0


def test_written_tables_can_be_dropped(spark):
    df = common.written(spark.range(7).toDF("x"), "seven", files=1)
    assert df.count() == 7 and len(df.inputFiles()) == 1
    common.discard(df)
    with pytest.raises(Exception):  # noqa: B017  the files are gone
        spark.read.parquet(df.inputFiles()[0]).count()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_known_chunks_are_looked_up_once(name):
    """A chunk met before costs one look at what is known, and odd white space is still found."""
    class Counted(dict):
        looks = 0

        def get(self, *x):
            Counted.looks += 1
            return dict.get(self, *x)

        def __getitem__(self, x):
            Counted.looks += 1
            return dict.__getitem__(self, x)

    coder = textcode.Encoder(textcode.tokenizer_path(name))
    text = " ".join(f"word{k}x été{k}, plain." for k in range(300)).encode()
    first, _ = coder.encode([text])
    coder.known = Counted(coder.known)
    again, _ = coder.encode([text, None, b""])
    assert first.tolist() == again.tolist() == coder.tokenizer.encode(text.decode(), add_special_tokens=False).ids
    assert Counted.looks == len(coder._pieces([text, b"", b""])[0])
    for char in map(chr, range(0x80, 0x3100)):
        t = f"é{char}a".encode()
        assert textcode.odd(t) == (textcode._ODD.search(t) is not None)
