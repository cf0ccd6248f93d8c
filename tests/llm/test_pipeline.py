"""The pipeline's stages against the operators' own verdicts."""

import corpus_pipeline
import pytest

from orthoweave.llm import common, decontamination, quality_bands, simhash_trie
from orthoweave.llm.textcode import tokenizer_path

ROOT = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "decontaminate", "pack"]
    first = corpus_pipeline.quality_rules(spark, docs, ROOT).cache()
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in quality_bands.quality(docs).where("kept").collect()}
    second = corpus_pipeline.near_dedup(spark, first, ROOT).cache()
    assert {r.doc_id for r in second.collect()} == {r.component_id for r in simhash_trie.near_duplicates(first).collect()}
    third = corpus_pipeline.substring_dedup(spark, second, ROOT).cache()
    assert third.count() == second.count() and third.columns == docs.columns
    bench = spark.read.parquet(f"{ROOT}/benchmark.parquet")
    fourth = corpus_pipeline.decontaminate(spark, third, ROOT).cache()
    assert {r.doc_id for r in fourth.collect()} == {r.doc_id for r in decontamination.contamination(third, bench).where("not contaminated").collect()}
    packed = corpus_pipeline.pack(spark, fourth, ROOT)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in fourth.collect()}
    whole = corpus_pipeline.run(spark, ROOT)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(columns).collect())) == sorted(map(tuple, packed.select(columns).collect()))


def plain_run(docs, items):
    """(doc_id, text) that the first four stages leave, by plain loops over rows (doc_id, text) with ids of their own."""
    import re

    import xxhash
    import zstandard

    packer = zstandard.ZstdCompressor(level=quality_bands.LEVEL)
    rows = [(i, t) for i, t in docs if quality_bands.judged(None if t is None else t.encode(), packer)[6]]

    def words(t):
        return re.findall("[^\x20\x09-\x0d]+", t)

    def print_of(t):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), seed=42) for k in range(len(w) - 2)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: print_of(t) for i, t in rows}
    low = {i: i for i in prints}
    moved = True
    while moved:
        moved = False
        for a in prints:
            for b in prints:
                if low[b] > low[a] and bin(prints[a] ^ prints[b]).count("1") <= 2:
                    low[b], moved = low[a], True
    rows = sorted((i, t) for i, t in rows if low[i] == i)
    first: dict[tuple, int] = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = []
    for i, t in rows:
        at = [m.span() for m in re.finditer("[^\x20\x09-\x0d]+", t)]
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        if gone:
            keep = [k for k in range(len(w)) if k not in gone]
            parts, run = [], []
            for k in keep:
                if run and k != run[-1] + 1:
                    parts.append(run)
                    run = []
                run.append(k)
            t = " ".join(t[at[r[0]][0] : at[r[-1]][1]] for r in [*parts, run] if r)
        out.append((i, t))

    def plain(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    windows = {n: set() for n in range(1, 11)}
    for t in items:
        w = plain(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[n].add(tuple(w[k : k + n]))
    clean = []
    for i, t in out:
        w = plain(t)
        if not any(tuple(w[k : k + n]) in found for n, found in windows.items() if found for k in range(len(w) - n + 1)):
            clean.append((i, t))
    return clean


def test_run_equals_a_plain_version(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    left = plain_run(docs, items)
    encode = Tokenizer.from_file(tokenizer_path(corpus_pipeline.TOKENIZER))
    want = []
    for i, t in left:
        ids = [*encode.encode(t, add_special_tokens=False).ids, 0]
        begin = len(ids) % 2048 if len(ids) > 2048 else len(ids)
        cuts = [(0, begin)] * (begin > 0) + [(k, 2048) for k in range(begin, len(ids), 2048)]
        want += [(i, k, a, n, zlib.crc32(np.array(ids[a : a + n], dtype="<u4").tobytes())) for k, (a, n) in enumerate(cuts)]
    made = corpus_pipeline.run(spark, ROOT)
    rows = made.collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want) and 50 < len(left) < len(docs)
    fills: dict[int, int] = {}
    for r in rows:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= 2048 and len(fills) <= -(-sum(fills.values()) // 2048) + 2


def test_run_leaves_one_table_and_takes_an_empty_one(spark, empty, benchmark_table, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda s: f"file://{tmp_path}/shared")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark_table.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    tables = [p.name for p in (tmp_path / "shared").iterdir()]
    assert [t.split("-")[0] for t in tables] == ["decontaminate"]


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_of_odd_tables(spark, docs, empty, stage, tmp_path, benchmark_table):
    benchmark_table.write.parquet(f"{tmp_path}/benchmark.parquet")
    f = corpus_pipeline.STAGES[stage][1]
    out = f(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    assert f(spark, empty, str(tmp_path)).count() == 0
