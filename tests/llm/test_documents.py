"""Operators whose result for a document is checked against a plain brute-force version."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from orthoweave.llm import decontamination, lm_scoring, packing, quality_bands, simhash_trie, substring_dedup, token_counts, token_store
from orthoweave.llm.textcode import tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def library(path):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def key(x):
    return tuple((v is None, v) for v in x)


def same(df, columns, want):
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert got == sorted(want, key=key)


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_quality(docs, rows, empty):
    want = []
    for i, t, _ in rows:
        words = split(t)
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), failed))
    out = quality_bands.quality(docs)
    same(out, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], want)
    assert not out.where("kept and base_failed").count()
    assert quality_bands.quality(empty).count() == 0 and quality_bands.kept_documents(empty).count() == 0
    kept = quality_bands.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count() > 10


def test_quality_bands_reject_repetition_and_noise():
    rng = np.random.default_rng(1)
    import zstandard

    packer = zstandard.ZstdCompressor(level=quality_bands.LEVEL)
    noise = " ".join("".join(map(chr, rng.integers(0x21, 0x7F, 9))) for _ in range(900)).encode()
    line = " ".join(f"word{k}" for k in range(60))
    assert not quality_bands.judged(noise, packer)[6]
    assert not quality_bands.in_bands(100 * len(line), *quality_bands.ratios((line * 100).encode(), packer))
    assert quality_bands.ratios(None, packer) == (0.0, 0.0, 0.0)


def test_quality_counts_of_a_text_with_very_many_words():
    words = [f"{k:x}" for k in range(2_100_000)]
    text = " ".join([*words, *words[5:9]]).encode()
    n, _, _, _, repeated = quality_bands.measures(text)
    assert (n, repeated) == (2_100_004, 8)


def test_quality_verdicts_of_a_plain_version(docs, rows):
    """kept, recomputed from the stated limits: the band of the length, and at most a quarter of the chunks on either side."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    size = lambda b: len(packer.compress(b))
    limits = {128: (0.38, 1.05), 256: (0.40, 0.92), 512: (0.39, 0.86), 1024: (0.37, 0.80), 2048: (0.35, 0.75), 4096: (0.33, 0.72), 8192: (0.31, 0.70), 16384: (0.29, 0.68), 32768: (0.27, 0.66)}
    chunks = {128: (128, 0.33, 1.05), 512: (256, 0.35, 0.95), 1024: (512, 0.34, 0.89), 2048: (2048, 0.30, 0.78)}
    want = []
    for i, t, _ in rows:
        b, words = (t or "").encode(), split(t)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        ok = len(words) >= 50 and len(repeated) <= len(words) / 2
        if ok and len(b) >= 128:
            low, high = limits[max(x for x in limits if x <= len(b))]
            n, below, above = chunks[max(x for x in chunks if x <= len(b))]
            starts = list(range(0, len(b), n))
            each = [size(b[min(k, len(b) - n) :][:n]) / n for k in starts]
            ok = low <= size(b) / len(b) <= high and 4 * sum(x < below for x in each) <= len(each) and 4 * sum(x > above for x in each) <= len(each)
        want.append((i, ok))
    same(quality_bands.quality(docs), ["doc_id", "kept"], want)
    assert 5 < sum(ok for _, ok in want) < len(want)


@pytest.mark.parametrize("n_bytes", [4000, 3998, 1900, 1030, 1000, 500])
def test_quality_chunks_judge_every_byte(n_bytes):
    import zstandard

    packer, rng = zstandard.ZstdCompressor(level=quality_bands.LEVEL), np.random.default_rng(4)
    words = ["".join(map(chr, rng.integers(0x61, 0x7B, n))) for n in rng.integers(2, 9, 120)]
    plain = " ".join(rng.choice(words, 4000)).encode()
    noise = " ".join("".join(map(chr, rng.integers(0x21, 0x7F, 9))) for _ in range(900)).encode()
    half = 2048 if n_bytes > 2048 else n_bytes // 2
    mixed = plain[:half] + noise[: n_bytes - half]
    whole, low, high = quality_bands.ratios(mixed, packer)
    assert high > quality_bands.CHUNK_SHARE and not quality_bands.in_bands(n_bytes, whole, low, high)
    assert quality_bands.in_bands(n_bytes, whole, 0.0, 0.0)  # by the whole ratio alone it would stay
    repeated = plain[:half] + (plain[:9] * 400)[: n_bytes - half]
    assert quality_bands.ratios(repeated, packer)[1] > quality_bands.CHUNK_SHARE
    assert quality_bands.ratios(plain[:n_bytes], packer)[1:] == (0.0, 0.0)


def test_contamination(spark, docs, rows, empty, benchmark_table):
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(t))

    items = [(r.item_id, words(r.text)) for r in benchmark_table.collect()]
    want = []
    for i, t, _ in rows:
        w, hit, found = words(t), set(), set()
        for item, iw in items:
            n = min(10, len(iw))
            for a in range(len(iw) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == iw[a : a + n]:
                        hit |= set(range(b, b + n))
                        found |= {str(item)} if item is not None else set()
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    same(decontamination.contamination(docs, benchmark_table), columns, want)
    assert decontamination.contamination(empty, benchmark_table).count() == 0
    nothing = benchmark_table.limit(0)
    assert decontamination.contamination(docs, nothing).where("contaminated").count() == 0
    kept = decontamination.clean_documents(docs, benchmark_table)
    assert kept.columns == docs.columns and kept.count() == sum(not x[5] for x in want)
    spans = decontamination.hit_spans(docs, benchmark_table).collect()
    texts = {i: t for i, t, _ in rows}
    assert spans and all(s.doc_id is None or texts[s.doc_id][s.begin : s.end] == s.passage for s in spans)


def test_a_large_benchmark_is_scanned_in_one_pass(spark):
    words = [f"w{k}" for k in range(3000)]
    rng = np.random.default_rng(3)
    items = [(k, " ".join(rng.choice(words, 60))) for k in range(2500)]
    texts = [(k, " ".join([*rng.choice(words, 30), *items[7 * k][1].split()[k : k + 12], *rng.choice(words, 30)]), "en") for k in range(40)]
    found = decontamination.contamination(spark.createDataFrame(texts, "doc_id long, text string, lang string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_hit, r.n_items) for r in found.collect()}
    assert got == {k: (12, 1) for k in range(40)}
    plan = found._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") <= 3 * 2 * 4 and "Exchange" not in plan


def test_a_benchmark_beyond_the_bound_is_refused(docs, benchmark_table, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_BYTES", 100)
    with pytest.raises(ValueError, match="benchmark"):
        decontamination.contamination(docs, benchmark_table)


def brute_removals(rows):
    order = [(1 << 63) - 1 if i is None else i for i, _, _ in rows]
    words = [split(t) for _, t, _ in rows]
    low = {}
    for i, w in zip(order, words, strict=True):
        for k in range(len(w) - 12):
            x = tuple(w[k : k + 13])
            low[x] = min(low.get(x, i), i)
    out = []
    for (i, _, _), o, w in zip(rows, order, words, strict=True):
        gone = {k + j for k in range(len(w) - 12) if low[tuple(w[k : k + 13])] < o for j in range(13)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("part_runs", [20_000, 1])
def test_removals(docs, rows, empty, monkeypatch, part_runs):
    monkeypatch.setattr(substring_dedup, "PART_RUNS", part_runs)
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = brute_removals(rows)
    assert sum(x[2] > 0 for x in want) > 3
    same(substring_dedup.removals(docs), columns, want)
    assert substring_dedup.removals(empty).count() == 0


def test_removals_of_many_edits(spark):
    import random

    rng = random.Random(5)
    base = [f"b{rng.randrange(40)}" for _ in range(80)]
    rows = []
    for k in range(60):
        w = list(base[rng.randrange(30) : rng.randrange(40, 80)])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(5)}"
        rows.append((rng.randrange(40), " ".join(w), "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    same(substring_dedup.removals(df), ["doc_id", "n_words", "n_removed", "kept_sha256"], brute_removals(rows))


def test_a_shard_holds_what_smaller_documents_hold():
    import random

    rng = random.Random(11)
    made = sorted((rng.randrange(8), " ".join(rng.choice("abc") for _ in range(rng.randrange(13, 30)))) for _ in range(60))
    made += [(9, made[0][1]), (9, made[0][1] + " a b")]
    shard = substring_dedup.Shard()
    for d, text in made:
        spans, places = shard.matched(d, text.encode())
        words = text.split(" ")
        smaller = {tuple(w[k : k + 13]) for e, t in made if e < d for w in [t.split(" ")] for k in range(len(w) - 12)}
        known = [k for k in range(len(words) - 12) if tuple(words[k : k + 13]) in smaller]
        assert {k for k in range(len(words) - 12) if any(x <= k and k + 13 <= y for x, y in spans)} == set(known)
        assert places == [k for k in range(len(words) - 12) if k not in known]


def test_filters_follow_the_number_of_keys(spark):
    assert [substring_dedup.bloom_bits(n) for n in (0, 1, 1 << 20, 1 << 40)] == [20, 20, 25, 29]
    keys = spark.range(50_000).selectExpr("xxhash64(id) as h")
    found = substring_dedup.bloom(keys, "h")
    own = np.array([r.h for r in keys.collect()])
    other = np.array([r.h for r in spark.range(60_000, 90_000).selectExpr("xxhash64(id) as h").collect()])
    assert substring_dedup.in_bloom(found, own).all() and substring_dedup.in_bloom(found, other).mean() < 0.1


def test_texts_without_repeats(docs, rows):
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    want = Counter(x[3] for x in brute_removals(rows))
    assert Counter(hashlib.sha256(" ".join(split(r.text)).encode()).hexdigest() for r in out.collect()) == want
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in out.collect())


def test_suffix_automaton():
    text = list("abcabxabcd")
    found = substring_dedup.SuffixAutomaton().extend(text).extend(list("zz")).matching_statistics(list("xabcabdzz"))
    want = []
    for end in range(9):
        q = "xabcabdzz"[: end + 1]
        want.append(max(n for n in range(end + 2) if n == 0 or q[-n:] in "abcabxabcd" or q[-n:] in "zz"))
    assert found == want


def brute_fingerprint(text):
    words = split(fold(text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                label[find(a)] = find(b)
    return [find(k) for k in range(len(prints))]


@pytest.mark.parametrize("node_rows", [100_000, 3])
def test_near_duplicates(docs, rows, empty, monkeypatch, node_rows):
    monkeypatch.setattr(simhash_trie, "NODE_ROWS", node_rows)
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    parts = brute_components(prints)
    low = {}
    for (i, _, _), p in zip(rows, parts, strict=True):
        if i is not None:
            low[p] = min(low.get(p, i), i)
    want = [(i, f"{f:016x}", low.get(p)) for (i, _, _), f, p in zip(rows, prints, parts, strict=True)]
    same(simhash_trie.near_duplicates(docs), ["doc_id", "fingerprint", "component_id"], want)
    assert simhash_trie.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("node_rows", [100_000, 20])
def test_trie_components_of_random_fingerprints(spark, monkeypatch, node_rows):
    monkeypatch.setattr(simhash_trie, "NODE_ROWS", node_rows)
    rng = np.random.default_rng(2)
    prints = {int(x) for x in rng.integers(0, 1 << 62, 60)}
    for x in list(prints)[:30]:  # chains of near fingerprints
        for _ in range(6):
            x ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
            prints.add(x)
    prints = sorted(prints)
    parts = brute_components(prints)
    low = {}
    for k, p in enumerate(parts):
        low[p] = min(low.get(p, k), k)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    classes = spark.createDataFrame([(f, k) for k, f in enumerate(signed)], "fp long, low long")
    got = {r.fp: r.component for r in simhash_trie.components(classes).collect()}
    assert [got.get(f, k) for k, f in enumerate(signed)] == [low[p] for p in parts]


@pytest.mark.parametrize("node_rows", [20, 1])
def test_trie_links_across_split_bits(spark, monkeypatch, node_rows):
    monkeypatch.setattr(simhash_trie, "NODE_ROWS", node_rows)
    rng = np.random.default_rng(6)
    prints = [0, 1 << 58 | 1 << 30]  # of one low block, apart in a bit of the first division and in one below it
    for k in range(80):
        x = int(rng.integers(1 << 43)) << 21 | 0x1234
        high, middle = 58 + k % 6, int(rng.integers(21, 42))
        prints += [x, x ^ (1 << high | 1 << (middle if k % 4 else 58 + (k + 1) % 6))]
    prints += [prints[2] ^ 0b110000, prints[2] ^ 0b10001]  # apart in the last six bits
    prints = sorted(set(prints))
    parts = brute_components(prints)
    low = {}
    for k, p in enumerate(parts):
        low[p] = min(low.get(p, k), k)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    classes = spark.createDataFrame([(f, k) for k, f in enumerate(signed)], "fp long, low long")
    got = {r.fp: r.component for r in simhash_trie.components(classes).collect()}
    assert [got.get(f, k) for k, f in enumerate(signed)] == [low[p] for p in parts]


def test_deduplicated(docs, rows):
    out = simhash_trie.deduplicated(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect() if r.doc_id is not None]
    want = {r.component_id for r in simhash_trie.near_duplicates(docs).collect()} - {None}
    assert sorted(ids) == sorted(want)


def test_deduplicated_keeps_texts_that_share_an_id(spark):
    one, other = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine"
    rows = [(5, one, "a"), (5, other, "b"), (5, one, "c"), (7, one, "d"), (9, other, "e"), (None, one, "f"), (3, other + " ten", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    for parts in (1, 4):
        out = simhash_trie.deduplicated(df.repartition(parts)).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in out if r.doc_id != 3) == sorted([(False, 5, one), (False, 5, other), (True, 0, one)])
        assert {r.mark for r in out if r.doc_id == 5 and r.text == one} <= {"a", "c"}
    assert len({tuple(sorted(r.mark for r in simhash_trie.deduplicated(df.repartition(p)).collect())) for p in (1, 2, 5)}) == 1


def test_token_store(docs, rows, empty):
    encode = library(WORD)
    want, at = [], 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    made = token_store.read_shards(token_store.write_shards(docs, WORD, shard_tokens=3000)).collect()
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in made}
    nulls = [r for r in order if r[0] is None]
    crc = lambda t: (len(encode(t)) + 1, zlib.crc32(np.array([*encode(t), 2], dtype="<u4").tobytes()))
    assert sorted(v for (i, _), v in got.items() if i is None) == sorted(crc(r[1]) for r in nulls)
    at = sum(crc(r[1])[0] for r in nulls)
    for i, t, _ in order[len(nulls) :]:
        want.append(((i, at), crc(t)))
        at += crc(t)[0]
    assert sorted((k, v) for k, v in got.items() if k[0] is not None) == want
    assert len(made) == len(rows)
    assert token_store.read_shards(token_store.write_shards(empty, WORD)).count() == 0


def test_shards_decode_any_slice():
    rng = np.random.default_rng(0)
    for n, v in ((1, 5), (2, 5), (400, 2), (5000, 4), (20000, 50)):
        ids = rng.integers(0, v, n).astype(np.uint32)
        cuts = np.unique(np.r_[rng.integers(1, n + 1, 5), n])
        lengths = np.diff(cuts, prepend=0)
        shard = token_store.Shard(token_store.pack_shard([None, *range(len(cuts) - 1)], ids, lengths, 7, 60))
        assert (shard.all_ids() == ids).all() and shard.before == 7 and shard.doc_ids[0] is None
        for k, (end, length) in enumerate(zip(cuts, lengths, strict=True)):
            doc = ids[end - length : end].tolist()
            for a, b in [(0, None), *(sorted(rng.integers(0, length + 1, 2)) for _ in range(4))]:
                assert shard.document(k, a, b) == doc[a:b]
    assert len(shard.left) > 10 and len(shard.symbols) < len(ids)


def test_shards_go_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(8)
    passage = rng.integers(0, 900, 700)
    copies = np.concatenate([passage] * 40)
    for ids in (copies, np.r_[copies, rng.integers(0, 900, 30_000)], np.repeat([3, 4], 5000), np.tile([7, 7, 7, 9], 500)):
        last = np.zeros(len(ids), dtype=bool)
        last[999::1000] = last[-1] = True
        seq, ends, left, right = token_store.re_pair(ids.astype(np.uint32), last, 1000, 1 << 20)
        places = {}
        for k, (pair, end) in enumerate(zip(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True), ends[:-1].tolist(), strict=True)):
            if not end and places.setdefault(pair, [-2])[-1] != k - 1:  # places of a pair that don't overlap
                places[pair].append(k)
        assert max(map(len, places.values()), default=1) - 1 < token_store.LEAST
        flat, start, length = token_store.expansions(left, right, 1000)
        assert (np.concatenate([flat[start[x] : start[x] + length[x]] for x in seq]) == ids).all()


def test_token_counts(docs, rows, empty, monkeypatch):
    encode = library(BYTE)
    want = [(i, len((t or "").encode()), len(encode(t)), len(encode(t)) > 512) for i, t, _ in rows]
    columns = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    same(token_counts.token_counts(docs, BYTE), columns, want)
    monkeypatch.setattr(token_counts, "HOT", 3)
    same(token_counts.token_counts(docs, BYTE), columns, want)
    assert token_counts.token_counts(empty, BYTE).count() == 0
    other = library(WORD)
    same(token_counts.token_counts(docs, WORD), ["doc_id", "n_tokens"], [(i, len(other(t))) for i, t, _ in rows])


def check_packing(made, rows, encode):
    want = Counter((i, tuple([*encode(t), 0])) for i, t, _ in rows)
    lengths = Counter()
    for (i, ids), n in want.items():
        first = len(ids) % 2048 if len(ids) > 2048 else len(ids)
        cuts = [(0, first)] * (first > 0) + [(k, 2048) for k in range(first, len(ids), 2048)]
        for k, (start, length) in enumerate(cuts):
            lengths[i, k, start, length, zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in made) == lengths
    bins = {}
    for r in made:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), -(-sum(r.length for r in made) // 2048)


def test_packing(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    n, least = check_packing(packing.packed_pieces(docs, BYTE).collect(), rows, library(BYTE))
    assert n <= least + 2
    assert packing.packed_pieces(empty, BYTE).count() == 0


@pytest.mark.parametrize("tasks", [1, 7, 64])
def test_bins_left_behind_could_not_be_used(spark, monkeypatch, tasks):
    rng = np.random.default_rng(tasks)
    rows = []
    for task in range(tasks):  # many bins of few fills over half full, and one under half, as best-fit leaves them
        fills = [int(x) for x in rng.choice([1100, 1101, 1500, 1990], 40)] + [int(rng.integers(1, 1000))]
        rows += [(task << 33 | k, f, task) for k, f in enumerate(fills)]
    rest = spark.createDataFrame(rows, "bin long, fill long, grp long").repartition(4)
    made = []
    for cut in (True, False):
        if not cut:
            monkeypatch.setattr(packing, "of_use", lambda fill, room, most: fill < room)
        moves = packing.merged_bins(rest).collect()
        places = {r.bin: (r.into, r.shift) for r in moves}
        assert set(places) == {r[0] for r in rows}
        by_bin = {}
        for number, fill, _ in rows:
            by_bin.setdefault(places[number][0], []).append((places[number][1], fill))
        for parts in by_bin.values():
            at = 0
            for shift, fill in sorted(parts):
                assert shift == at
                at += fill
            assert at <= 2048
        made.append(len(by_bin))
    assert made[0] == made[1] < len(rows)


def test_best_fit():
    sizes = np.array([5, 7, 3, 2, 10, 1, 4])
    bins, offsets, fill = packing.best_fit(sizes, 10)
    assert fill.sum() == sizes.sum() and len(fill) == 4 and fill.max() <= 10
    assert packing.pieces(2048) == [(0, 2048)] and packing.pieces(4100) == [(0, 4), (4, 2048), (2052, 2048)] and packing.pieces(4096) == [(0, 2048), (2048, 2048)]


@pytest.mark.parametrize("hot", [150_000, 3])
def test_language_model(docs, rows, empty, monkeypatch, hot):
    import math

    monkeypatch.setattr(lm_scoring, "HOT", hot)
    tokens = [[*split(fold(t)), "\n"] for _, t, _ in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _, _ in rows]
    c = Counter(w for h, t in zip(held, tokens, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    out = lm_scoring.scores(docs).collect()
    got = sorted((key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens)), r.base_score) for r in out)
    want = sorted((key((i, h, len(t), sum(c[w] > 0 for w in t), n)), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for (i, _, _), h, t in zip(rows, held, tokens, strict=True))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want])
    assert all(r.score < 0 for r in out)
    if hot == 3:
        none = lm_scoring.scores(empty)
        assert none.count() == 0
