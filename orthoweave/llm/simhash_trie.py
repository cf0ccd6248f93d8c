"""SimHash near-duplicates by a binary trie self-join.

Fingerprints of 64 bits are the bitwise majority of XXH64 hashes of 3-word shingles. Two of them link when at
most two bits differ. The distinct fingerprints are stored in binary tries and node pairs are traversed
together, adding up the differing bits and dropping a pair as soon as they exceed the budget.

Distribution: two fingerprints within two bits agree in one of three bit blocks, so each block's value is the
root of one trie; every fingerprint is in three. A trie with more than ``NODE_ROWS`` fingerprints is
divided into its node pairs six levels further down (those within the budget), again and again, before any
task reads it, so no task holds more than that besides one batch. Every task joins its tries, reduces the
links to a star for each connected part, and the parts are merged by minimum labels with pointer jumping over
tables in the shared folder. Exact copies are one fingerprint class from the start and are never paired.

Defined cases: null or wordless texts have fingerprint zero, which links like any other; fewer than three
words make one shingle; very long texts are read whole; a bit that exactly half the shingles set is 0; repeated rows each get a row; a null doc_id counts as larger than any other and is
returned as null if nothing smaller is reachable; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import LAST_ID, as_bytes, discard, doc_text, kept, map_batches, prepared, spread, written

SHINGLE, SEED, BUDGET = 3, 42, 2
#: (shift, bits) of the three blocks.
BLOCKS = ((42, 22), (21, 21), (0, 21))
#: Distinct fingerprints that one trie node pair may hold in a task.
NODE_ROWS = 100_000
SPLIT_BITS = 6
ROWS_PER_FILE = 1_000_000


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    hashes = np.array([digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:], strict=False)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in as_bytes(b.column(1))], dtype=np.uint64)
            yield {"doc_id": b.column(0), "fp": fps.view(np.int64)}

    return map_batches(doc_text(docs), run, "doc_id long, fp long")


def trie_links(fps: np.ndarray, node: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that link. Each node is joined with itself (side 0) or its side 1 with its side 2.

    The rows must be sorted by node, side, fps. Whole fingerprints are walked, the bits a node was divided at among them.
    """
    n = len(fps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (side[1:] != side[:-1])])
    ends = np.r_[edge[1:], n]
    alone = side[edge] == 0
    pair = np.flatnonzero((side[edge[:-1]] == 1) & (side[edge[1:]] == 2) & (node[edge[:-1]] == node[edge[1:]])) if len(edge) > 1 else np.zeros(0, np.int64)
    a_lo, a_hi = np.r_[edge[alone], edge[pair]], np.r_[ends[alone], ends[pair]]
    b_lo, b_hi = np.r_[edge[alone], edge[pair + 1]], np.r_[ends[alone], ends[pair + 1]]
    e = np.zeros(len(a_lo), dtype=np.int8)
    for bit in range(63, -1, -1):
        ones = np.r_[0, np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        same = a_lo == b_lo
        kids = (
            (a_lo, a_mid, b_lo, b_mid, e, None),
            (a_mid, a_hi, b_mid, b_hi, e, None),
            (a_lo, a_mid, b_mid, b_hi, e + 1, None),
            (a_mid, a_hi, b_lo, b_mid, e + 1, ~same),
        )
        parts = []
        for al, ah, bl, bh, err_, only in kids:
            ok = (al < ah) & (bl < bh) & (err_ <= BUDGET)
            # one fingerprint against itself is no link
            ok &= ~((al == bl) & (ah - al == 1) & (ah == bh))
            if only is not None:
                ok &= only
            parts.append((al[ok], ah[ok], bl[ok], bh[ok], err_[ok]))
        a_lo, a_hi, b_lo, b_hi, e = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(a_lo):
            break
    return a_lo, b_lo


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest position in each position's connected part."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new


def _tries(classes: DataFrame) -> DataFrame:
    """(fp, node, side): each fingerprint in the tries of its three blocks, large tries divided.

    While dividing, err holds the bits that a node's two sides differ by in those it was divided at.
    """
    blocks = F.array(*[F.struct(F.concat(F.lit(f"{k}:"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << n) - 1)).cast("string")).alias("node")) for k, (s, n) in enumerate(BLOCKS)])
    rows = classes.select("fp", F.explode(blocks).alias("x")).select("fp", "x.node", F.lit(0).alias("side"), F.lit(0).alias("err"))
    for top in range(64, 0, -SPLIT_BITS):
        large = rows.groupBy("node").count().where(F.col("count") > NODE_ROWS).select("node")
        if not large.take(1):
            break
        large = written(large, "large-tries").withColumn("large", F.lit(True))
        marked = written(rows.join(large, "node", "left"), "tries")
        bits = min(SPLIT_BITS, top)
        own = F.shiftrightunsigned("fp", top - bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        apart = F.bit_count(F.col("own").bitwiseXOR(F.col("other"))).cast("int")
        first = F.when(F.col("side") == 0, F.least("own", "other")).when(F.col("side") == 1, F.col("own")).otherwise(F.col("other"))
        second = F.when(F.col("side") == 0, F.greatest("own", "other")).when(F.col("side") == 1, F.col("other")).otherwise(F.col("own"))
        split = (
            marked.where("large")
            .withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1))))
            .withColumn("apart", apart)
            .where(F.col("err") + F.col("apart") <= BUDGET)
            .select(
                "fp",
                F.concat_ws("|", "node", first.cast("string"), second.cast("string")).alias("node"),
                F.when(F.col("side") != 0, F.col("side")).when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
                (F.col("err") + F.col("apart")).alias("err"),
            )
        )
        rows = written(marked.where("large is null").select("fp", "node", "side", "err").unionByName(split), "tries")
    return rows.drop("err")


def stars(classes: DataFrame) -> DataFrame:
    """(fp, root): every linked fingerprint with the root of its part in each trie, the root among them."""
    rows = _tries(classes)
    dealt = rows.repartition(spread(rows), "node").sortWithinPartitions("node", "side")

    def joined(held):
        node, side, fp = (np.concatenate([h[k] for h in held]) for k in range(3))
        _, number = np.unique(node, return_inverse=True)
        order = np.lexsort((fp, side, number))
        number, side, fp = number[order], side[order], fp[order]
        u, v = trie_links(fp, number, side)
        root = local_roots(len(fp), u, v)
        linked = np.zeros(len(fp), dtype=bool)
        linked[u] = linked[v] = True
        return {"fp": fp[linked].view(np.int64), "root": fp[root[linked]].view(np.int64)}

    def run(batches):
        held, size = [], 0
        for b in batches:
            node = np.array(b.column(1).to_pylist(), dtype=object)
            columns = [node, b.column(2).to_numpy(), b.column(0).to_numpy().view(np.uint64)]
            if size > NODE_ROWS:  # end what is held at the last change of node
                change = np.flatnonzero(node != held[-1][0][-1])
                cut = int(change[0]) if len(change) else len(node)
                held.append([c[:cut] for c in columns])
                columns = [c[cut:] for c in columns]
                if len(columns[0]):
                    yield joined(held)
                    held, size = [], 0
            held.append(columns)
            size += len(columns[0])
        if held:
            yield joined(held)

    return map_batches(dealt, run, "fp long, root long").distinct()


def components(classes: DataFrame) -> DataFrame:
    """(fp, component) of the linked fingerprints; classes: (fp, low), low the smallest doc_id of the class."""
    files = 1 + classes.count() // ROWS_PER_FILE  # a class has at most three rows in the tables below
    links = stars(classes)
    state = written(links.join(classes, "fp").select("fp", "root", F.col("low"), F.col("low").alias("label")), "labels", files)
    while True:
        by_root = state.groupBy("root").agg(F.min("label").alias("by_root"))
        by_fp = kept(state.join(by_root, "root").groupBy("fp").agg(F.first("low").alias("low"), F.min("by_root").alias("new")))
        jump = by_fp.select(F.col("low").alias("new"), F.col("new").alias("jump")).groupBy("new").agg(F.min("jump").alias("jump"))
        jumped = by_fp.join(jump, "new", "left").select("fp", F.least("new", F.coalesce("jump", "new")).alias("new"))
        after = written(state.join(jumped, "fp").select("fp", "root", "low", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved")), "labels", files)
        discard(by_fp, state)
        if not after.where("moved").take(1):
            return after.groupBy("fp").agg(F.min("label").alias("component"))
        state = after.drop("moved")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprint in hex, and component_id, the smallest doc_id reachable by links."""
    prints = kept(fingerprints(docs))
    classes = kept(prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(LAST_ID))).alias("low")))
    found = classes.join(components(classes), "fp", "left").select("fp", F.coalesce("component", "low").alias("component"))
    return prints.join(found, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component") < LAST_ID, F.col("component")).alias("component_id"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The first document (by doc_id) of each component, with all columns; documents without a doc_id are left alone.

    Rows that share a kept doc_id: one of each fingerprint stays, that with the least hash of its columns, so no text is lost to
    another that it doesn't resemble, and the result doesn't depend on the order of rows.
    """
    own = docs.toDF(*[f"_c{k}" if c not in ("doc_id", "text") else c for k, c in enumerate(docs.columns)])
    ids = kept(near_duplicates(docs).where("doc_id is not null").select("doc_id", "fingerprint", (F.col("doc_id") == F.col("component_id")).alias("first")))
    # an id with one fingerprint needs no look at its texts, and mostly there are no others
    per_id = ids.groupBy(F.col("doc_id").alias("_kept")).agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high"), F.max("first").alias("first"))
    per_id = kept(per_id.where("first").select("_kept", (F.col("low") != F.col("high")).alias("_many")))
    numbered = own.where("doc_id is not null")
    same = F.col("doc_id").cast("long") == F.col("_kept")
    both = numbered.join(per_id.where("not _many"), same).withColumn("_print", F.lit(""))
    if per_id.where("_many").take(1):
        several = _with_fingerprint(numbered.join(per_id.where("_many"), same))
        prints = ids.where("first").select(F.col("doc_id").alias("_kept"), F.col("fingerprint").alias("_print")).distinct()
        both = both.unionByName(several.join(prints, ["_kept", "_print"], "left_semi").select(both.columns))
    turn = F.row_number().over(Window.partitionBy("_kept", "_print").orderBy(F.xxhash64(*own.columns), F.xxhash64("text", F.lit(1))))
    first = both.withColumn("_turn", turn).where("_turn = 1").drop("_turn", "_kept", "_many", "_print")
    return first.unionByName(own.where("doc_id is null")).toDF(*docs.columns)


def _with_fingerprint(rows: DataFrame) -> DataFrame:
    """rows with ``_print``, the fingerprint of their text as :func:`near_duplicates` shows it."""
    prepared(rows.sparkSession)
    at, names = rows.columns.index("text"), rows.columns

    def run(batches):
        for b in batches:
            prints = [f"{fingerprint(t):016x}" for t in as_bytes(b.column(at).cast(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, pa.string())], names=[*names, "_print"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("_print", "string"))
