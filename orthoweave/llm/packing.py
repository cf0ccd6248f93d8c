"""Best-fit packing of documents into sequences, with residual bins merged up a tree.

Every read task encodes its texts, cuts documents longer than a sequence, and packs its pieces best-fit in
descending length. Bins that are full but for ``NEAR_FULL`` tokens are final. The others go up as items: of
each ``FAN_IN`` groups one task packs the items best-fit again, emits the nearly full bins, and hands on the rest,
until one group is left.

What goes up is bounded without a loss. After best-fit at most one bin of a group is half full or less (the second would
have gone into the first), so a later group meets at most ``FAN_IN`` such bins; a sequence holds at most one bin over
half full, so only so many of these can take anything in, and bins of equal fill can stand for each other. Of each
fill a group therefore hands on ``FAN_IN`` bins for each round that is left, and the others are final: no later round could
have used them.

The pieces (numbers only, no text and no ids) are kept on disk; only bins travel up the
tree, and one join places the pieces of merged bins.

Defined cases: null and empty texts are the end id alone; a document of exactly the sequence length isn't cut; very long
texts are encoded whole and cut into as many pieces as they need; of pieces of equal length the one read first is placed
first; repeated rows and doc_ids are packed as rows of their own; null doc_ids stay null; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, doc_text, kept, map_batches, sliced
from .textcode import encoder

CAPACITY, END_ID = 2048, 0
NEAR_FULL = 8
FAN_IN = 8
#: Pieces that a read task packs at a time.
LOCAL_PIECES = 500_000
_TASK_BITS = 33
#: Chunks that a worker remembers: its memory, against encoding rarer ones again.
REMEMBERED = 200_000


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset in it, fill of each bin) of best-fit in descending order of size."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room for exactly r
    for k, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = rooms >> size
        if fitting:
            room = size + ((fitting & -fitting).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[k], offsets[k] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins, offsets, np.array(fill, dtype=np.int64)


def pieces(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first can be shorter than the capacity."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    return [(0, first)] * bool(first) + [(k, capacity) for k in range(first, length, capacity)]


def local_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with the bin that their own task gave them."""

    def packed(held):
        rows = [np.concatenate(x) if isinstance(x[0], np.ndarray) else [y for z in x for y in z] for x in zip(*held, strict=True)]
        bins, offsets, fill = best_fit(rows[3], capacity)
        return rows, bins, offsets, fill

    def run(batches):
        from pyspark import TaskContext

        task, coder = TaskContext.get().partitionId(), encoder(tokenizer, REMEMBERED)
        made, held, size = 0, [], 0

        def closed():
            nonlocal made, held, size
            rows, bins, offsets, fill = packed(held)
            base = (task << _TASK_BITS) + made
            made += len(fill)
            held, size = [], 0
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            return dict(zip(names, rows, strict=True)) | {"bin": bins + base, "offset": offsets, "fill": fill[bins], "task": np.full(len(bins), task)}

        for b in sliced(batches, limit=4 << 20):
            ids, lengths = coder.encode(as_bytes(b.column(1)))
            ids, lengths = np.insert(ids, np.cumsum(lengths), end_id).astype("<u4"), lengths + 1
            begins = np.cumsum(lengths) - lengths
            rows = []
            for i, begin, n in zip(b.column(0).to_pylist(), begins.tolist(), lengths.tolist(), strict=True):
                for k, (start, part) in enumerate(pieces(n, capacity)):
                    at = begin + start
                    rows.append((i, k, start, part, zlib.crc32(ids[at : at + part].tobytes())))
            if rows:
                numbers, *rest = zip(*rows, strict=True)
                held.append((list(numbers), *(np.array(x, dtype=np.int64) for x in rest)))
                size += len(rows)
            if size >= LOCAL_PIECES:
                yield closed()
        if held:
            yield closed()

    run.encodes = True
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, task long"
    return map_batches(doc_text(docs), run, schema)


def of_use(fill: np.ndarray, room: int, most: int) -> np.ndarray:
    """Which bins go up: of those less full than ``room``, the first ``most`` of each fill."""
    order = np.argsort(fill, kind="stable")
    ordered = fill[order]
    turn = np.arange(len(fill)) - np.searchsorted(ordered, ordered)
    out = np.zeros(len(fill), dtype=bool)
    out[order[turn < most]] = True
    return out & (fill < room)


def merged_bins(rest: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(bin, into, shift): where the underfull bins (bin, fill, grp) end up after all rounds."""
    spark = rest.sparkSession
    schema = "bin long, into long, shift long, fill long, grp long, up boolean"
    level = kept(rest)
    top = level.agg(F.max("grp")).first()[0]
    rounds = 0
    while top is not None and (rounds == 0 or top >= FAN_IN**rounds):
        rounds += 1
    moves = None

    def round_of(most: int):
        def packed(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True])
            bins, offsets, fill = best_fit(pdf["fill"].to_numpy(), capacity)
            first = np.full(len(fill), np.iinfo(np.int64).max)
            np.minimum.at(first, bins, pdf["bin"].to_numpy())
            # a merged bin takes the number of its smallest part
            up = of_use(fill, capacity - NEAR_FULL, most)
            return pd.DataFrame({"bin": pdf["bin"].to_numpy(), "into": first[bins], "shift": offsets, "fill": fill[bins], "grp": pdf["grp"].to_numpy(), "up": up[bins]})

        return packed

    for later in range(rounds - 1, -1, -1):
        level = level.withColumn("grp", F.floor(F.col("grp") / FAN_IN).cast("long"))
        done = kept(level.groupBy("grp").applyInPandas(round_of(FAN_IN * later), schema))
        step = done.select("bin", "into", "shift")
        if moves is None:
            moves = step
        else:  # bins merged earlier move on with the bin they are in
            on = step.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            moves = moves.join(on, "into", "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        moves = kept(moves)
        level = done.where("up").groupBy("into", "grp").agg(F.first("fill").alias("fill")).select(F.col("into").alias("bin"), "fill", "grp")
    return moves if moves is not None else spark.createDataFrame([], "bin long, into long, shift long")


def packed_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    local = kept(local_pieces(docs, tokenizer, end_id, capacity))
    rest = local.where(F.col("fill") < capacity - NEAR_FULL).groupBy("bin").agg(F.first("fill").alias("fill"), F.first("task").alias("grp"))
    moves = merged_bins(rest, capacity)
    return local.join(moves, "bin", "left").select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
