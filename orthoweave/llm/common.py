"""Helpers shared by the text operators: shared tables, Arrow mapping, words and vocabulary joins."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes an Arrow batch holds at most, as whole texts may be long.
BATCH_ROWS, BATCH_BYTES = 20_000, 8 << 20

#: A null doc_id stands after every other one.
LAST_ID = (1 << 63) - 1

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim.argtypes = [ctypes.c_size_t]
except (OSError, AttributeError):  # another C library
    _libc = None

_gave = 0.0
_own_dirs: dict[str, str] = {}
_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_dirs:
        _own_dirs[key] = "file://" + tempfile.mkdtemp(prefix="orthoweave-")
    return _own_dirs[key]


class Scope:
    """What :func:`kept` and :func:`written` make inside a ``with`` block goes when the block ends, but for lasting tables.

    For steps whose result is written inside the block. Without a scope, results lean on these tables until their reader has
    written them; ``spark.catalog.clearCache()`` and an empty shared folder are then the caller's part.
    """

    _open: list[Scope] = []

    def __enter__(self) -> Scope:
        self.frames: list[DataFrame] = []
        Scope._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scope._open.remove(self)
        if self.frames:
            discard(*self.frames)

    @staticmethod
    def add(df: DataFrame) -> DataFrame:
        if Scope._open:
            Scope._open[-1].frames.append(df)
        return df


def kept(df: DataFrame) -> DataFrame:
    """df on executors' disks for several uses; partitions on a lost executor are computed again from their lineage."""
    return Scope.add(df.persist(StorageLevel.DISK_ONLY))


def written(df: DataFrame, name: str = "stage", files: int | None = None, lasting: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    files bounds the number of files of a table whose size is known to be small; a lasting table outlives the open scope.
    """
    df = df if files is None else df.coalesce(files)
    spark = df.sparkSession
    name = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    _written.add(name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out if lasting else Scope.add(out)


def discard(*tables: DataFrame) -> None:
    """Drop tables of :func:`kept` and :func:`written` that nothing reads any more, and shuffle files of ended plans."""
    for df in tables:
        if df.storageLevel != StorageLevel.NONE:
            df.unpersist()
            continue
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.getName() in _written:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
                _written.discard(path.getName())
    release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame, each: int = 128 << 20) -> int:
    """Partitions to deal df's rows to: those of the session, or more where its tables hold over ``each`` bytes for every one of them.

    Taken from the sizes that the optimizer knows; nothing runs.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(x for x in (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())) if x < 1 << 55)  # above: not known
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // each))


def prepared(spark: SparkSession) -> SparkSession:
    """Bounded Arrow batches for this session, as one batch holds whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def map_batches(df: DataFrame, fn: Callable[..., Iterator[dict]], schema: str) -> DataFrame:
    """``fn`` maps an iterator of Arrow batches to dicts of columns, which become batches of ``schema``."""
    prepared(df.sparkSession)
    out = pa_schema(df.sparkSession, schema)

    def run(batches):
        if not getattr(fn, "encodes", False):
            forget_encoders()
        for columns in fn(batches):
            arrays = [as_array(columns[f.name], f.type) for f in out]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=out)
            del columns, arrays
            give_back()

    return df.mapInArrow(run, schema)


def forget_encoders() -> None:
    """Free what an earlier task of another operator remembers: workers are kept, and encoders are large."""
    held = sys.modules.get(f"{__package__}.textcode")
    if held is not None and held._encoders:
        held._encoders.clear()
        give_back()


def give_back() -> None:
    """Return freed memory to the system, once a second at most: a worker kept for later tasks would hold its peak."""
    global _gave
    if time.monotonic() - _gave < 1:
        return
    _gave = time.monotonic()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def sliced(batches, column: int = 1, limit: int = 2 << 20):
    """Batches cut so that a text column holds about ``limit`` bytes in each: working arrays follow the words."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y > x:
                yield b.slice(x, y - x)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(edges, bytes) of a column of texts, nulls as empty: text k is bytes edges[k] to edges[k + 1]; nothing is copied."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    edges = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[edges[0] : edges[-1]] if raw is not None else np.zeros(0, np.uint8)
    return edges - edges[0], data


def doc_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string; any other columns of the input play no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def in_fold(modulus: int, remainder: int):
    """Column: crc32 of doc_id as text has this remainder (a null doc_id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of starts[i] .. starts[i]+lengths[i]-1; in 32 bits where they do."""
    total = int(lengths.sum())
    kind = np.int32 if total + int(starts.max(initial=0)) < 1 << 31 else np.int64
    before = np.cumsum(lengths) - lengths
    out = np.repeat((starts - before).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


class Words:
    """Word ids of a worker, kept across batches and tasks; forgotten when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000, **arrays):
        self.limit, self.ids = limit, {}

    def of(self, words: list[bytes]) -> list[int]:
        ids = self.ids
        return [ids.setdefault(w, len(ids)) for w in words]

    def full(self) -> bool:
        return len(self.ids) > self.limit


def split_words(texts: list[bytes | None], lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of texts: (distinct words, their numbers in order, number of words of each text)."""
    texts = [(t.lower() if lower else t) if t else b"" for t in texts]
    pieces = pc.ascii_split_whitespace(pa.array(texts, type=pa.binary()).view(pa.string()))
    flat = pieces.flatten().dictionary_encode()
    codes = flat.indices.to_numpy().astype(np.int64)
    counts = pc.list_value_length(pieces).to_numpy().astype(np.int64)
    # no word holds a space: joined and split again they become bytes faster than one by one
    joined = pa.ListArray.from_arrays(pa.array([0, len(flat.dictionary)], pa.int32()), flat.dictionary.cast(pa.binary()))
    distinct = pc.binary_join(joined, b" ")[0].as_py().split(b" ") if len(flat.dictionary) else []
    if b"" in distinct:  # white space at either end of a text leaves an empty piece
        full = codes != distinct.index(b"")
        counts = sums(full, counts)
        codes = codes[full]
    return distinct, codes, counts


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values over consecutive runs of the given lengths."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
