"""The nearest of a bounded set of vectors, as one matrix product for each Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Numbers that the set may hold altogether, 32 MB; a larger one isn't gathered.
MOST_NUMBERS = 4 << 20


def gathered(table: DataFrame) -> tuple[list, np.ndarray]:
    """Labels in order and their vectors, of a (label, vector) table that is within the bound."""
    size = table.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0]
    if size > MOST_NUMBERS:
        raise ValueError(f"{size} numbers are more than the {MOST_NUMBERS} that a set of vectors may hold")
    rows = sorted((r.label, r.vector) for r in table.select("label", "vector").collect())
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; rows of zeros stay."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def best_match(rows: DataFrame, vector: str, table: DataFrame, threshold: float, margin: float) -> DataFrame:
    """rows without their vector, with ``picked`` and ``score``: the label of the highest cosine, null unless that reaches the threshold and leads by the margin.

    table: (label, vector). Of equal scores the first label comes first, and none is picked. Raises on vectors of another length and
    on values that aren't finite.
    """
    labels, known = gathered(table)
    kind = table.schema["label"].dataType
    label = to_arrow_type(kind)
    shipped = rows.sparkSession.sparkContext.broadcast((labels, unit_rows(known)))
    kept = [c for c in rows.columns if c != vector]
    schema = StructType([*rows.select(*kept).schema.fields]).add("picked", kind).add("score", "double")

    def run(batches):
        names, matrix = shipped.value
        for b in batches:
            found = b.column(len(kept))
            lengths = np.diff(found.offsets.to_numpy())
            if len(lengths) and (found.null_count or (lengths != matrix.shape[1]).any()):
                raise ValueError("vectors must be of one length")
            own = found.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(found), -1)
            if not np.isfinite(own).all():
                raise ValueError("vectors must have finite values")
            scores = unit_rows(own) @ matrix.T
            best = scores.argmax(1)
            top = scores[np.arange(len(own)), best]
            scores[np.arange(len(own)), best] = -np.inf
            lead = top - scores.max(1, initial=-np.inf)
            good = (top >= threshold) & (lead > 0) & (lead >= margin)
            picked = pa.array([names[k] if ok else None for k, ok in zip(best.tolist(), good.tolist(), strict=True)], label)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], picked, pa.array(top)], names=[*kept, "picked", "score"])

    return rows.select(*kept, vector).mapInArrow(run, schema)
