"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Places that ids are hashed to, and how many times the wanted number are let through to the exact choice.
PLACES, SPARE = 1 << 24, 4


def first_by_hash(rows: DataFrame, label: str, most: int) -> DataFrame:
    """The ``most`` rows of each label that come first by a hash of doc_id.

    Rows are counted by label, and only those under a hash bound that lets about ``SPARE * most`` of each label through are
    ranked, so the ranking of a label reads a bounded number of rows. Labels with few rows pass whole. There must be few labels:
    a row for each is broadcast, and a class of the classifier that is fitted stands for it.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES))
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    bound = F.lit(float(SPARE * most)) / F.col("_n") * PLACES
    near = rows.join(F.broadcast(counts), label).withColumn("_place", place).where(F.col("_place") <= bound)
    turn = F.row_number().over(Window.partitionBy(label).orderBy("_place", "doc_id"))
    return near.withColumn("_turn", turn).where(F.col("_turn") <= most).drop("_turn", "_place", "_n")


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """Rows with the highest counts, ``most`` of them at most; rows of about one count (within 9 %) come together or not at all.

    A histogram over levels of the count gives the bound, so nothing is sorted and no task gathers the rows.
    """
    level = F.floor(F.log2(F.col(n).cast("double")) * 8).cast("int")
    sizes = {r.level: r.rows for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()}
    bound, total = None, 0
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > most:
            break
        bound = at
    return counts.where(level >= bound) if bound is not None else counts.where(F.lit(False))
