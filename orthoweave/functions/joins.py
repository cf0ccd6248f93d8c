"""Broadcasts and dealing out, behind checks of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side (bytes) that is broadcast; beyond it Spark shuffles.
BROADCAST_BYTES = 32 << 20
#: How many times the size of the tables it is made from a derived lexicon table can have.
GROWTH = 16


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate, or ``GROWTH`` times the tables that df is made from if that is less.

    The optimizer multiplies the sizes of joined tables; key joins of lexicon tables grow by words per sense only.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    total = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return min(int(str(plan.stats().sizeInBytes())), GROWTH * total)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its estimated size is within the limit, else as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


#: Bytes of input for each core below which texts are dealt out before heavy work.
DEALT_BYTES = 32 << 20
#: Bytes of a table that one task can read before texts are dealt out as well; bytes of input for each part of these.
COARSE_BYTES, PART_BYTES = 64 << 20, 16 << 20
#: Up to so many parts Spark writes each row straight to its part's file, without sorting rows in memory.
MOST_PARTS = 200


def _coarse(spark: SparkSession, leaf, size: int) -> bool:
    """Whether one task reads over ``COARSE_BYTES`` of a table in files, as a row group isn't divided. Only the files' footers are read."""
    if leaf.nodeName() != "LogicalRelation" or size <= COARSE_BYTES:
        return False
    scan = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, leaf), spark)
    most, rows = scan.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    return bool(rows) and size * most > COARSE_BYTES * rows


def dealt(df: DataFrame) -> DataFrame:
    """df dealt out over all cores if its tables are too small to fill them as they are read (few files, or few row groups), or if
    they lie in large row groups; else as it is.

    Any other large input has as many tasks as it has blocks, and isn't shuffled. A task holds the row group that it reads in its heap, so
    where that is large the work is done by other tasks.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [(leaves.apply(k), int(str(leaves.apply(k).stats().sizeInBytes()))) for k in range(leaves.size())]
    total = sum(size for _, size in sizes)
    if total <= DEALT_BYTES * cores:
        return df.repartition(cores)
    if not any(_coarse(df.sparkSession, leaf, size) for leaf, size in sizes):
        return df
    parts = min(MOST_PARTS, max(cores, total // PART_BYTES))
    return df.withColumn("_number", F.monotonically_increasing_id()).repartition(parts, "_number").drop("_number")
