"""Graph of words and the closest words of other languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.joins import small
from ..functions.text import normal_code
from .translations import other_languages

#: Nodes of one graph at most. Fixed value.
MOST_NODES = 120


def graph(rows: DataFrame, stopwords: DataFrame, most: int = MOST_NODES) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) by text_id from (text_id, lang, unit, place, target_lang, target, score).

    A unit has one node and one for the best word of each other language (of equal ones the first by word); units come in
    order of place until ``most`` nodes are reached, the last unit with as many languages as fit.
    """
    words = small(stopwords.select("lang", F.col("word").alias("_w")).distinct())
    kept = other_languages(rows).withColumn("_w", F.lower("unit")).join(words, ["lang", "_w"], "left_anti").drop("_w")
    kept = kept.withColumn("target_lang", normal_code(F.col("target_lang")))
    first = Window.partitionBy("text_id", "unit", "target_lang").orderBy(F.desc("score"), "target")
    best = kept.withColumn("turn", F.row_number().over(first)).where("turn = 1").drop("turn")
    in_unit = Window.partitionBy("text_id", "unit").orderBy("target_lang")
    best = best.withColumns({"place": F.min("place").over(Window.partitionBy("text_id", "unit")), "k": F.row_number().over(in_unit)})
    # the unit's own node comes before its first language
    before = Window.partitionBy("text_id").orderBy("place", "unit", "k")
    counted = best.withColumn("nodes", F.sum(F.when(F.col("k") == 1, 2).otherwise(1)).over(before))
    opened = counted.withColumn("opens", F.max(F.when((F.col("k") == 1) & (F.col("nodes") <= most), 1).otherwise(0)).over(Window.partitionBy("text_id", "unit")))
    shown = opened.where((F.col("opens") == 1) & (F.col("nodes") <= most))
    source = F.concat(F.lit("source:"), "unit")
    target = F.concat(source, F.lit("-"), "target_lang")
    # a unit's own node and its first language's come from one row, so that the texts are read once
    own = F.struct(source.alias("id"), F.col("unit").alias("word"), F.col("lang").alias("language"), "unit", F.lit(True).alias("source"))
    other = F.struct(target.alias("id"), F.col("target").alias("word"), F.col("target_lang").alias("language"), "unit", F.lit(False).alias("source"))
    nodes = shown.select("text_id", F.explode(F.when(F.col("k") == 1, F.array(own, other)).otherwise(F.array(other))).alias("x")).select("text_id", "x.*")
    return nodes, shown.select("text_id", source.alias("source"), target.alias("target"), "score")
