"""Replacing words by others: alternatives in the same language, and proposals by closeness to a language."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.joins import small
from ..functions.text import form, match_case, nfkc, normal_code, similarity, similarity_nfkc, tidy_form, transparency

#: How much lower a checker's score may fall. Fixed value.
TOLERANCE = 0.05


def sense_forms(lemmas: DataFrame, lang: str, name: str, shape: Callable[[Column], Column] = form) -> DataFrame:
    """Distinct (synset_offset, pos, name) words of one language, underscores as spaces."""
    return lemmas.where(normal_code(F.col("lang")) == lang).select("synset_offset", "pos", shape(F.col("lemma")).alias(name)).where(F.trim(name) != "").distinct()


def closest(rows: DataFrame, keys: list[str], word: str, reference: str, score: str) -> DataFrame:
    """For each keys and word the closest reference form; of equally close ones the smallest."""
    order = Window.partitionBy(*keys, word).orderBy(F.desc(score), F.col(reference))
    return rows.withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn")


def alternatives(selected: DataFrame, lemmas: DataFrame, source: str, reference: str) -> DataFrame:
    """(original, synset_offset, pos, baseline, baseline_form, replacement, transparency, change, reference_form, validation).

    selected: distinct (original, synset_offset, pos). Candidates are source-language words of the sense in the case of the
    original; senses without a form in the reference language, and originals without a candidate, give no row.
    """
    if source == reference:
        raise ValueError("choose two different languages")
    forms = small(sense_forms(lemmas, reference, "reference_form"))
    words = small(sense_forms(lemmas, source, "word"))
    keys = ["original", "synset_offset", "pos"]
    base = selected.select(*keys).distinct().join(forms, ["synset_offset", "pos"]).withColumn("score", similarity(F.col("original"), F.col("reference_form")))
    base = closest(base, keys, "original", "reference_form", "score").select(*keys, F.col("score").alias("baseline"), F.col("reference_form").alias("baseline_form"))
    named = selected.select(*keys).distinct().join(words, ["synset_offset", "pos"]).withColumn("replacement", match_case(F.col("original"), F.col("word")))
    named = named.where(F.lower("replacement") != F.lower("original")).select(*keys, "replacement").distinct()
    scored = named.join(forms, ["synset_offset", "pos"]).withColumn("transparency", similarity(F.col("replacement"), F.col("reference_form")))
    best = closest(scored, keys, "replacement", "reference_form", "transparency")
    return base.join(best, keys).select(
        *keys, "baseline", "baseline_form", "replacement", "transparency", (F.col("transparency") - F.col("baseline")).alias("change"), "reference_form", F.lit("unverified").alias("validation")
    )


def proposals(texts: DataFrame, senses: DataFrame, lemmas: DataFrame, target: str, more: bool, least: float, least_score: float = 0.0) -> DataFrame:
    """(text_id, text, proposals): at most one replacement for each place, with target-language words of its sense.

    senses: (text_id, begin, end, lemma, synset_offset, pos, score, selected); places are taken in order of begin, end and
    offset, and one that overlaps an earlier one with a replacement is passed over.
    """
    chosen = senses.where(F.col("selected") & (F.col("score") >= least_score))
    placed = chosen.join(texts.select("text_id", "text"), "text_id").where((F.col("begin") >= 0) & (F.col("end") <= F.length("text")) & (F.col("begin") < F.col("end")))
    placed = placed.withColumn("original", F.col("text").substr(F.col("begin") + 1, F.col("end") - F.col("begin")))
    words = small(lemmas.where(normal_code(F.col("lang")) == target).select("synset_offset", "pos", F.col("lemma").alias("word")).where(F.trim("word") != "").distinct())
    pairs = placed.select("lemma", "original", "synset_offset", "pos").distinct().join(words, ["synset_offset", "pos"])
    pairs = pairs.where(F.lower(form(F.col("word"))) != F.lower("original")).withColumn("similarity", transparency(F.col("lemma"), F.col("word")))
    pairs = pairs.where(F.col("similarity") >= least if more else F.col("similarity") <= least)
    pick = F.max(F.struct("similarity", "word")) if more else F.min(F.struct("similarity", "word"))
    best = pairs.groupBy("lemma", "original", "synset_offset", "pos").agg(pick.alias("best"))
    rows = placed.join(best, ["lemma", "original", "synset_offset", "pos"])
    item = F.struct(
        F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end"), "synset_offset", "original",
        match_case(F.col("original"), form(F.col("best.word"))).alias("replacement"), F.col("best.similarity").alias("similarity"),
    )
    listed = rows.groupBy("text_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    kept = F.expr(
        "aggregate(all, named_struct('at', -1, 'kept', slice(all, 1, 0)), "
        "(a, x) -> if(x.begin < a.at, a, named_struct('at', x.end, 'kept', array_append(a.kept, x))), a -> a.kept)"
    )
    return texts.select("text_id", "text").join(listed.select("text_id", kept.alias("proposals")), "text_id")


def replaced(text: str, items: str) -> Column:
    """text with items (structs of begin, end, replacement) put in from right to left."""
    return F.expr(
        f"aggregate(reverse(array_sort({items})), {text}, (acc, c) -> concat(substr(acc, 1, c.begin), c.replacement, substr(acc, c.end + 1, length(acc))))"
    )


def applied(rows: DataFrame, checker: Callable[[str], float] | None = None) -> DataFrame:
    """(text_id, result, applied, rejected) of proposals; with a checker each is kept only if the text stays coherent.

    The baseline is the best score so far; a checker that raises is used no more for this text.
    """
    if checker is None:
        return rows.select("text_id", replaced("text", "proposals").alias("result"), F.size("proposals").alias("applied"), F.lit(0).alias("rejected"))

    def run(frames):
        for pdf in frames:
            out = []
            for text_id, text, found in zip(pdf["text_id"], pdf["text"], pdf["proposals"], strict=True):
                kept, dropped, check, base = [], 0, checker, None
                for p in found:
                    trial = _put(text, [*kept, p])
                    if check is not None:
                        try:
                            base = check(_put(text, kept)) if base is None else base
                            score = check(trial)
                        except Exception:  # noqa: BLE001  the checker is somebody else's code
                            check = None
                        else:
                            if score + TOLERANCE < base:
                                dropped += 1
                                continue
                            base = max(base, score)
                    kept.append(p)
                out.append((text_id, _put(text, kept), len(kept), dropped))
            yield pd.DataFrame(out, columns=["text_id", "result", "applied", "rejected"])

    kind = rows.schema["text_id"].dataType.simpleString()
    return rows.select("text_id", "text", "proposals").mapInPandas(run, f"text_id {kind}, result string, applied int, rejected int")


def _put(text: str, items) -> str:
    for p in sorted(items, key=lambda x: -x["begin"]):
        text = text[: p["begin"]] + p["replacement"] + text[p["end"] :]
    return text


def rewrite_plan(texts: DataFrame, senses: DataFrame, lemmas: DataFrame, source: str, target: str, more: bool, least_change: float, most: int = 100) -> DataFrame:
    """(text_id, text, choices, considered, unavailable, truncated) of every text that has a selected sense.

    Places are taken from left to right, the longest first at one place; a place inside one taken before is passed over,
    whether that had a choice or not. A choice is the source-language word of the sense that changes the similarity to the
    target language most in the wanted direction, by least_change at least.
    """
    chosen = senses.where("selected").join(texts.select("text_id", "text"), "text_id")
    chosen = chosen.where((F.col("begin") >= 0) & (F.col("end") <= F.length("text")) & (F.col("begin") < F.col("end")))
    spot = F.struct(F.col("begin").cast("int").alias("begin"), (F.col("begin") - F.col("end")).cast("int").alias("less"), "synset_offset", F.col("end").cast("int").alias("end"), "pos")
    listed = chosen.groupBy("text_id").agg(F.first("text").alias("text"), F.array_sort(F.collect_list(spot)).alias("all"))
    kept = F.expr(
        "aggregate(all, named_struct('at', -1, 'kept', slice(all, 1, 0)), "
        "(a, x) -> if(x.begin < a.at, a, named_struct('at', x.end, 'kept', array_append(a.kept, x))), a -> a.kept)"
    )
    places = listed.select("text_id", "text", F.explode(kept).alias("x")).select("text_id", "text", "x.begin", "x.end", "x.synset_offset", "x.pos")
    places = places.withColumn("original", F.col("text").substr(F.col("begin") + 1, F.col("end") - F.col("begin")))
    best = rewrite_choices(places.select("original", "synset_offset", "pos").distinct(), lemmas, source, target, more, least_change)
    joined = places.join(best, ["original", "synset_offset", "pos"], "left")
    item = F.struct("begin", "end", "original", F.col("target").alias("replacement"), "score", "baseline", "reference", "alternatives")
    plan = joined.groupBy("text_id").agg(
        F.first("text").alias("text"),
        F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), item))).alias("choices"),
        F.count("*").alias("considered"),
        F.sum(F.when(F.col("target").isNull(), 1).otherwise(0)).alias("unavailable"),
    )
    return plan.withColumn("truncated", F.size("choices") > most).withColumn("choices", F.slice("choices", 1, most))


def rewrite_choices(originals: DataFrame, lemmas: DataFrame, source: str, target: str, more: bool, least_change: float) -> DataFrame:
    """Best choice of each distinct (original, synset_offset, pos) that has one."""
    keys = ["original", "synset_offset", "pos"]

    def forms(lang: str, name: str) -> DataFrame:
        raw = sense_forms(lemmas, lang, name, tidy_form)
        return raw.groupBy("synset_offset", "pos", F.lower(nfkc(F.col(name))).alias(f"{name}_norm")).agg(F.min(name).alias(name))

    reference, words = small(forms(target, "reference")), small(forms(source, "word"))
    base = originals.join(reference, ["synset_offset", "pos"]).withColumn("baseline", similarity_nfkc(F.col("original"), F.col("reference")))
    base = base.groupBy(*keys).agg(F.max("baseline").alias("baseline"))
    pairs = originals.join(words, ["synset_offset", "pos"]).where(F.col("word_norm") != F.lower(nfkc(F.col("original")))).join(reference, ["synset_offset", "pos"])
    scored = pairs.withColumn("score", similarity_nfkc(F.col("word"), F.col("reference")))
    near = closest(scored, keys, "word_norm", "reference_norm", "score").join(base, keys)
    change = F.col("score") - F.col("baseline") if more else F.col("baseline") - F.col("score")
    near = near.withColumn("gain", change).where((F.col("gain") > 1e-9) & (F.col("gain") + 1e-9 >= least_change))
    order = Window.partitionBy(*keys).orderBy(F.desc("score") if more else F.asc("score"), "word_norm")
    ranked = near.withColumns({"turn": F.row_number().over(order), "alternatives": F.count("*").over(Window.partitionBy(*keys))})
    return ranked.where("turn = 1").select(*keys, match_case(F.col("original"), F.col("word")).alias("target"), "score", "baseline", "reference", "alternatives")


def completed(plan: DataFrame, judged: str | None = "statuses") -> DataFrame:
    """plan with result, requested, applied and warnings; ``judged`` names an array of statuses, one for each choice.

    An array of another size, or with other words than accepted, rejected and unverified, leaves all unverified.
    """
    n = F.size("choices")
    known = F.col(judged) if judged else F.lit(None).cast("array<string>")
    valid = F.coalesce((F.size(known) == n) & F.forall(known, lambda x: F.coalesce(x.isin("accepted", "rejected", "unverified"), F.lit(False))), F.lit(False))
    rows = plan.withColumn("_status", F.when(valid, known).otherwise(F.transform("choices", lambda c: F.lit("unverified"))))
    rows = rows.withColumn("_used", F.expr("transform(filter(arrays_zip(choices, _status), z -> z._status = 'accepted'), z -> z.choices)"))
    notes = F.array(
        F.when(~valid, "invalid judgements; nothing was applied"),
        F.when(F.exists("_status", lambda s: s == "unverified"), "unverified candidates were not applied"),
        F.when(F.col("considered") == 0, "no resolved nominal units"),
        F.when(F.col("unavailable") > 0, "some units have no suitable word"),
        F.when(F.col("truncated"), "only the first units were checked"),
    )
    return rows.withColumns(
        {"result": replaced("text", "_used"), "requested": n, "applied": F.size("_used"), "warnings": F.filter(notes, lambda x: x.isNotNull())}
    ).drop("_status", "_used")


def judged(rows: DataFrame, judge: Callable[[str, str, dict], str]) -> DataFrame:
    """plan with ``statuses`` from a judge of (text before, text after, choice), called in order over the text as it becomes.

    A choice whose source isn't where the accepted ones before have moved it, or a judge that raises, gives unverified.
    """

    def run(frames):
        for pdf in frames:
            out = []
            for text, choices in zip(pdf["text"], pdf["choices"], strict=True):
                shift, found = 0, []
                for c in choices:
                    begin, end = c["begin"] + shift, c["end"] + shift
                    status = "unverified"
                    if text[begin:end] == c["original"]:
                        after = text[:begin] + c["replacement"] + text[end:]
                        try:
                            status = judge(text, after, dict(c))
                        except Exception:  # noqa: BLE001  the judge is somebody else's code
                            status = "unverified"
                        if status == "accepted":
                            shift += len(c["replacement"]) - (end - begin)
                            text = after
                    found.append(status)
                out.append(found)
            yield pdf.assign(statuses=out)

    schema = StructType([*rows.schema.fields, StructField("statuses", ArrayType(StringType()))])
    return rows.mapInPandas(run, schema)

