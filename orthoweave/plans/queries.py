"""Registry of queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import folders
from ..functions import text as T
from ..functions.joins import small
from ..functions.vectors import cosine, mean_pool
from ..operators import language, nearest, senses, substitution, tokens, translations, units
from ..sources import fixtures, tabs
from ..sources.words import stored, texts
from ..streaming import details
from . import analyses

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Senses are chosen from a score of 0 here, as a lemma with one sense needs no context.
CHOICE = analyses.Choice(0.0, 0.25)
#: At least one shared term: most places are left without a sense.
STRICT = analyses.Choice(1.0, 0.25)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- tables as SQL -----------------------------------------------------------------------------------------------


def _literal(x) -> str:
    return "null" if x is None else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"


#: DuckDB counts bytes in edit distances: lower-case letters beyond ASCII get unused capitals first.
_MARKED = sorted({c for r in fixtures.LEMMA_ROWS for c in r[4].lower() if ord(c) > 127})
_CAPITALS = "".join(chr(65 + k) for k in range(len(_MARKED)))
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def close_sql(a: str, b: str) -> str:
    a, b = f"lower(trim({a}))", f"lower(trim({b}))"
    plain = f"translate({{}}, '{''.join(_MARKED)}', '{_CAPITALS}')"
    return f"case when {a} = {b} then 1.0::double else 1.0::double - levenshtein({plain.format(a)}, {plain.format(b)}) / greatest(length({a}), length({b})) end"


def code_sql(c: str) -> str:
    return f"case lower(trim({c})) " + " ".join(f"when '{k}' then '{v}'" for k, v in T.ALIASES.items()) + f" else lower(trim({c})) end"


_OK = "(" + ", ".join(f"'{c}'" for c in T.SUPPORTED) + ")"
LEM = values("lem", "synset_offset, pos, synset_id, lang, lemma", fixtures.LEMMA_ROWS)
DEFS = values("defs", "synset_offset, pos, synset_id, lang, def", fixtures.DEFINITION_ROWS)
STOP = values("stop", "lang, word", fixtures.stopword_rows())
DOCS = f"texts as (select doc_id as text_id, text, {code_sql('lang')} as lang from documents where {code_sql('lang')} in {_OK})"
PARTS = "texts as (select p_partkey as text_id, p_name as text, 'eng' as lang from part)"
TOK = """pieces as (select text_id, lang, unnest(p) as token, unnest(range(1, len(p) + 1)) as k
  from (select text_id, lang, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+') as p from texts)),
placed as (select text_id, lang, token, k, regexp_matches(token, '^[^ \\t\\n\\x0B\\f\\r]') as word,
  coalesce(sum(length(token)) over w, 0) as b, coalesce(sum(case when regexp_matches(token, '^[^ \\t\\n\\x0B\\f\\r]') then 1 else 0 end) over w, 0) as idx,
  coalesce(sum(case when regexp_matches(token, '[.!?]["'')\\]]*$') then 1 else 0 end) over w, 0) as sentence
  from pieces window w as (partition by text_id order by k rows between unbounded preceding and 1 preceding)),
tok as (select text_id, lang, cast(idx as bigint) as idx, cast(sentence as bigint) as sentence, token, cast(b as bigint) as b, cast(b + length(token) as bigint) as e, lower(token) as lemma,
  lower(regexp_replace(token, '[^\\p{L}]+', '', 'g')) as term from placed where word),
elig as (select * from tok where regexp_matches(token, '\\p{L}') and (lang, lemma) not in (select lang, word from stop))"""
NOUNS = f"nouns as (select distinct lang, {_FOLD.format('lemma')} as lemma from lem where pos = 'n')"
UNITS = NOUNS + ",\nunits as (select elig.* from elig join nouns using (lang, lemma))"
CANDS = f"""least_defs as (select synset_offset, pos, lang, min(def) as def from defs group by all),
stored as (select distinct lang, {_FOLD.format("replace(lemma, '_', ' ')")} as probe, synset_offset, pos from lem where pos = 'n'),
cands as (select n.lang, n.lemma, s.synset_offset, s.pos, coalesce(e.def, o.def, '') as gloss
  from nouns n join stored s on s.lang = n.lang and s.probe = lower(replace(n.lemma, '_', ' '))
  left join least_defs e on e.synset_offset = s.synset_offset and e.pos = s.pos and e.lang = 'eng'
  left join least_defs o on o.synset_offset = s.synset_offset and o.pos = s.pos and o.lang = n.lang)"""
SCORED = """ctx as (select distinct text_id, sentence, term from elig where term <> '' and (lang, term) not in (select lang, word from stop)),
gterms as (select distinct synset_offset, pos, lang, lemma, unnest(regexp_extract_all(lower(gloss), '\\p{L}+')) as term from cands),
occ as (select distinct text_id, sentence, lang, lemma from units),
shared_terms as (select occ.text_id, occ.sentence, occ.lang, occ.lemma, g.synset_offset, g.pos, count(*) as n from occ
  join gterms g using (lang, lemma) join ctx on ctx.text_id = occ.text_id and ctx.sentence = occ.sentence and ctx.term = g.term where g.term <> occ.lemma group by all),
scored as (select occ.text_id, occ.sentence, occ.lang, occ.lemma, c.synset_offset, c.pos, c.gloss, cast(coalesce(n, 0) as double) as score from occ
  join cands c using (lang, lemma) left join shared_terms o on (o.text_id, o.sentence, o.lang, o.lemma, o.synset_offset, o.pos) = (occ.text_id, occ.sentence, occ.lang, occ.lemma, c.synset_offset, c.pos)),
turned as (select *, row_number() over w as rank, lead(score) over w as nxt, max(case when trim(gloss) = '' then 1 else 0 end) over (partition by text_id, sentence, lemma) as lacking
  from scored window w as (partition by text_id, sentence, lemma order by score desc, synset_offset, pos)),
judged as (select text_id, sentence, lang, lemma, synset_offset, pos, gloss, score, rank,
  rank = 1 and score >= 0.0 and (nxt is null or (score > nxt and score - nxt >= 0.25)) as picked, lacking from turned)"""
TRANS = f"""trans as (select c.lemma, c.synset_offset, c.pos, l.lang as target_lang, l.lemma as target, {close_sql("c.lemma", "l.lemma")} as score
  from (select distinct lemma, synset_offset, pos from cands) c join lem l on l.synset_offset = c.synset_offset and l.pos = c.pos)"""
BEST = "best as (select lemma, synset_offset, pos, target_lang, max(score) as score from trans group by all)"


def sql(*parts: str, select: str) -> str:
    return "with " + ",\n".join(parts) + "\n" + select


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return analyses.supported_texts(texts(stored(spark, f"{d}/documents.parquet"), "doc_id", "text", "lang"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark.read.parquet(f"{d}/part.parquet"), "p_partkey", "p_name", "eng")


def _lex(spark: SparkSession) -> fixtures.Lexicon:
    return fixtures.lexicon(spark)


def _r(c: str):
    return F.round(c, 6).alias(c)


# --- lexicon files --------------------------------------------------------------------------------------------------

_TABS = [r for r in fixtures.TAB_FILES]
_LINES = (
    values("files", "file, content", _TABS)
    + """, named as (select *, case when l = 'en' then 'eng' else l end as lang from (select *, regexp_extract(file, 'wn-data-([a-z]{2,3})\\.tab$', 1) as l from files) where l <> ''),
lines as (select file, lang, unnest(range(len(s))) as line_no, trim(unnest(s), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as line from (select file, lang, string_split(content, chr(10)) as s from named)),
rows_ as (select lang, string_split(line, chr(9)) as f from lines where line <> '' and line not like '#%'),
keyed as (select lang, f[1] as synset_id, f[2] as kind, f, case when instr(f[1], '-') > 0 then split_part(f[1], '-', 1) else left(f[1], length(f[1]) - 1) end as synset_offset,
  case when instr(f[1], '-') > 0 then substr(f[1], instr(f[1], '-') + 1) else right(f[1], 1) end as pos from rows_ where len(f) >= 3),
heads as (select lang, file, string_split(trim(substr(line, 2)), chr(9)) as p from (select *, row_number() over (partition by file order by line_no) as t from lines where line like '#%') where t = 1),
srcs as (select lang, nullif(trim(p[1]), '') as name, nullif(trim(p[3]), '') as url, nullif(trim(p[4]), '') as license, file from heads)"""
)


def _tab_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TABS, "file string, content string")


@query("with " + _LINES + " select synset_offset, pos, synset_id, lang, trim(f[3]) as lemma from keyed where kind = 'lemma' or kind like '%:lemma'")
def lex_lemmas(spark, d):
    return tabs.lemma_rows(_tab_files(spark))


@query("with " + _LINES + " select synset_offset, pos, synset_id, lang, trim(f[-1]) as def from keyed where (kind = 'def' or kind like '%:def') and length(trim(f[-1])) > 1")
def lex_definitions(spark, d):
    return tabs.definition_rows(_tab_files(spark))


@query("with " + _LINES + " select * from srcs")
def lex_sources(spark, d):
    return tabs.source_rows(_tab_files(spark))


@query(
    "with " + _LINES + " select '| Lang | Name | License | URL |' as line union all select '| --- | --- | --- | --- |' "
    "union all select '| ' || lang || ' | ' || coalesce(name, '') || ' | ' || coalesce(license, '') || ' | ' || coalesce(url, '') || ' |' from srcs"
)
def lex_attribution_md(spark, d):
    return tabs.attribution(tabs.source_rows(_tab_files(spark)))


@query(
    "with " + _LINES + " select 'lemmas' as tbl, count(*) as n from keyed where kind = 'lemma' or kind like '%:lemma' union all "
    "select 'definitions', count(*) from keyed where (kind = 'def' or kind like '%:def') and length(trim(f[-1])) > 1 union all select 'sources', count(*) from srcs"
)
def lex_totals(spark, d):
    files = _tab_files(spark)
    return tabs.totals(tabs.lemma_rows(files), tabs.definition_rows(files), tabs.source_rows(files))


# --- codes and cleaning ----------------------------------------------------------------------------------------------


@query(f"select {code_sql('lang')} as code, count(*) as n from documents group by 1")
def lang_alias_norm(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").groupBy(T.normal_code(F.col("lang")).alias("code")).agg(F.count("*").alias("n"))


@query(f"select coalesce({code_sql('lang')} in {_OK}, false) as supported, count(*) as n from documents group by 1")
def lang_supported(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").groupBy(F.coalesce(T.is_supported(F.col("lang")), F.lit(False)).alias("supported")).agg(F.count("*").alias("n"))


@query(f"select case {code_sql('lang')} " + " ".join(f"when '{k}' then '{v} ({k})'" for k, v in T.NAMES.items()) + f" else {code_sql('lang')} end as label, count(*) as n from documents group by 1")
def lang_label(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").groupBy(T.label(F.col("lang")).alias("label")).agg(F.count("*").alias("n"))


_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?i)(https?://|www\.)[^ \t\n\x0B\f\r]+', ' ', 'g'),
  '[^ \t\n\x0B\f\r@]+@[^ \t\n\x0B\f\r@]+', ' ', 'g'), '[\p{{Cc}}\p{{Cf}}]', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"""


@query(f"select conv_id, turn, {_CLEAN.format('nfc_normalize(text)')} as cleaned from conversations union all select page_id, -1, {_CLEAN.format('nfc_normalize(html)')} from pages")
def text_clean(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", T.clean(F.col("text")).alias("cleaned"))
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), T.clean(F.col("html")).alias("cleaned"))
    return turns.unionByName(pages)


# --- tokens and filters ------------------------------------------------------------------------------------------------


@query(sql(STOP, DOCS, TOK, select="select text_id, idx, sentence, token, b as begin_, e as end_ from tok"))
def tok_offsets(spark, d):
    rows = tokens.tokens(_docs(spark, d))
    return rows.select("text_id", F.col("idx").cast("long"), F.col("sentence").cast("long"), "token", F.col("begin").cast("long").alias("begin_"), F.col("end").cast("long").alias("end_"))


@query(sql(STOP, DOCS, TOK, select="select text_id, count(*) as n_tokens, count(*) filter (where regexp_matches(token, '\\p{L}')) as n_words from tok group by 1"))
def tok_word_flags(spark, d):
    return tokens.bare_tokens(_docs(spark, d)).groupBy("text_id").agg(F.count("*").alias("n_tokens"), F.count_if(T.is_word(F.col("token"))).alias("n_words"))


@query(sql(STOP, DOCS, TOK, select="select text_id, sentence, min(b) as begin_, max(e) as end_ from tok group by 1, 2"))
def tok_sentences(spark, d):
    return tokens.sentences(_docs(spark, d)).select("text_id", F.col("sentence").cast("long"), F.col("begin").cast("long").alias("begin_"), F.col("end").cast("long").alias("end_"))


@query(sql(STOP, DOCS, TOK, select="select text_id, count(*) as n_eligible from elig group by 1"))
def stop_filter(spark, d):
    rows = tokens.lemmatised(tokens.bare_tokens(_docs(spark, d)))
    return tokens.eligible(rows, _lex(spark).stopwords).groupBy("text_id").agg(F.count("*").alias("n_eligible"))


@query(sql(STOP, DOCS, TOK, select="select lang, lemma as word, count(*) as n from tok where (lang, lemma) in (select lang, word from stop) group by 1, 2"))
def stop_counts(spark, d):
    return tokens.stopword_tokens(tokens.bare_tokens(_docs(spark, d)), _lex(spark).stopwords).groupBy("lang", "word").agg(F.count("*").alias("n"))


# --- units and coverage -------------------------------------------------------------------------------------------------


@query(sql(STOP, LEM, DOCS, TOK, UNITS, select="select text_id, lemma, b as begin_, e as end_ from units"))
def noun_semi(spark, d):
    lex = _lex(spark)
    rows = units.units(_docs(spark, d), lex.lemmas, lex.stopwords)
    return rows.select("text_id", "lemma", F.col("begin").cast("long").alias("begin_"), F.col("end").cast("long").alias("end_"))


@query(
    sql(
        STOP, LEM, PARTS, TOK,
        select="select a.text_id, a.lemma || '_' || c.lemma as lemma, a.b as begin_, c.e as end_ from tok a join tok c on a.text_id = c.text_id and c.idx = a.idx + 1 and a.sentence = c.sentence "
        f"where ('eng', a.lemma || '_' || c.lemma) in (select lang, {_FOLD.format('lemma')} from lem)",
    )
)
def mwe_semi(spark, d):
    lex = _lex(spark)
    found = units.phrases(tokens.lemmatised(tokens.tokens(_parts(spark, d))), lex.lemmas)
    return found.select("text_id", "lemma", F.col("begin").cast("long").alias("begin_"), F.col("end").cast("long").alias("end_"))


@query(sql(LEM, f"texts as (select doc_id as text_id, {code_sql('lang')} as lang from documents)", select="select text_id, lang from texts where lang in (select lang from lem)"))
def lang_exists(spark, d):
    rows = texts(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", "lang")
    return units.with_language(rows, _lex(spark).lemmas).select("text_id", "lang")


_COVER = """counts as (select text_id, count(*) as total_words, count(*) filter (where (lang, lemma) in (select lang, lemma from nouns)) as considered_words from elig group by 1),
cover as (select t.text_id, t.lang, coalesce(total_words, 0) as total_words, coalesce(considered_words, 0) as considered_words from texts t left join counts using (text_id))"""


@query(sql(STOP, LEM, DOCS, TOK, NOUNS, _COVER, select="select *, round(case when total_words > 0 then considered_words / total_words else 0.0 end, 6) as coverage from cover"))
def coverage_by_doc(spark, d):
    lex = _lex(spark)
    return units.coverage(_docs(spark, d), lex.lemmas, lex.stopwords).select("text_id", "lang", "total_words", "considered_words", _r("coverage"))


@query(sql(STOP, LEM, DOCS, TOK, NOUNS, _COVER, select="select lang, cast(sum(total_words) as bigint) as total_words, cast(sum(considered_words) as bigint) as considered_words, count(*) as n from cover group by 1"))
def coverage_by_lang(spark, d):
    lex = _lex(spark)
    rows = units.coverage(_docs(spark, d), lex.lemmas, lex.stopwords)
    return rows.groupBy("lang").agg(F.sum("total_words").alias("total_words"), F.sum("considered_words").alias("considered_words"), F.count("*").alias("n"))


# --- senses -----------------------------------------------------------------------------------------------------------------


def _unit_words(spark, d, lex) -> DataFrame:
    return units.units(_docs(spark, d), lex.lemmas, lex.stopwords).select("lang", "lemma").distinct()


@query(sql(STOP, LEM, DEFS, DOCS, TOK, UNITS, CANDS, select="select cands.* from cands where (lang, lemma) in (select lang, lemma from units)"))
def candidates_gloss(spark, d):
    lex = _lex(spark)
    return senses.candidates(_unit_words(spark, d, lex), lex.lemmas, lex.definitions, "n").select("lang", "lemma", "synset_offset", "pos", "gloss")


@query(sql(LEM, DEFS, NOUNS, CANDS, select="select lang, count(*) filter (where gloss = '') as without_gloss, count(*) as n from cands group by 1"))
def gloss_fallback(spark, d):
    lex = _lex(spark)
    rows = senses.candidates(units.nouns(lex.lemmas), lex.lemmas, lex.definitions, "n")
    return rows.groupBy("lang").agg(F.count_if(F.col("gloss") == "").alias("without_gloss"), F.count("*").alias("n"))


_SENSES = (STOP, LEM, DEFS, DOCS, TOK, UNITS, CANDS, SCORED)


def strict(statement: str) -> str:
    """SQL with the threshold of ``STRICT``."""
    return statement.replace("score >= 0.0 and", "score >= 1.0 and")


def _ranked(spark, d, lex, choice=CHOICE, arrow=False) -> DataFrame:
    found = analyses.sentence_units(_docs(spark, d), lex, arrow=arrow)
    rows = found.select("text_id", "sentence", "lang", "context", F.explode(F.array_distinct("units.lemma")).alias("lemma"))
    table = senses.candidates(units.nouns(lex.lemmas), lex.lemmas, lex.definitions, "n")
    scored = senses.overlap_scorer(rows.join(small(table), ["lang", "lemma"])).drop("context")
    return senses.selected(scored, ["text_id", "sentence", "lemma"], choice.threshold, choice.margin).withColumn("sentence", F.col("sentence").cast("long"))


@query(sql(*_SENSES, select="select text_id, sentence, lemma, synset_offset, pos, score, rank from judged"))
def sense_scores(spark, d):
    return _ranked(spark, d, _lex(spark), arrow=True).select("text_id", "sentence", "lemma", "synset_offset", "pos", "score", F.col("rank").cast("long"))


@query(sql(*_SENSES, select="select text_id, sentence, lemma, synset_offset, pos, score from judged where picked"))
def sense_select(spark, d):
    return _ranked(spark, d, _lex(spark)).where("selected").select("text_id", "sentence", "lemma", "synset_offset", "pos", "score")


@query(strict(sql(*_SENSES, select="select text_id, sentence, lemma, synset_offset, pos, score from judged where picked")))
def sense_select_strict(spark, d):
    return _ranked(spark, d, _lex(spark), STRICT).where("selected").select("text_id", "sentence", "lemma", "synset_offset", "pos", "score")


@query(
    sql(
        *_SENSES,
        select="select occ.text_id, occ.sentence, occ.lemma, case when j.lacking is null then 'unlinked' when j.lacking = 1 then 'missing-english-definition' when j.chosen then 'resolved' else 'ambiguous' end as status "
        "from (select distinct text_id, sentence, lang, lemma from elig) occ left join (select text_id, sentence, lemma, max(lacking) as lacking, bool_or(picked) as chosen from judged group by all) j using (text_id, sentence, lemma)",
    )
)
def sense_status(spark, d):
    """Of all eligible words: those that the lexicon doesn't know are unlinked."""
    lex = _lex(spark)
    table = senses.candidates(units.nouns(lex.lemmas), lex.lemmas, lex.definitions, "n")
    found = senses.text_statuses(_docs(spark, d), _ranked(spark, d, lex), table, lex.stopwords)
    return found.select("text_id", F.col("sentence").cast("long"), "lemma", "status")


_SIGN = (
    values("rel", "synset_offset, pos, relation, to_offset, to_pos", fixtures.RELATIONS)
    + ", "
    + values("frm", "synset_offset, pos, frame", fixtures.FRAMES)
    + """, eng as (select synset_offset, pos, min(def) as def from defs where lang = 'eng' group by all),
parts as (select synset_offset, pos, def as t, 2.0 as weight, 1 as direct from eng union all select synset_offset, pos, frame, 1.5, 0 from frm
  union all select rel.synset_offset, rel.pos, eng.def, 1.0, 0 from rel join eng on eng.synset_offset = rel.to_offset and eng.pos = rel.to_pos),
words as (select synset_offset, pos, unnest(regexp_extract_all(lower(t), '\\p{L}+')) as term, weight, direct from parts),
sign as (select synset_offset, pos, term, cast(sum(weight) as double) as weight, cast(max(direct) as bigint) as direct from words where ('eng', term) not in (select lang, word from stop) group by all)"""
)


@query(sql(STOP, DEFS, _SIGN, select="select * from sign"))
def lesk_signature(spark, d):
    lex = _lex(spark)
    return senses.signatures(lex.definitions, lex.relations, lex.frames, lex.stopwords).withColumn("direct", F.col("direct").cast("long"))


_LESK = """freq as (select text_id, term, count(*) as n from elig where lang = 'eng' and term <> '' and (lang, term) not in (select lang, word from stop) group by all),
pairs as (select distinct u.text_id, u.lemma, c.synset_offset, c.pos from units u join cands c using (lang, lemma) where u.lang = 'eng'),
lesk as (select p.text_id, p.lemma, p.synset_offset, p.pos, cast(coalesce(sum(f.n * s.weight), 0) as double) as score, cast(coalesce(sum(s.direct), 0) as bigint) as direct from pairs p
  left join (freq f join sign s using (term)) on f.text_id = p.text_id and s.synset_offset = p.synset_offset and s.pos = p.pos and f.term <> p.lemma group by all)"""


def _lesk(spark, d) -> DataFrame:
    lex = _lex(spark)
    english = _docs(spark, d).where("lang = 'eng'")
    found = units.units(english, lex.lemmas, lex.stopwords)
    table = senses.candidates(units.nouns(lex.lemmas), lex.lemmas, lex.definitions, "n")
    signature = senses.signatures(lex.definitions, lex.relations, lex.frames, lex.stopwords)
    return senses.lesk_scores(found, senses.context_frequencies(english, lex.stopwords), table, signature)


@query(sql(STOP, LEM, DEFS, DOCS, TOK, UNITS, CANDS, _SIGN, _LESK, select="select text_id, lemma, synset_offset, pos, round(score, 6) as score, direct from lesk"))
def lesk_scores(spark, d):
    return _lesk(spark, d).select("text_id", "lemma", "synset_offset", "pos", _r("score"), "direct")


@query(
    sql(
        STOP, LEM, DEFS, DOCS, TOK, UNITS, CANDS, _SIGN, _LESK,
        select="select text_id, lemma, synset_offset, pos, round(score, 6) as score from (select *, row_number() over (partition by text_id, lemma order by score desc, direct desc, synset_offset, pos) as t from lesk) where t = 1",
    )
)
def lesk_best(spark, d):
    return senses.lesk_best(_lesk(spark, d)).select("text_id", "lemma", "synset_offset", "pos", _r("score"))


# --- translations and profiles --------------------------------------------------------------------------------------------


def _table(lex) -> DataFrame:
    return senses.candidates(units.nouns(lex.lemmas), lex.lemmas, lex.definitions, "n")


@query(sql(STOP, LEM, DEFS, PARTS, TOK, UNITS, CANDS, TRANS, select="select lemma, synset_offset, pos, target_lang, target, round(score, 6) as score from trans where lemma in (select lemma from units)"))
def translations_scored(spark, d):
    lex = _lex(spark)
    words = units.units(_parts(spark, d), lex.lemmas, lex.stopwords).select("lemma").distinct()
    rows = translations.scored_translations(_table(lex).join(words, "lemma", "left_semi"), lex.lemmas)
    return rows.select("lemma", "synset_offset", "pos", "target_lang", "target", _r("score"))


@query(sql(STOP, LEM, DEFS, DOCS, TOK, UNITS, CANDS, TRANS, BEST, select="select lemma, synset_offset, pos, target_lang, round(score, 6) as score from best where lemma in (select lemma from units)"))
def best_per_language(spark, d):
    lex = _lex(spark)
    words = units.units(_docs(spark, d), lex.lemmas, lex.stopwords).select("lemma").distinct()
    rows = translations.best_per_language(translations.scored_translations(_table(lex).join(words, "lemma", "left_semi"), lex.lemmas))
    return rows.select("lemma", "synset_offset", "pos", "target_lang", _r("score"))


def _pair_sql(expr: str) -> str:
    return sql(LEM, DEFS, NOUNS, CANDS, TRANS, select=f"select distinct lemma, target, {expr} from trans")


@query(_pair_sql("round(score, 6) as score"))
def sim_pairs_t(spark, d):
    lex = _lex(spark)
    return translations.scored_translations(_table(lex), lex.lemmas).select("lemma", "target", _r("score")).distinct()


@query(_pair_sql("round(score, 6) as score"))
def sim_pairs_cp(spark, d):
    lex = _lex(spark)
    rows = translations.scored_translations(_table(lex), lex.lemmas)
    return rows.select("lemma", "target", F.round(T.similarity(F.col("lemma"), F.col("target")), 6).alias("score")).distinct()


@query(_pair_sql("round(score, 6) as score"))
def sim_pairs_nfkc(spark, d):
    lex = _lex(spark)
    rows = translations.scored_translations(_table(lex), lex.lemmas).select("lemma", "target").distinct()
    return rows.select("lemma", "target", F.round(T.similarity_nfkc(F.col("lemma"), F.col("target")), 6).alias("score"))


@query(
    _pair_sql(
        "case when score >= 1.0 then 'identical' when score >= 0.9 then 'very similar' when score >= 0.7 then 'recognizable' when score >= 0.5 then 'partial' when score >= 0.2 then 'weak' else 'minimal' end as band, "
        "case when score >= 0.7 then 'high' when score >= 0.4 then 'middle' else 'low' end as color, "
        "repeat('#', cast(floor(score * 16 + 0.5) as int)) || repeat('-', 16 - cast(floor(score * 16 + 0.5) as int)) as bar"
    )
)
def score_bands(spark, d):
    lex = _lex(spark)
    rows = translations.scored_translations(_table(lex), lex.lemmas)
    return rows.select("lemma", "target", T.band(F.col("score")).alias("band"), T.color(F.col("score")).alias("color"), T.bar(F.col("score")).alias("bar")).distinct()


_FULL = (*_SENSES, TRANS, BEST)
_PROFILE = """n as (select text_id, count(*) as n_units from units group by 1),
used as (select u.text_id, u.lemma, j.synset_offset, j.pos from units u join judged j on j.text_id = u.text_id and j.sentence = u.sentence and j.lemma = u.lemma where j.picked and j.lacking = 0),
profile as (select text_id, target_lang, sum(score) / n_units as score, n_units from used join best using (lemma, synset_offset, pos) join n using (text_id) group by text_id, target_lang, n_units)"""
_RANKED = "select text_id, target_lang, round(score, 6) as score, n_units, {} from (select *, row_number() over (partition by text_id order by round(score, 9) desc, target_lang) as rank from profile)"


def _profiles(spark, source, lex, choice=CHOICE, **more) -> DataFrame:
    rows = analyses.text_transparency(source, lex, choice, **more).drop("rank").withColumn("exact", F.col("score")).withColumn("score", F.round("score", 9))
    return translations.ranked(rows, ["text_id"]).select("text_id", "target_lang", F.round("exact", 6).alias("score"), "n_units", F.col("rank").cast("long").alias("rank"))


@query(sql(*_FULL, _PROFILE, select=_RANKED.format("rank")))
def text_transparency(spark, d):
    return _profiles(spark, _docs(spark, d), _lex(spark))


@query(strict(sql(*_FULL, _PROFILE, select=_RANKED.format("rank"))))
def text_transparency_strict(spark, d):
    return _profiles(spark, _docs(spark, d), _lex(spark), STRICT)


#: A scorer of our own: shared terms, and a little more for short glosses.
GRADED = SCORED.replace("cast(coalesce(n, 0) as double) as score", "coalesce(n, 0) + 1.0::double / (1 + len(list_distinct(regexp_extract_all(lower(c.gloss), '\\p{L}+')))) as score").replace(
    "score >= 0.0 and", "score >= 0.15 and"
).replace(">= 0.25", ">= 0.01")
_GRADED = analyses.Choice(0.15, 0.01)


def graded_scorer(rows: DataFrame) -> DataFrame:
    own = 1.0 / (1 + F.size(senses.gloss_terms(F.col("gloss"))))
    return senses.overlap_scorer(rows).withColumn("score", F.col("score") + own)


@query(sql(STOP, LEM, DEFS, DOCS, TOK, UNITS, CANDS, GRADED, TRANS, BEST, _PROFILE, select=_RANKED.format("rank")))
def text_transparency_scored(spark, d):
    return _profiles(spark, _docs(spark, d), _lex(spark), _GRADED, scorer=graded_scorer)


_ANALYSED = "select u.text_id, count(*) as n_units, count(*) filter (where j.picked and j.lacking = 0) as analysed_units from units u left join (select * from judged where rank = 1) j on j.text_id = u.text_id and j.sentence = u.sentence and j.lemma = u.lemma group by 1"


@query(strict(sql(*_SENSES, select=_ANALYSED)))
def analysed_units(spark, d):
    return analyses.analysed_units(_docs(spark, d), _lex(spark), STRICT)


@query(sql(STOP, LEM, DEFS, PARTS, TOK, UNITS, CANDS, SCORED, TRANS, BEST, _PROFILE, select=_RANKED.format("rank")))
def part_transparency(spark, d):
    return _profiles(spark, _parts(spark, d), _lex(spark))


@query(
    sql(
        *_FULL, _PROFILE,
        select="select lang, target_lang, round(avg(score), 6) as score, count(*) as n from profile join texts using (text_id) group by 1, 2",
    )
)
def corpus_ranking(spark, d):
    docs = _docs(spark, d)
    rows = analyses.text_transparency(docs, _lex(spark), CHOICE).join(docs.select("text_id", "lang"), "text_id")
    return rows.groupBy("lang", "target_lang").agg(F.round(F.avg("score"), 6).alias("score"), F.count("*").alias("n"))


@query(sql(*_FULL, _PROFILE, select="select text_id, target_lang, rank from (" + _RANKED.format("rank") + ") where rank <= 12"))
def top12_report(spark, d):
    rows = _profiles(spark, _docs(spark, d), _lex(spark))
    return rows.where("rank <= 12").select("text_id", "target_lang", "rank")


_DETAIL = f"""detail as (select u.text_id, u.lang, u.lemma, u.b, u.e, j.synset_offset, j.pos, t.target_lang, t.target, t.score from units u
  join judged j on j.text_id = u.text_id and j.sentence = u.sentence and j.lemma = u.lemma join trans t on t.lemma = u.lemma and t.synset_offset = j.synset_offset and t.pos = j.pos
  where j.picked and j.lacking = 0 and {code_sql("t.target_lang")} <> {code_sql("u.lang")})"""


@query(sql(*_SENSES, TRANS, _DETAIL, select="select text_id, lemma, b as begin_, e as end_, target_lang, target, round(score, 6) as score from detail"))
def text_details(spark, d):
    rows = analyses.details(_docs(spark, d), _lex(spark), CHOICE)
    return rows.select("text_id", "lemma", F.col("begin").cast("long").alias("begin_"), F.col("end").cast("long").alias("end_"), "target_lang", "target", _r("score"))


@query(
    sql(
        *_SENSES,
        select="select u.text_id, u.lemma, u.b as begin_, u.e as end_, j.synset_offset, j.pos, j.score, j.picked and j.lacking = 0 as selected from units u join judged j on j.text_id = u.text_id and j.sentence = u.sentence and j.lemma = u.lemma",
    )
)
def text_comparisons(spark, d):
    rows = analyses.comparisons(_docs(spark, d), _lex(spark), CHOICE)
    return rows.select("text_id", "lemma", F.col("begin").cast("long").alias("begin_"), F.col("end").cast("long").alias("end_"), "synset_offset", "pos", "score", "selected")


@query(
    sql(
        *_SENSES,
        f"one as (select text_id, min(sentence) as sentence, min(b) as b, max(lang) as lang from tok where lemma = 'reed' and lang = 'eng' group by text_id having count(*) = 1), "
        f"senses as (select l.synset_offset, l.pos, coalesce(min(d.def), '') as gloss from lem l left join defs d on d.synset_offset = l.synset_offset and d.pos = l.pos and d.lang = 'eng' where l.lang = 'eng' and {_FOLD.format('l.lemma')} = 'reed' group by all), "
        "st as (select distinct synset_offset, pos, unnest(regexp_extract_all(lower(gloss), '\\p{L}+')) as term from senses), "
        "sc as (select o.text_id, o.sentence, s.synset_offset, s.pos, count(c.term) as score from one o cross join senses s left join (st join ctx c using (term)) on c.text_id = o.text_id and c.sentence = o.sentence and st.synset_offset = s.synset_offset and st.pos = s.pos and st.term <> 'reed' group by all), "
        "rk as (select *, row_number() over w as t, lead(score) over w as nxt from sc window w as (partition by text_id order by score desc, synset_offset, pos))",
        select=f"select text_id, synset_offset, pos, l.lang as target_lang, l.lemma as target, round({close_sql(chr(39) + 'reed' + chr(39), 'l.lemma')}, 6) as score from rk join lem l using (synset_offset, pos) where t = 1 and rk.score >= 0 and (nxt is null or rk.score - nxt >= 0.25)",
    )
)
def word_in_context(spark, d):
    rows = analyses.word_in_context(_docs(spark, d).where("lang = 'eng'"), "reed", _lex(spark), CHOICE)
    return rows.select("text_id", "synset_offset", "pos", "target_lang", "target", _r("score"))


@query(strict(sql(*_SENSES, TRANS, _DETAIL, select="select text_id, lemma, b as begin_, e as end_, target_lang, target, round(score, 6) as score from detail")))
def text_details_strict(spark, d):
    rows = analyses.details(_docs(spark, d), _lex(spark), STRICT)
    return rows.select("text_id", "lemma", F.col("begin").cast("long").alias("begin_"), F.col("end").cast("long").alias("end_"), "target_lang", "target", _r("score"))


@query(
    sql(
        STOP, LEM, DEFS, DOCS, TOK, UNITS, CANDS, GRADED, TRANS, _DETAIL,
        select="select text_id, lemma, target_lang, target, round(score, 6) as score, row_number() over (partition by text_id order by lemma, target_lang, round(score, 9) desc, target, b, synset_offset, pos) as place from detail",
    )
)
def details_placed(spark, d):
    """Details in the order of the report, under a scorer of our own."""
    rows = analyses.details(_docs(spark, d), _lex(spark), _GRADED, graded_scorer).withColumn("score", F.round("score", 9))
    return analyses.placed_details(rows).select("text_id", "lemma", "target_lang", "target", _r("score"), F.col("place").cast("long"))


@query(
    sql(
        STOP, LEM, DEFS, DOCS, TOK, UNITS, CANDS, GRADED,
        "c as (select u.text_id, u.lemma, u.b, j.synset_offset, j.pos, round(j.score, 9) as score, j.picked and j.lacking = 0 as selected from units u join judged j on j.text_id = u.text_id and j.sentence = u.sentence and j.lemma = u.lemma)",
        select="select text_id, lemma, b as begin_, synset_offset, pos, round(score, 6) as score, selected, row_number() over (partition by text_id order by lemma, b, selected desc, score desc, synset_offset, pos) as place from c",
    )
)
def comparisons_placed(spark, d):
    rows = analyses.comparisons(_docs(spark, d), _lex(spark), _GRADED, graded_scorer).withColumn("score", F.round("score", 9))
    return analyses.placed_comparisons(rows).select("text_id", "lemma", F.col("begin").cast("long").alias("begin_"), "synset_offset", "pos", _r("score"), "selected", F.col("place").cast("long"))


# --- phrases, tags, English by stems --------------------------------------------------------------------------------------------

_PHRASES = f"""ph as (select a.text_id, a.lang, a.sentence, a.idx, a.lemma || '_' || c.lemma as lemma, a.b, c.e from tok a join tok c on a.text_id = c.text_id and c.idx = a.idx + 1 and a.sentence = c.sentence
  where (a.lang, a.lemma || '_' || c.lemma) in (select lang, {_FOLD.format('lemma')} from lem)),
units as (select text_id, lang, sentence, lemma, b, e, 2 as n from ph union all select text_id, lang, sentence, lemma, b, e, 1 from elig join nouns using (lang, lemma)
  where (text_id, idx) not in (select text_id, idx from ph) and (text_id, idx) not in (select text_id, idx + 1 from ph))"""


@query(sql(STOP, LEM, PARTS, TOK, NOUNS, _PHRASES, select="select text_id, lemma, b as begin_, e as end_, case n when 2 then 'NOMINAL_MWE' else 'NOMINAL_TOKEN' end as unit_type from units"))
def units_phrases(spark, d):
    lex = _lex(spark)
    rows = units.units(_parts(spark, d), lex.lemmas, lex.stopwords, longest_phrase=2)
    return rows.select("text_id", "lemma", F.col("begin").cast("long").alias("begin_"), F.col("end").cast("long").alias("end_"), "unit_type")


@query(
    sql(
        STOP, LEM, PARTS, TOK, NOUNS, _PHRASES,
        "used as (select text_id, sum(n) as considered_words, count(*) as n_units from units group by 1), total as (select text_id, count(*) as total_words from elig group by 1)",
        select="select t.text_id, coalesce(total_words, 0) as total_words, cast(coalesce(considered_words, 0) as bigint) as considered_words, coalesce(n_units, 0) as n_units, round(coalesce(considered_words / total_words, 0.0), 6) as coverage from texts t left join total using (text_id) left join used using (text_id)",
    )
)
def coverage_phrases(spark, d):
    lex = _lex(spark)
    return units.coverage(_parts(spark, d), lex.lemmas, lex.stopwords, longest_phrase=2).select("text_id", "total_words", "considered_words", "n_units", _r("coverage"))


@query(
    sql(
        STOP, LEM, PARTS, TOK, NOUNS, _PHRASES,
        "items as (select text_id, sentence, b, lemma from ph union all select text_id, sentence, b, lemma from tok where (text_id, idx) not in (select text_id, idx from ph) and (text_id, idx) not in (select text_id, idx + 1 from ph))",
        select="select text_id, sentence, string_agg(lemma, ' ' order by b) as lemmas from items group by 1, 2",
    )
)
def mwe_collapsed(spark, d):
    placed = tokens.lemmatised(tokens.tokens(_parts(spark, d)))
    return units.collapsed(placed, _lex(spark).lemmas, 2).select("text_id", F.col("sentence").cast("long"), F.array_join("lemmas", " ").alias("lemmas"))


_ALL_CANDS = f"allw as (select distinct lang, {_FOLD.format('lemma')} as lemma from lem),\n" + CANDS.replace("from nouns n join", "from allw n join")


@query(sql(STOP, LEM, DEFS, PARTS, TOK, NOUNS, _PHRASES, _ALL_CANDS, SCORED, TRANS, BEST, _PROFILE, select=_RANKED.format("rank")))
def part_transparency_phrases(spark, d):
    return _profiles(spark, _parts(spark, d), _lex(spark), longest_phrase=2)


def _tags(spark: SparkSession) -> DataFrame:
    return fixtures.local(spark, fixtures.TAGS, "lang, form, pos")


@query(sql(STOP, LEM, PARTS, TOK, NOUNS, values("tags", "lang, form, pos", fixtures.TAGS), select="select text_id, lemma, b as begin_ from elig where (lang, lemma) in (select lang, lemma from nouns) or (lang, lower(token)) in (select lang, form from tags where pos like 'NN%' or pos in ('NOUN', 'PROPN'))"))
def units_tagged(spark, d):
    lex = _lex(spark)
    rows = units.units(_parts(spark, d), lex.lemmas, lex.stopwords, tags=_tags(spark))
    return rows.select("text_id", "lemma", F.col("begin").cast("long").alias("begin_"))


_PLURALS = "texts as (select p_partkey as text_id, p_name || 's' as text, 'eng' as lang from part)"
_STEMS = " union ".join(["select lemma, p.pos, lemma as probe from forms, (values ('n'), ('v'), ('a'), ('r')) p(pos)"] + [f"select lemma, '{pos}', left(lemma, length(lemma) - {len(end)}) || '{new}' from forms where lemma like '%{end}' and length(lemma) > {len(end)}" for pos, pairs in senses.ENDINGS.items() for end, new in pairs])
_ENGLISH = f"""forms as (select distinct lemma from elig), probes as ({_STEMS}),
estored as (select distinct {_FOLD.format("replace(lemma, '_', ' ')")} as probe, case pos when 's' then 'a' else pos end as pos, synset_offset from lem where lang = 'eng'),
egloss as (select synset_offset, case pos when 's' then 'a' else pos end as pos, min(def) as gloss from defs where lang = 'eng' and regexp_full_match(synset_offset, '[0-9]{{8}}') group by all),
ecands as (select distinct p.lemma, s.synset_offset, s.pos, coalesce(g.gloss, '') as gloss from probes p join estored s using (probe, pos) left join egloss g using (synset_offset, pos)),
eterms as (select distinct synset_offset, pos, unnest(regexp_extract_all(lower(gloss), '\\p{{L}}+')) as term from ecands),
eocc as (select distinct text_id, sentence, lemma from elig), ectx as (select distinct text_id, sentence, term from elig where term <> ''),
eshared as (select o.text_id, o.sentence, o.lemma, c.synset_offset, c.pos, count(x.term) as n from eocc o join ecands c using (lemma)
  left join (eterms t join ectx x using (term)) on (t.synset_offset, t.pos) = (c.synset_offset, c.pos) and (x.text_id, x.sentence) = (o.text_id, o.sentence) and t.term <> o.lemma group by all),
eturned as (select s.*, c.gloss, row_number() over w as rank, lead(n) over w as nxt, max(case when trim(c.gloss) = '' then 1 else 0 end) over (partition by text_id, sentence, lemma) as lacking
  from eshared s join ecands c using (lemma, synset_offset, pos) window w as (partition by text_id, sentence, lemma order by n desc, synset_offset, pos)),
esenses as (select text_id, sentence, lemma, synset_offset, pos, gloss, cast(n as double) as score, rank = 1 and (nxt is null or n > nxt) and lacking = 0 as selected from eturned)"""


def _plurals(spark, d) -> DataFrame:
    parts = spark.read.parquet(f"{d}/part.parquet").withColumn("p_name", F.concat("p_name", F.lit("s")))
    return texts(parts, "p_partkey", "p_name", "eng")


@query(sql(STOP, LEM, DEFS, _PLURALS, TOK, _ENGLISH, select="select * from ecands"))
def english_candidates(spark, d):
    lex = _lex(spark)
    words = tokens.eligible(tokens.lemmatised(tokens.bare_tokens(_plurals(spark, d))), lex.stopwords)
    return senses.english_candidates(words, lex.lemmas, lex.definitions).drop("lang")


@query(sql(STOP, LEM, DEFS, _PLURALS, TOK, _ENGLISH, select="select text_id, lemma, synset_offset, pos, gloss, score, selected from esenses"))
def english_senses(spark, d):
    return analyses.english_senses(_plurals(spark, d), _lex(spark), CHOICE).select("text_id", "lemma", "synset_offset", "pos", "gloss", "score", "selected")


@query(
    sql(
        STOP, LEM, DEFS, _PLURALS, TOK, _ENGLISH,
        select=f"select e.text_id, e.lemma, e.synset_offset, e.pos, l.lang as target_lang, l.lemma as target, round({close_sql('e.lemma', 'l.lemma')}, 6) as score from (select distinct text_id, lemma, synset_offset, pos from esenses where selected) e "
        "join lem l on l.synset_offset = e.synset_offset and case l.pos when 's' then 'a' else l.pos end = e.pos",
    )
)
def english_transparency(spark, d):
    return analyses.english_transparency(_plurals(spark, d), _lex(spark), CHOICE).withColumn("score", F.round("score", 6))


@query(sql(LEM, select="select lemma from lem where synset_offset = '90000011' and pos = 'n' and lang = 'fra'"))
def at_synset(spark, d):
    return translations.at_synset(_lex(spark).lemmas, "90000011", "n", "fra")


_NFKC_PAIRS = (("ﬁn", "fin", 1.0), ("Ａｂ", "ab", 1.0), ("x²", "x2", 1.0), ("①a", "1b", 0.5), ("é", "e\u0301", 1.0), ("ｶ", "カ", 1.0), ("ab", "ad", 0.5))


@query("select * from (values " + ", ".join(f"('{a}', '{b}', {s}::double)" for a, b, s in _NFKC_PAIRS) + ") t(a, b, score)")
def sim_compatible(spark, d):
    """Pairs of which one at least changes under NFKC."""
    rows = fixtures.local(spark, [(a, b) for a, b, _ in _NFKC_PAIRS], "a, b")
    return rows.withColumn("score", F.round(T.similarity_nfkc(F.col("a"), F.col("b")), 6))


# --- a lexicon built from files ----------------------------------------------------------------------------------------------------


def write_tab_files(spark: SparkSession, folder: str) -> None:
    """Our own lexicon as tab files, one for each language."""
    for lang in sorted({r[3] for r in fixtures.LEMMA_ROWS}):
        lemmas = [(r[2], r[4]) for r in fixtures.LEMMA_ROWS if r[3] == lang]
        defs = [(r[2], r[4]) for r in fixtures.DEFINITION_ROWS if r[3] == lang]
        folders.put_text(spark, f"{folder}/wn-data-{lang}.tab", tabs.tab_text(lang, lemmas, defs, f"Own {lang}\t1.0\t\tCC0"))


@query(sql(STOP, LEM, DEFS, PARTS, TOK, UNITS, CANDS, SCORED, TRANS, BEST, _PROFILE, select=_RANKED.format("rank")))
def lex_built_transparency(spark, d):
    """Files are written, built into a lexicon, opened, and an analysis runs on what was built."""
    files, target = folders.fresh(spark, "tab-files"), folders.fresh(spark, "lexicon")
    write_tab_files(spark, files)
    tabs.build(spark, files, target)
    return _profiles(spark, _parts(spark, d), tabs.open_lexicon(spark, target))


@query(
    sql(
        STOP, LEM, DEFS, PARTS, TOK, UNITS, CANDS, SCORED, TRANS, BEST, _PROFILE,
        "names as (select *, case target_lang " + " ".join(f"when '{k}' then '{v} ({k})'" for k, v in T.NAMES.items()) + " else target_lang end as name, row_number() over (partition by text_id order by round(score, 9) desc, target_lang) as place from profile)",
        select="select text_id, place, rpad(name, 18, ' ') || ' ' || repeat('#', cast(floor(least(greatest(score, 0), 1) * 16 + 0.5) as int)) || repeat('-', 16 - cast(floor(least(greatest(score, 0), 1) * 16 + 0.5) as int)) || ' ' || format('{:.3f}', round(score, 3)) as line from names where place <= 3",
    )
)
def report_lines(spark, d):
    found = {"results": analyses.text_transparency(_parts(spark, d), _lex(spark), CHOICE).withColumn("score", F.round("score", 9))}
    return analyses.report(found, top=3).withColumn("place", F.col("place").cast("long"))


_EXPLORE = f"""exp as (select l.synset_offset, l.pos, coalesce(d.def, '') as gloss from lem l left join defs d on d.synset_offset = l.synset_offset and d.pos = l.pos and d.lang = l.lang
  where l.lang = 'eng' and {_FOLD.format("replace(l.lemma, '_', ' ')")} = 'ring')"""


@query(sql(LEM, DEFS, _EXPLORE, select="select * from exp"))
def sense_explorer(spark, d):
    lex = _lex(spark)
    return translations.explorer("ring", "eng", lex.lemmas, lex.definitions)


@query(
    sql(
        LEM, DEFS, _EXPLORE,
        f"w as (select distinct e.synset_offset, e.pos, l.lang as target_lang, l.lemma as target, {close_sql(chr(39) + 'ring' + chr(39), 'l.lemma')} as score from exp e join lem l using (synset_offset, pos))",
        select="select synset_offset, pos, target_lang, string_agg(target, ', ' order by score desc, target) as words, round(max(score), 6) as score from w group by all",
    )
)
def explorer_grouped(spark, d):
    return analyses.explored("ring", "eng", _lex(spark)).select("synset_offset", "pos", "target_lang", "words", _r("score"))


# --- alternatives, rewriting, graph ------------------------------------------------------------------------------------------


def _selected_parts(spark, d, lex) -> tuple[DataFrame, DataFrame]:
    source = _parts(spark, d)
    return source, analyses.comparisons(source, lex, CHOICE)


_PART_SENSES = (STOP, LEM, DEFS, PARTS, TOK, UNITS, CANDS, SCORED)
_SEL = "sel as (select u.text_id, substr(t.text, u.b + 1, u.e - u.b) as original, u.lemma, u.b, u.e, j.synset_offset, j.pos from units u join texts t using (text_id) join judged j on j.text_id = u.text_id and j.sentence = u.sentence and j.lemma = u.lemma where j.picked and j.lacking = 0)"
_ALT = f"""ref as (select distinct synset_offset, pos, replace(lemma, '_', ' ') as form from lem where lang = 'ita'),
own as (select distinct synset_offset, pos, replace(lemma, '_', ' ') as word from lem where lang = 'eng'),
orig as (select distinct original, synset_offset, pos from sel),
base as (select original, synset_offset, pos, form as baseline_form, s as baseline from (select o.*, form, {close_sql("original", "form")} as s, row_number() over (partition by original, o.synset_offset, o.pos order by {close_sql("original", "form")} desc, form) as t from orig o join ref using (synset_offset, pos)) where t = 1),
alt as (select original, synset_offset, pos, word as replacement, form as reference_form, s as transparency from (select o.*, word, form, {close_sql("word", "form")} as s, row_number() over (partition by original, o.synset_offset, o.pos, word order by {close_sql("word", "form")} desc, form) as t
  from orig o join own using (synset_offset, pos) join ref using (synset_offset, pos) where lower(word) <> lower(original)) where t = 1)"""


@query(
    sql(
        *_PART_SENSES, _SEL, _ALT,
        select="select original, synset_offset, pos, round(baseline, 6) as baseline, baseline_form, replacement, round(transparency, 6) as transparency, round(transparency - baseline, 6) as change, reference_form, 'unverified' as validation from base join alt using (original, synset_offset, pos)",
    )
)
def alternatives_scale(spark, d):
    lex = _lex(spark)
    source, rows = _selected_parts(spark, d, lex)
    named = rows.where("selected").join(source, "text_id").withColumn("original", F.col("text").substr(F.col("begin") + 1, F.col("end") - F.col("begin")))
    out = substitution.alternatives(named, lex.lemmas, "eng", "ita")
    return out.select("original", "synset_offset", "pos", _r("baseline"), "baseline_form", "replacement", _r("transparency"), _r("change"), "reference_form", "validation")


_RW = """gain as (select *, case when true then transparency - baseline end as g from base join alt using (original, synset_offset, pos)),
pick as (select original, synset_offset, pos, replacement, transparency, baseline, reference_form from (select *, row_number() over (partition by original, synset_offset, pos order by transparency desc, lower(replacement)) as t from gain where g > 1e-9 and g + 1e-9 >= 0.05) where t = 1),
places as (select s.*, p.replacement, p.transparency, p.baseline from sel s left join pick p using (original, synset_offset, pos))"""


def _plan(spark, d) -> DataFrame:
    lex = _lex(spark)
    source, rows = _selected_parts(spark, d, lex)
    return substitution.rewrite_plan(source, rows, lex.lemmas, "eng", "ita", True, 0.05)


@query(
    sql(
        *_PART_SENSES, _SEL, _ALT, _RW,
        select="select text_id, count(*) as considered, count(*) filter (where replacement is null) as unavailable, count(replacement) as n_choices, coalesce(string_agg(original || '>' || replacement, ';' order by b) filter (where replacement is not null), '') as choices from places group by 1",
    )
)
def rewrite_plan(spark, d):
    shown = F.array_join(F.transform("choices", lambda c: F.concat(c["original"], F.lit(">"), c["replacement"])), ";")
    return _plan(spark, d).select("text_id", "considered", "unavailable", F.size("choices").cast("long").alias("n_choices"), shown.alias("choices"))


_PUT = """pieces_ as (select t.text_id, t.k, coalesce(case when t.word then p.replacement end, t.token) as piece from placed t left join {0} p on p.text_id = t.text_id and p.b = t.b and p.replacement is not null and t.word),
put as (select text_id, string_agg(piece, '' order by k) as result from pieces_ group by 1)"""


@query(
    sql(
        *_PART_SENSES, _SEL, _ALT, _RW, _PUT.format("places"),
        select="select text_id, result, count(replacement) as applied from put join places using (text_id) group by 1, 2",
    )
)
def rewrite_apply(spark, d):
    plan = _plan(spark, d).withColumn("statuses", F.transform("choices", lambda c: F.lit("accepted")))
    return substitution.completed(plan).select("text_id", "result", F.col("applied").cast("long"))


def _propose_sql(more: bool) -> str:
    order = "desc, l.lemma desc" if more else "asc, l.lemma asc"
    score = close_sql("s.lemma", "l.lemma")
    pairs = f"""pr as (select text_id, b, replacement from (select s.text_id, s.b, replace(l.lemma, '_', ' ') as replacement, row_number() over (partition by s.text_id, s.b order by {score} {order}) as t
  from sel s join lem l using (synset_offset, pos) where l.lang = 'ita' and lower(replace(l.lemma, '_', ' ')) <> lower(s.original) and {score} {">=" if more else "<="} 0.3) where t = 1)"""
    return sql(*_PART_SENSES, _SEL, pairs, _PUT.format("pr"), select="select text_id, result, count(*) as applied from put join pr using (text_id) group by 1, 2")


def _propose(spark, d, more: bool) -> DataFrame:
    lex = _lex(spark)
    source, rows = _selected_parts(spark, d, lex)
    found = substitution.proposals(source, rows, lex.lemmas, "ita", more, 0.3)
    return substitution.applied(found.where(F.size("proposals") > 0)).select("text_id", "result", F.col("applied").cast("long"))


@query(_propose_sql(True))
def propose_more(spark, d):
    return _propose(spark, d, True)


@query(_propose_sql(False))
def propose_less(spark, d):
    return _propose(spark, d, False)


_GRAPH = f"""rows1 as (select text_id, lang, lemma as unit, {code_sql("target_lang")} as tl, target, score, min(b) over (partition by text_id, lemma) as place from detail where (lang, lemma) not in (select lang, word from stop)),
best1 as (select distinct text_id, lang, unit, tl, target, score, place from (select *, row_number() over (partition by text_id, unit, tl order by score desc, target) as t from rows1) where t = 1),
numbered as (select *, row_number() over (partition by text_id, unit order by tl) as k from best1),
counted as (select *, sum(case when k = 1 then 2 else 1 end) over (partition by text_id order by place, unit, k) as nodes from numbered),
shown as (select * from counted c where nodes <= 120 and exists (select 1 from counted o where o.text_id = c.text_id and o.unit = c.unit and o.k = 1 and o.nodes <= 120))"""


@query(
    sql(
        *_SENSES, TRANS, _DETAIL, _GRAPH,
        select="select text_id, 'source:' || unit as id, unit as word, lang as language, unit, true as source from shown where k = 1 union all select text_id, 'source:' || unit || '-' || tl, target, tl, unit, false from shown",
    )
)
def graph_nodes(spark, d):
    return analyses.text_graph(_docs(spark, d), _lex(spark), CHOICE)[0]


@query(sql(*_SENSES, TRANS, _DETAIL, _GRAPH, select="select text_id, 'source:' || unit as source, 'source:' || unit || '-' || tl as target, round(score, 6) as score from shown"))
def graph_links(spark, d):
    return analyses.text_graph(_docs(spark, d), _lex(spark), CHOICE)[1].withColumn("score", F.round("score", 6))


# --- vectors, detection ------------------------------------------------------------------------------------------------------


def _centroids(rows: DataFrame) -> DataFrame:
    """Mean vector of each label, as an array; partial sums by position."""
    flat = rows.select("label", F.posexplode("embedding").alias("k", "x"))
    return flat.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("v")).select("label", F.transform("v", lambda x: x["m"]).alias("centroid"))


_CENT = """flat as (select vec_id, label, unnest(embedding)::double as x, unnest(range(len(embedding))) as k from embeddings),
cent as (select label, list(m order by k) as centroid from (select label, k, avg(x) as m from flat group by all) group by 1)"""
_COS = "list_cosine_similarity(e.embedding::double[], c.centroid)"


@query(sql(_CENT, select=f"select e.vec_id, e.label, round({_COS}, 6) as score from embeddings e join cent c on c.label = e.label"))
def embed_cosine(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return rows.join(small(_centroids(rows)), "label").select("vec_id", "label", F.round(cosine(F.transform("embedding", lambda x: x.cast("double")), F.col("centroid")), 6).alias("score"))


_POOLED = "pooled as (select vec_id, list_transform(range(1, len(embedding) + 1), lambda i : embedding[i]::double + embedding[len(embedding) - i + 1]::double) as v from embeddings)"


@query(
    sql(
        _CENT, _POOLED,
        "s as (select e.vec_id, c.label, list_cosine_similarity(e.v, c.centroid) as score from pooled e, cent c), r as (select *, row_number() over w as t, lead(score) over w as nxt from s window w as (partition by vec_id order by score desc, label))",
        select="select vec_id, case when score >= 0.2 and (nxt is null or (score > nxt and score - nxt >= 0.001)) then label else -1 end as picked, round(score, 6) as score from r where t = 1",
    )
)
def embed_meanpool_select(spark, d):
    """Each row's vector and its reverse pooled, a third one masked out; then the nearest label by a matrix product."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    e = F.col("embedding")
    pooled = mean_pool(F.array(e, F.reverse(e), F.transform(e, lambda x: x + 1000.0)), F.array(F.lit(1), F.lit(1), F.lit(0)))
    found = nearest.best_match(rows.select("vec_id", pooled.alias("v")), "v", _centroids(rows).withColumnRenamed("centroid", "vector"), 0.2, senses.OTHER_MARGIN)
    return found.select("vec_id", F.coalesce("picked", F.lit(-1)).alias("picked"), F.round("score", 6).alias("score"))


_DETECT = f"""cl as (select doc_id as text_id, {_CLEAN.format('nfc_normalize(text)')} as text from documents),
pt as (select text_id, unnest(s) as t, unnest(range(len(s))) as part from (select text_id, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)) as s from cl)),
pw as (select * from (select text_id, least(part, 16) as part, lower(regexp_replace(tk, '[^\\p{{L}}]+', '', 'g')) as term from (select text_id, part, unnest(regexp_extract_all(t, '[^ \\t\\n\\x0B\\f\\r]+')) as tk from pt)) where term <> ''),
spread as (select word as term, lang, count(*) over (partition by word) as n from (select distinct lang, word from stop)),
nw as (select text_id, part, count(*) as words from pw group by all),
hp as (select text_id, part, lang, round(sum(1.0::double / n), 9) as hits from pw join spread using (term) group by all),
rk as (select *, row_number() over w as t, lead(hits) over w as nxt from hp window w as (partition by text_id, part order by hits desc, lang)),
mix as (select text_id, count(distinct lang) > 1 as mixed from rk join nw using (text_id, part) where t = 1 and part < 16 and words >= 6 and hits / words >= 0.02 and hits / words >= coalesce(nxt / words, 0) * 1.5 group by 1),
tw as (select text_id, cast(sum(words) as bigint) as words from nw group by 1),
ht as (select text_id, lang, round(sum(hits), 9) as hits from hp group by all),
top as (select * from (select text_id, lang, hits, row_number() over w as t, coalesce(lead(hits) over w, 0.0) as nxt from ht window w as (partition by text_id order by hits desc, lang)) where t = 1),
each as (select text_id, lang as code, coalesce(hits / words, 0.0) as confidence, coalesce(nxt / words, 0.0) as runner_up, words, coalesce(mixed, false) as mixed from tw left join top using (text_id) left join mix using (text_id))"""


@query(
    sql(
        STOP, _DETECT,
        select=f"select text_id, code, round(confidence, 6) as confidence, cast(words as int) as words, mixed, mixed or words < 4 or confidence < 0.02 or (runner_up > 0 and confidence < 1.5 * runner_up) or coalesce(code not in {_OK}, true) as uncertain from each",
    )
)
def lang_detect(spark, d):
    rows = texts(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", "lang")
    return language.detect(rows, _lex(spark).stopwords).select("text_id", "code", F.round("confidence", 6).alias("confidence"), "words", "mixed", "uncertain")


@query(sql(STOP, LEM, DEFS, values("samples", "text_id, lang, target, text", [(k, *r) for k, r in enumerate(fixtures.SAMPLES)]), "texts as (select text_id, text, lang from samples)", TOK, NOUNS, _COVER, select="select lang, total_words, considered_words from cover"))
def demo_report(spark, d):
    lex = _lex(spark)
    return units.coverage(fixtures.samples(spark).select("text_id", "text", "lang"), lex.lemmas, lex.stopwords).select("lang", "total_words", "considered_words")


@query(
    sql(
        STOP, values("samples", "text_id, lang, target, text", [(k, *r) for k, r in enumerate(fixtures.SAMPLES)]), _DETECT.replace("doc_id as text_id", "text_id").replace("from documents", "from samples"),
        select="select s.lang, code, round(confidence, 6) as confidence, coalesce(code = s.lang, false) as right_ from each join samples s using (text_id)",
    )
)
def demo_detection(spark, d):
    """The languages of our sample texts as the detector finds them."""
    rows = fixtures.samples(spark)
    found = language.detect(rows.select("text_id", "text", "lang"), _lex(spark).stopwords).join(rows.select("text_id", "lang"), "text_id")
    return found.select("lang", "code", F.round("confidence", 6).alias("confidence"), F.coalesce(F.col("code") == F.col("lang"), F.lit(False)).alias("right_"))


@query(
    sql(
        STOP, LEM, DEFS, DOCS, TOK, UNITS, CANDS, TRANS,
        "single as (select lang, lemma, min(synset_offset) as synset_offset, min(pos) as pos from cands group by 1, 2 having count(*) = 1)",
        select="select u.text_id, u.lemma, t.target_lang, t.target, round(t.score, 6) as score from units u join single s using (lang, lemma) join trans t on t.lemma = s.lemma and t.synset_offset = s.synset_offset and t.pos = s.pos",
    )
)
def stream_details(spark, d):
    """The words of single-sense units over a stream of the documents table."""
    batch = spark.read.parquet(f"{d}/documents.parquet")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
    stream = details.text_stream(spark, f"{d}/documents.parquet*", columns)
    rows = details.unit_words(analyses.supported_texts(texts(stream, "doc_id", "text", "lang")), _lex(spark))
    return details.drained(rows, "details_" + uuid.uuid4().hex).select("text_id", "lemma", "target_lang", "target", _r("score"))
