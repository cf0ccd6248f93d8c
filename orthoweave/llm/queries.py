"""Queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import contamination
from .language_id import predicted
from .lm_scoring import scores
from .packing import packed_pieces
from .quality_bands import quality
from .simhash_trie import near_duplicates
from .substring_dedup import removals
from .textcode import tokenizer_path
from .token_counts import token_counts
from .token_store import read_shards, write_shards
from .toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Files of the public tokenizers that the queries use.
STORED, COUNTED = "word_bpe_49k.json", "byte_bpe_50k.json"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bigru_language": lambda s, d: predicted(table(s, d, "documents")),
    "op2_maxent_scores": lambda s, d: scores(table(s, d, "documents")),
    "op3_token_store": lambda s, d: read_shards(write_shards(table(s, d, "documents"), tokenizer_path(STORED))),
    "op4_token_counts": lambda s, d: token_counts(table(s, d, "documents"), tokenizer_path(COUNTED)),
    "op5_decontaminate": lambda s, d: contamination(table(s, d, "documents"), table(s, d, "benchmark")),
    "op6_quality_bands": lambda s, d: quality(table(s, d, "documents")),
    "op7_substring_dedup": lambda s, d: removals(table(s, d, "documents")),
    "op8_toxicity": lambda s, d: toxicity(table(s, d, "documents"), table(s, d, "labels")),
    "op9_simhash_trie": lambda s, d: near_duplicates(table(s, d, "documents")),
    "op10_pack_residual": lambda s, d: packed_pieces(table(s, d, "documents"), tokenizer_path(COUNTED)),
}

OP5_SQL = r"""
with fold as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
docs as (select row_number() over () as r, doc_id, w from fold),
items as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') as k
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from items where len(w) > 0)),
lengths as (select distinct n from windows),
places as (select r, n, p, array_to_string(w[p:p + n - 1], ' ') as k
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as p from docs, lengths where len(w) >= n)),
found as (select r, p, places.n, item_id from places join windows using (n, k)),
hit as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + n)) as q from found) group by r),
named as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from found where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (r) left join named using (r)
"""

OP7_SQL = r"""
with docs as (select row_number() over () as r, doc_id, coalesce(doc_id, 9223372036854775807) as d, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
places as (select r, d, p, array_to_string(w[p:p + 12], ' ') as k from (select r, d, w, unnest(range(1, len(w) - 11)) as p from docs where len(w) >= 13)),
least_ids as (select k, min(d) as low from places group by k),
hit as (select distinct r, unnest(range(p, p + 13)) as q from places join least_ids using (k) where d > low),
gone as (select r, count(*) as n_removed, list(q) as qs from hit group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  sha256(array_to_string(case when qs is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x : not list_contains(qs, x[2])), lambda x : x[1]) end, ' ')) as kept_sha256
from docs left join gone using (r)
"""

ORACLES: dict[str, str] = {"op5_decontaminate": OP5_SQL, "op7_substring_dedup": OP7_SQL}
