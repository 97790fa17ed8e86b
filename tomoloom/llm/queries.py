"""The operators over their whole tables, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoloom.llm import (
    byte_bpe,
    decontaminate,
    exact_dedup,
    jaccard_join,
    lexical_search,
    packing,
    quality_cnn,
    spelling,
    suffix_dedup,
    suffix_tree_lm,
    token_files,
    toxicity,
    url_filter,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_cnn.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, folder, "documents"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, folder, "documents"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.without_repeats(_table(spark, folder, "documents"))
    kept = F.when(F.col("kept").isNull(), F.col("sha256")).otherwise(F.sha2("kept", 256))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", kept.alias("kept_sha256"))


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(_table(spark, folder, "documents"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    found = url_filter.url_verdicts(_table(spark, folder, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op9_suffix_tree_lm(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree_lm.text_scores(_table(spark, folder, "documents"))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.shingle_components(_table(spark, folder, "documents"))


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.with_digests(packing.pack(_table(spark, folder, "documents")))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.ranked(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, run in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3, "op8_url_filter": url_filter.check_sql(), "op10_jaccard_join": OP10, "op12_lexical_search": OP12, "op13_spelling": OP13}


OP3 = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""

OP10 = r"""
with recursive words as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda w: w <> '') as w from documents)
, shingles as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words)
, sizes as (select doc_id, count(*) as n from shingles group by doc_id)
, shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id
    group by all)
, links as materialized (
    select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * k >= 75 * (x.n + y.n - k))
, both_ways as materialized (select a, b from links union all select b, a from links)
, reach(doc_id, other) as (
    select doc_id, doc_id from documents union select r.doc_id, l.b from reach r join both_ways l on l.a = r.other)
select d.doc_id, coalesce(n, 0) as n_shingles, min(other) as component_id
from documents d join reach r on r.doc_id = d.doc_id left join sizes s on s.doc_id = d.doc_id group by d.doc_id, n
"""

OP12 = r"""
with split as (
    select row_number() over () as d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents where text is not null)
, docs as (select d, doc_id, len(t)::bigint as n, t from split where len(t) > 0)
, corpus as (select count(*)::bigint as docs, sum(n)::bigint as terms from docs)
, asked as (
    select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark where text is not null)
, held as (select d, term, count(*)::bigint as tf from (select d, unnest(t) as term from docs) group by all)
, wanted as (select * from held where term in (select term from asked))
, weights as (
    select term, floor(1000 * ln((2 * any_value(c.docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
    from wanted, corpus c group by term)
, scored as (
    select item_id, doc_id, d, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * c.docs) // c.terms)))))::bigint as score
    from asked join wanted using (term) join weights using (term) join docs using (d), corpus c group by all)
select item_id, rank::int as rank, doc_id, score from (
    select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
where rank <= 10
"""

OP13 = r"""
with recursive bytes as (select list_transform(range(256), lambda b: list_reduce(
        list_prepend(b::bigint, [0, 1, 2, 3, 4, 5, 6, 7]),
        lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab)
, found as (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z\x{C0}-\x{FF}]+')) as run from documents where text is not null)
, counted as (select doc_id, run, count(*) as n from found where length(run) >= 6 group by all)
, hashed as (
    select run, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
        string_split(concat(doc_id, ':', run), ''),
        lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, (unicode(c) - 64)::bigint] end))),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) as h
    from counted, bytes)
, spelt as (
    select case when h % 199 = 0 then concat(left(run, (h % length(run))::int), substr(run, (h % length(run))::int + 2)) else run end as word, n
    from hashed)
, words as materialized (select word, sum(n)::bigint as n from spelt where length(word) >= 6 group by word having sum(n) >= 5)
, gaps as materialized (
    select word, n, i, concat(left(word, i::int - 1), substr(word, i::int + 1)) as less
    from (select word, n, unnest(range(1, length(word) + 1)) as i from words))
, near as materialized (
    select a.word, b.word as near, b.n as near_n from gaps a join gaps b on a.i = b.i and a.less = b.less and a.word <> b.word
    union select g.word, w.word, w.n from gaps g join words w on g.less = w.word
    union select w.word, g.word, g.n from gaps g join words w on g.less = w.word)
, ranked as (
    select *, row_number() over (partition by word order by near_n desc, near) as r, count(*) over (partition by word) as n_near
    from near)
, formed as materialized (
    select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 5 * w.n then near end as form,
        case when near_n >= 5 * w.n then near_n end as form_n
    from words w left join ranked r on r.word = w.word and r.r = 1)
, steps(word, seen, depth) as (
    select word, word, 0 from formed
    union all select s.word, f.form, depth + 1 from steps s join formed f on f.word = s.seen where f.form is not null)
select f.word, form, arg_max(seen, depth) as root, n, n_near, form_n
from formed f join steps s on s.word = f.word group by f.word, form, n, n_near, form_n
"""
