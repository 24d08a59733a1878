"""One query for each operator over its whole table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from junctura.llm import (exact_dedup, filter_audit, hard_negatives, language_id, license_scan, line_dedup, minhash_dedup, mixing, packing, pii,
                          quality, toxicity, url_filter)
from junctura.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


@query("op2_exact_dedup", r"""
with n as (select doc_id, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256 from documents),
r as (select *, first_value(doc_id) over (partition by text_sha256 order by chars desc, doc_id) as keep_id, count(*) over (partition by text_sha256) as group_size from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from r""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op6_redirect_blocks", r"""
with u as (select page_id, coalesce(url, '') as url from pages),
p as (select page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from u),
rules as (select * from (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(h, d, v)),
hit as (select p.host, p.path, h || d as rule, v, row_number() over (partition by p.host, p.path order by length(h || d) desc, v = 'allow' desc, h || d desc) as k
        from (select distinct host, path from p) p join rules on (p.host = h or suffix(p.host, '.' || h)) and starts_with(p.path, d))
select page_id, p.host, p.path, rule, coalesce(v, 'allow') as verdict from p left join (from hit where k = 1) x on x.host = p.host and x.path = p.path""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


@query("op9_pareto_mix", r"""
with z as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, count(*) as n, row_number() over (order by source nulls last) as k from z group by source),
w as (select *, case (k - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 2 * source_size as cap from s),
r as (select *, cap / weight as ratio, 150 * (select sum(source_size) from s)::bigint as total from w),
f as (select *, coalesce(sum(cap) over (order by ratio, k rows between unbounded preceding and 1 preceding), 0) as before, sum(weight) over (order by ratio, k rows between current row and unbounded following) as rest from r),
g as (select *, 100.0::double * cap * rest < (total - 100 * before)::double * weight as is_full from f),
l as (select coalesce(sum(case when is_full then cap end), 0)::bigint as c, sum(case when is_full then 0 else weight end)::bigint as w from g),
t as (select source, source_size, n, case when is_full then cap::double else ((total - 100 * c)::double / 100.0::double) * weight / l.w::double end as target from g, l),
h as (select *, case when source_size > 0 then target / source_size else 0 end as ratio, least(floor(case when source_size > 0 then target / source_size else 0 end), 2) as whole from t),
d as (select z.doc_id, z.source, z.size, h.source_size, h.target, h.whole, h.ratio - h.whole as f, h.target - h.whole * h.source_size as need, h.source_size::double / h.n as mean,
      (('0x' || substr(md5('7:' || coalesce(z.doc_id::varchar, '')), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double as u from z join h on z.source is not distinct from h.source),
q as (select *, pow(1 - f, size / mean) as keep from d where size > 0 and f > 0 and whole < 2),
q2 as (select doc_id, source, size, need, (u / (1 - u)) * keep / greatest(1 - keep, 1e-300) as q from q),
c as (select *, sum(size) over (partition by source order by q, doc_id rows unbounded preceding) as until from q2),
i as (select *, until - need <= need - (until - size) as inside from c),
e as (select source, need - coalesce(max(case when inside then until end), 0) as gap, max(case when inside then until end) as edge from i group by source, need),
x as (select i.*, e.gap, coalesce(i.until <= e.edge, false) as extra from i join e on i.source is not distinct from e.source),
b as (select doc_id, source, row_number() over (partition by source order by abs(gap - size), q, doc_id) as k from x where not extra and gap > 0 and abs(gap - size) < gap),
y as (select doc_id, source from x where extra union select doc_id, source from b where k = 1)
select d.doc_id, d.size, d.source_size, d.target, (case when d.size > 0 then d.whole + case when y.doc_id is not null then 1 else 0 end else 0 end)::int as copies,
       (case when d.size > 0 then d.whole + case when y.doc_id is not null then 1 else 0 end else 0 end * d.size)::bigint as taken
from d left join y on y.doc_id = d.doc_id and y.source is not distinct from d.source""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "copies", "taken")


@query("op10_line_first_quality", r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as k from d),
g as (select doc_id, k, w, lead(w) over (partition by doc_id order by k) as w2, lead(w, 2) over (partition by doc_id order by k) as w3 from w),
g2 as (select doc_id, k, w3 is not null and count(*) over (partition by doc_id, w, w2, w3) > 1 as again from g),
g3 as (select doc_id, again or coalesce(lag(again) over (partition by doc_id order by k), false) or coalesce(lag(again, 2) over (partition by doc_id order by k), false) as covered from g2),
r as (select doc_id, count(*) filter (covered) as n_repeat_words from g3 group by doc_id),
l as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
m as (select doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n, len(regexp_extract_all(line, '[#*$%&|<>!=_~^]')) as marks, len(regexp_extract_all(line, '[|»›•·]')) as bars,
      regexp_matches(line, '(?i)^[\x20\x09-\x0D]*(home|menu|next|previous|back to top|skip to content|log ?in|sign ?in|sign ?up|register|search|share|sitemap|contact us|contact|about us|about|faq|help)[\x20\x09-\x0D]*$') as nav,
      regexp_matches(line, '(?i)(all rights reserved|cookie policy|accept cookies|uses cookies|privacy policy|terms of use|terms of service|enable javascript|subscribe to our newsletter|click here to|powered by)') as stock from l),
x as (select doc_id, sum(case when (marks >= 3 and 2 * marks > n) or (bars >= 2 and 4 * bars >= n) or nav or (stock and n <= 30) then length(line) else 0 end)::bigint as lost_chars,
      count(*) filter (n > 0) - count(distinct line) filter (n > 0) as n_dup_lines from m group by doc_id),
a as (select d.doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint as n_words, (length(text) - len(regexp_extract_all(text, '[\x20\x09-\x0D]')))::bigint as word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(lost_chars, 0) as lost_chars, length(text)::bigint as n_chars
      from d left join r using (doc_id) left join x using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost_chars <= 40 * n_chars as kept from a""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept")


@query("op11_filter_audit", r"""
with d as (select row_number() over () as row, doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first from d),
k as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
m as (select part, (len(words) < 50)::int + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::int + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::int
             + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as mask, doc_id from w),
h as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from m left join k using (doc_id) group by part, mask),
l as (select * from (values ('A'), ('B'), ('C'), ('D'), ('E')) t(c)),
o as (select a.c || b.c || c.c || d.c || e.c as filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s as (select filter_order, k as step, substr(filter_order, k::int, 1) as f, 1 << (ascii(substr(filter_order, k::int, 1)) - 65) as bit,
             coalesce(list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(substr(filter_order, i::int, 1)) - 65))), 0)::int as before from o, range(1, 6) t(k)),
x as (select part, filter_order, step, f, coalesce(sum(n) filter (mask & (before | bit) = 0), 0)::bigint as kept, coalesce(sum(n) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as removed,
             coalesce(sum(n) filter (mask & bit <> 0 and mask & before <> 0), 0)::bigint as redundant, coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
             coalesce(sum(good) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as good_lost, coalesce(sum(toxic) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as toxic_lost
      from h, s group by part, filter_order, step, f)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from x""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_hard_negatives", """
with f as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, embedding from embeddings
           where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from f),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id % 100 = 0 and b.vec_id <> a.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, (row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id))::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


@query("op13_language_id")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op8_toxicity_grammar")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_minhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_groups(table(spark, sf_dir, "documents"))


@query("op7_fuzzy_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_groups(table(spark, sf_dir, "documents"))


@query("op1_weak_supervision_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
