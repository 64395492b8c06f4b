"""The registered queries of this subpackage; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, lines, minhash, mixing, quality, secrets, topk, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.tracked(pages)).select("page_id", "host", "path", "rule", "verdict")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.windows(turns.unionByName(extra)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), order=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash, "op2_lines": op2_lines, "op3_secrets": op3_secrets, "op4_mixing": op4_mixing, "op5_urls": op5_urls, "op6_topk": op6_topk,
    "op7_chat": op7_chat, "op8_toxicity": op8_toxicity, "op9_decontaminate": op9_decontaminate, "op10_quality": op10_quality,
}

_FORM = """case when strpos(url, '://') > 0 then regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
  || case when q <> '' then '?' || q else '' end end"""
SQL: dict[str, str] = {
    "op5_urls": f"""
with a as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select *, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') as host from a),
c as (select *, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') as path,
  regexp_replace(regexp_replace(coalesce(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), ''), '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') as q from b),
rules as (select * from (values {", ".join(f"('{v}', '{r}', '{r.split('/')[0]}', '/{r.split('/', 1)[1]}')" for v, r in urls.RULES)}) t(what, rule, h, p)),
d as (select *, {_FORM} as form from c),
e as (select d.*, r.rule, r.what, row_number() over (partition by page_id, url order by length(r.rule) desc, r.rule) as turn
  from d left join rules r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)),
listed as (select distinct form from d where regexp_matches(url, '[?&]utm_[a-z]+='))
select page_id, host, path, rule, coalesce(what, case when form in (select form from listed where form is not null) then 'block' else 'allow' end) as verdict
from e where turn = 1""",
    "op6_topk": """
with v as (select vec_id, [floor(1024 * x::double)::bigint for x in embedding] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)])::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 10""",
    "op9_decontaminate": rf"""
with b as (select distinct item_id, regexp_extract_all(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '{decontaminate.WORD}') as w from benchmark where text is not null),
bw as (select item_id, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s, w from b where len(w) > 0),
win as (select distinct item_id, k, array_to_string(w[s:s + k - 1], ' ') as g from bw),
d as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '{decontaminate.WORD}'), []) as w from documents),
ks as (select distinct k from win),
dw as (select r, k, unnest(range(1, len(w) - k + 2)) as s, w from d, ks where len(w) >= k),
hit as (select dw.r, dw.s, dw.k, win.item_id from dw join win on dw.k = win.k and array_to_string(w[s:s + dw.k - 1], ' ') = win.g),
pos as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + k)) as p from (select distinct r, s, k from hit)) group by r),
it as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (r) left join it using (r)""",
}
