"""Queries of the training-data operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, fim, htmlmain, jaccard, licenses, linedup, pii, quality, runs, topk, toxicity
from .common import table

RANKS = "byte_bpe_50k.tiktoken"
OK = "</s>[INST] ok [/INST]"


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % by, F.lit(-1))


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder("doc_id", 4) == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held))
    out = quality.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "n_matches", "permissive")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", OK), (-1, 1, "assistant", OK)], "conv_id long, turn long, role string, text string")
    return chat.summaries(chat.conversations(c.unionByName(own)))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(table(spark, sf_dir, "pages"))


def op10_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.collapse(table(spark, sf_dir, "documents"), plant=F.crc32(F.col("doc_id").cast("string").cast("binary"))))


def op13_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"), pii.fit()))


QUERIES = {
    "op1_quality_gam": op1_quality_gam,
    "op2_license_rules": op2_license_rules,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_chat_format": op4_chat_format,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_exact_topk": op8_exact_topk,
    "op9_html_main_text": op9_html_main_text,
    "op10_toxicity_grammar": op10_toxicity_grammar,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_pii_boosting": op13_pii_boosting,
}

_CONTROL = ["<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<SYS>>", "</SYS>>", "[INST]", "[/INST]", "\\"]
_ADDED = " + ".join(f"(length(x) - length(replace(x, '{c}', ''))) // {len(c)}" for c in _CONTROL)



def _license_sql() -> str:
    """The rules of ``licenses`` as SQL: nested EXISTS for what follows, set differences for what longer rules have used."""
    gap, rules = licenses.GAP, licenses.RULES
    known = ", ".join(f"('{s}', '{i}')" for i, s in licenses.SENTENCES.items())

    def follow(ids: list[str], k: int) -> str:
        if k == len(ids):
            return "true"
        return f"exists (select 1 from seq s{k} where s{k}.doc_id = s0.doc_id and s{k}.id = '{ids[k]}' and s{k}.p > s{k - 1}.p and s{k}.p <= s{k - 1}.p + {gap} and {follow(ids, k + 1)})"

    full = [f"f{no} as (select s0.doc_id, s0.p from seq s0 where s0.id = '{ids[0]}' and {follow(ids, 1)})" for no, (_, _, ids) in enumerate(rules)]
    used = []
    for no, (name, allows, ids) in enumerate(rules):
        firsts = [k for k in range(no) if rules[k][2][0] == ids[0]]
        inside = [k for k in range(no) if ids[0] in rules[k][2][1:]]
        without = "".join(f" and not exists (select 1 from f{k} where f{k}.doc_id = f{no}.doc_id and f{k}.p = f{no}.p)" for k in firsts)
        without += "".join(f" and not exists (select 1 from f{k} where f{k}.doc_id = f{no}.doc_id and f{no}.p > f{k}.p and f{no}.p <= f{k}.p + {gap})" for k in inside)
        used.append(f"select doc_id, '{name}' as name, {str(allows).lower()} as allows from f{no} where true{without}")
    return rf"""
with t as (
  select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '\.(\s|$)', chr(10) || '\1', 'g'), '[\n;!?]+'), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') as s from documents
), placed as (select doc_id, unnest(s) as s, unnest(range(len(s))) as p from t
), known(s, id) as (values {known}
), seq as materialized (select doc_id, p, id from placed join known using (s)
), {", ".join(full)}, used as ({" union all ".join(used)}
), u as (select doc_id, count(*) as n, string_agg(distinct name, ',' order by name) as names, bool_and(allows) as allows from used group by doc_id
), i as (select doc_id, string_agg(id, ',' order by p) as ids from seq group by doc_id)
select d.doc_id, coalesce(ids, '') as sentence_ids, coalesce(names, '') as licenses, coalesce(n, 0)::bigint as n_matches, allows as permissive
from documents d left join u using (doc_id) left join i using (doc_id)"""


_FIM_SQL = """
with d as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as h from documents
), v as (
  select doc_id, t, n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or h1 is null or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from v
), p as (select *, substring(t, 1, a) as pre, substring(t, a + 1, b - a) as mid, substring(t, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p"""


ORACLES = {
    "op11_fill_in_middle": _FIM_SQL,
    "op2_license_rules": _license_sql(),
    "op4_chat_format": f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{OK}' union all select -1, 1, 'assistant', '{OK}'
), sized as (
  select *, (select length(x) + {_ADDED} from (select role as x)) + (select length(x) + {_ADDED} from (select text as x)) + {len(chat.TURN + chat.TEXT + chat.END)} as n from c
), prefixed as (
  select *, sum(n) over (partition by conv_id order by turn nulls first, role, text rows unbounded preceding) as upto from sized
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  coalesce(sum(upto) filter (role = 'assistant'), 0)::bigint as formatted_chars
from prefixed group by conv_id""",
    "op5_ngram_jaccard": r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), g as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) end as s from d
), e as (select doc_id, unnest(s) as x from g
), l as (
  select p.doc_id as a, q.doc_id as b from e p join e q on p.x = q.x and p.doc_id <> q.doc_id join g gp on gp.doc_id = p.doc_id join g gq on gq.doc_id = q.doc_id
  group by p.doc_id, q.doc_id, len(gp.s), len(gq.s) having 100 * count(*) >= 90 * (len(gp.s) + len(gq.s) - count(*))
), r as (select doc_id as a, doc_id as b from d union select r.a, l.b from r join l on l.a = r.b)
select g.doc_id, len(g.s)::bigint as n_shingles, min(r.b) as component_id from g join r on r.a = g.doc_id group by g.doc_id, len(g.s)""",
    "op8_exact_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as w from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.w, c.w)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5""",
    "op7_decontaminate": r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents
), b as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from benchmark
), bw as (
  select item_id, least(len(w), 10) as size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) as win from b where len(w) > 0
), sizes as (select distinct size from bw
), dw as (
  select doc_id, size, unnest(range(1, len(w) - size + 2)) as p0, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) as win from d, sizes where len(w) >= size
), m as (select dw.doc_id, dw.p0, dw.size, bw.item_id from dw join bw using (size, win)
), hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(p0, p0 + size)) as p from m) group by doc_id
), items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from m group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)""",
}
