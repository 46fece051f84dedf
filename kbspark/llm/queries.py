"""The queries of the operators over their whole tables, with production parameters, and SQL for those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hmm, html_text, langid, line_dedup, mixing, mtree, near_dedup, packing, quality, secrets, spelling, substring_dedup, whitening
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_spans(table(spark, sf_dir, "documents"), texts=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(table(spark, sf_dir, "documents"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.withColumn("score", F.round("score", 6))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), texts=False)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_language_id, op3_source_mixing, op4_near_dedup, op5_html_text, op6_lm_scoring, op7_topk_search, op8_secret_scan, op9_packing, op10_quality, op11_line_dedup, op12_spelling_variants, op13_whitening)}



def _secrets_sql() -> str:
    """Spans by the lengths of the pieces between matches; counts of owners and repositories by value; then the rows."""
    kinds = []
    for k, (name, pattern, group, least) in enumerate(secrets.KINDS):
        p = pattern.replace("'", "''")
        rule = f"length(g) >= {least}" + (" and regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]')" if name == "opaque" else "")
        kinds.append(
            f"""select doc_id, owner, repository, {k} as kind, '{name}' as name, g, start, start + length(m) as stop from (select *, ms[i] as m, gs[i] as g, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as start
 from (select *, unnest(range(1, len(ms) + 1)) as i from (select *, string_split_regex(text, '{p}') as parts, regexp_extract_all(text, '{p}', 0) as ms, regexp_extract_all(text, '{p}', {group}) as gs from t))) where {rule}"""
        )
    return f"""with t as (select doc_id, coalesce(text, '') as text, coalesce('=' || source, '') as owner, coalesce('=' || source, '') || '/' || coalesce(lang, '') as repository from documents),
 found as ({" union all ".join(kinds)}),
 clear as (select * from found f where kind < {len(secrets.BASE)} or not exists (select 1 from found b where b.doc_id = f.doc_id and b.kind < {len(secrets.BASE)} and b.start < f.stop and f.start < b.stop)),
 seen as (select g, count(distinct owner) as owners, count(distinct repository) as repositories from clear group by 1),
 shown as (select c.*, owners, repositories, owners <= {secrets.OWNERS} and repositories <= {secrets.REPOSITORIES} as live from clear c join seen using (g)),
 a as (select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, string_agg(name || ':' || start || ':' || stop, ',' order by start, kind, stop) filter (kind < {len(secrets.BASE)}) as base, string_agg(name || ':' || start || ':' || stop, ',' order by start, kind, stop) as spans,
 count(*) filter (live) as n_live, count(*) filter (not live) as n_copied, max(owners) as max_owners, max(repositories) as max_repositories from shown where kind < {len(secrets.BASE)} or live group by 1)
 select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied,
 coalesce(max_owners, 0) as max_owners, coalesce(max_repositories, 0) as max_repositories from t left join a using (doc_id)"""


_SPLIT = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLES: dict[str, str] = {
    "op1_substring_dedup": f"""with d as (select doc_id, {_SPLIT} as w from documents),
 win as (select doc_id, i, array_to_string(w[i : i + 49], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)),
 firsts as (select s, min(doc_id) as m from win group by s), bad as (select doc_id, i from win join firsts using (s) where m < doc_id),
 gone as (select distinct doc_id, unnest(range(i, i + 50)) as j from bad), word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as j from d),
 kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by j) as t from word anti join gone using (doc_id, j) group by doc_id)
 select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)""",
    "op4_near_dedup": f"""with recursive d as (select doc_id, {_SPLIT.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
 sh as (select distinct doc_id, s from (select doc_id, array_to_string(w[i : i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0))),
 n as (select doc_id, count(*) as n from sh group by 1), pairs as (select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
 links as (select a, b from pairs p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)), sym as (select a, b from links union select b, a from links),
 reach as (select doc_id as a, doc_id as b from d union select reach.a, sym.b from reach join sym on sym.a = reach.b), c as (select a, min(b) as m from reach group by 1)
 select d.doc_id, coalesce(n, 0)::bigint as n_shingles, m as component_id, m = d.doc_id as kept from d join c on c.a = d.doc_id left join n using (doc_id)""",
    "op7_topk_search": """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
 p as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0)
 select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from p qualify rank <= 5""",
    "op8_secret_scan": _secrets_sql(),
    "op11_line_dedup": """with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
 l as (select doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as j from t),
 k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
 f as (select key, max(doc_id) as last from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
 kept as (select k.doc_id, count(*) as n, string_agg(line, chr(10) order by j) as t from k left join f using (key) where f.key is null or k.doc_id = last group by 1)
 select t.doc_id, len(ls)::bigint as n_lines, (len(ls) - coalesce(n, 0))::bigint as n_dropped, sha256(coalesce(kept.t, '')) as kept_sha256 from t left join kept using (doc_id)""",
}
