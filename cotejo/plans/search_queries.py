"""Queries of the fuzzy search (SIM14-15, JN7, TK6, N15, N17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import search
from . import duck as dk
from . import inputs as i


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's distinct rows as items, in the order of their first line."""
    first = i.catalog(spark, sf_dir).groupBy("titulo", "autor").agg(F.min("line_no").alias("ord"))
    return first.select(F.col("ord").alias("item_id"), "ord", "titulo", "autor")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query for each supplier: a prefix, a title, a title with an author, a typo, a word."""
    subs, k = i.submissions(spark, sf_dir), F.col("sub_id")
    query = F.when(k % 5 == 0, F.left("titulo", F.lit(6))).when(k % 5 == 1, F.col("titulo")).when(k % 5 == 2, F.concat_ws(" | ", "titulo", "autor")).when(k % 5 == 3, F.concat(F.lit("|"), "autor")).otherwise(F.get(F.split("titulo", " "), 1))
    return subs.select(k.alias("query_id"), query.alias("query"))


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.rank(_queries(spark, sf_dir), _items(spark, sf_dir))
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "item_id", F.round("score", 6).alias("score"), F.round("title_rel", 6).alias("title_rel"), F.round("author_rel", 6).alias("author_rel"))


def highlight_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page titles with the first four letters of their second word marked, a third of the titles with
    letters and accents apart."""
    pages = i.page_titles(spark, sf_dir)
    query = F.concat(F.left(F.coalesce(F.get(F.split("titulo", " "), 1), F.lit("")), F.lit(4)), F.lit("|x"))
    apart = F.replace(F.replace("titulo", F.lit("e"), F.lit("e\u0301")), F.lit("ä"), F.lit("a\u0308"))
    titulo = F.when(F.col("page_id") % 3 == 0, apart).otherwise(F.col("titulo"))
    return pages.select("page_id", query.alias("query"), search.highlight(titulo, query).alias("html"))


QUERIES = {f.__name__: f for f in (search_topk, highlight_hits)}


def _relevance(q: str, f: str, out: str) -> str:
    tokens = {c: dk.search_tokens(f"b{c}") for c in "qf"}
    strong = {c: f"list_filter({tokens[c]}, lambda w: length(w) >= 4 AND w NOT IN {dk.words_in(tx.GENERIC_WORDS)})" for c in "qf"}
    return f"""
{out}_0 AS (SELECT q, f FROM {q}, {f} WHERE q <> '' AND f <> ''),
{out}_1 AS (SELECT *, {dk.strip_article('q')} AS aq, {dk.strip_article('f')} AS af FROM {out}_0),
{out}_2 AS (SELECT q, f, {dk.strip_subtitle('aq')} AS bq, {dk.strip_subtitle('af')} AS bf FROM {out}_1),
{out}_3 AS (SELECT q, f, bq, bf, CASE WHEN q = f THEN 1.0::DOUBLE WHEN instr(f, q) = 1 THEN 0.97::DOUBLE WHEN instr(f, q) > 1 THEN 0.90::DOUBLE WHEN len(list_filter(string_split(q, ' '), lambda a: len(list_filter(string_split(f, ' '), lambda b: starts_with(b, a))) = 0)) = 0 THEN 0.86::DOUBLE END AS fixed, {tokens['q']} AS qt, {tokens['f']} AS ft, {strong['q']} AS qs, {strong['f']} AS fs FROM {out}_2),
{out}_4 AS (SELECT DISTINCT q, f, unnest(qs) AS a, fs FROM {out}_3 WHERE fixed IS NULL),
{out}_5 AS (SELECT q, f, a, unnest(fs) AS b FROM {out}_4), {dk.jaro_ctes(f'{out}_5', f'{out}_wj')},
{out}_6 AS (SELECT DISTINCT q, f FROM {out}_5 JOIN {out}_wj USING (a, b) WHERE jw >= 0.90 OR (jw >= 0.86 AND a[1:4] = b[1:4])),
{out}_7 AS (SELECT t.*, {dk.token_jaccard('qt', 'ft')} AS jac, bq AS a, bf AS b FROM {out}_3 t JOIN {out}_6 USING (q, f)), {dk.jaro_ctes(f'{out}_7', f'{out}_fj')},
{out}_8 AS (SELECT q, f, jac, greatest(CASE WHEN jac >= 0.85 THEN 0.84::DOUBLE ELSE 0.0::DOUBLE END, jw) AS best FROM {out}_7 JOIN {out}_fj USING (a, b)),
{out} AS (SELECT q, f, fixed AS rel FROM {out}_3 WHERE fixed IS NOT NULL UNION ALL SELECT q, f, CASE WHEN jac > 0.5 AND best < 0.8 THEN greatest(best, 0.6::DOUBLE + jac * 0.2::DOUBLE) ELSE best END FROM {out}_8)"""


_SEARCH = f"""
items AS (SELECT min(line_no) AS item_id, titulo, autor, {dk.normalize_search('titulo')} AS tf, {dk.normalize_search('autor')} AS af FROM catalog GROUP BY titulo, autor),
qs AS (SELECT sub_id AS query_id, CASE sub_id % 5 WHEN 0 THEN titulo[1:6] WHEN 1 THEN titulo WHEN 2 THEN titulo || ' | ' || autor WHEN 3 THEN '|' || autor ELSE string_split(titulo, ' ')[2] END AS query FROM submissions),
qp AS (SELECT query_id, CASE WHEN instr(query, '|') > 0 THEN query[1:instr(query, '|') - 1] ELSE query END AS t, CASE WHEN instr(query, '|') > 0 THEN query[instr(query, '|') + 1:] ELSE '' END AS a FROM qs),
qn AS (SELECT query_id, {dk.normalize_search('t')} AS tq, {dk.normalize_search('a')} AS aq FROM qp),
qw AS (SELECT *, CASE WHEN aq <> '' THEN aq ELSE tq END AS wq FROM qn WHERE tq <> '' OR aq <> ''),
q1 AS (SELECT DISTINCT tq AS q FROM qw), f1 AS (SELECT DISTINCT tf AS f FROM items), q2 AS (SELECT DISTINCT wq AS q FROM qw), f2 AS (SELECT DISTINCT af AS f FROM items),
{_relevance('q1', 'f1', 'rt')}, {_relevance('q2', 'f2', 'ra')},
pairs AS (SELECT query_id, item_id, titulo, aq, coalesce(rt.rel, 0.0) AS tr, coalesce(ra.rel, 0.0) AS ar FROM qw, items LEFT JOIN rt ON rt.q = tq AND rt.f = tf LEFT JOIN ra ON ra.q = wq AND ra.f = af),
scored AS (SELECT *, CASE WHEN aq <> '' THEN tr * 0.7::DOUBLE + ar * 0.3::DOUBLE ELSE greatest(tr, ar) END AS score FROM pairs WHERE CASE WHEN aq <> '' THEN tr >= 0.55 OR (tr * 0.6::DOUBLE + ar * 0.4::DOUBLE >= 0.55 AND tr >= 0.4) ELSE greatest(tr, ar) >= 0.55 END),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(titulo), item_id) AS rank FROM scored)"""


def _escape(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


ORACLE_SQL = {
    "search_topk": f"WITH {i.CATALOG}, {i.SUBMISSIONS}, {_SEARCH} SELECT query_id, rank, item_id, round(score, 6) AS score, round(tr, 6) AS title_rel, round(ar, 6) AS author_rel FROM ranked WHERE rank <= 8",
    "highlight_hits": f"""WITH {i.PAGE_TITLES},
q AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(replace(titulo, 'e', 'e' || chr(769)), 'ä', 'a' || chr(776)) ELSE titulo END AS titulo, coalesce(string_split(titulo, ' ')[2], '')[1:4] AS t FROM page_titles),
n AS (SELECT *, {dk.normalize_search("string_split(t, '|')[1]")} AS n, list_transform(range(1, length(titulo) + 1), lambda k: lower({dk.fold('substring(titulo, k, 1)')})) AS f FROM q),
p AS (SELECT *, CASE WHEN n <> '' THEN instr(array_to_string(f, ''), n) ELSE 0 END AS pos FROM n),
m AS (SELECT *, list_filter(range(1, len(f) + 1), lambda k: length(array_to_string(f[1:k], '')) >= pos)[1] AS a, list_filter(range(1, len(f) + 1), lambda k: length(array_to_string(f[1:k], '')) >= pos + length(n) - 1)[1] AS b FROM p)
SELECT page_id, t || '|x' AS query, CASE WHEN pos > 0 THEN {_escape('substring(titulo, 1, a - 1)')} || '<mark>' || {_escape('substring(titulo, a, b - a + 1)')} || '</mark>' || {_escape('substring(titulo, b + 1)')} ELSE {_escape('titulo')} END AS html FROM m""",
}
