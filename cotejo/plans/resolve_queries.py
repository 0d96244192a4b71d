"""Queries of entity resolution (SRC4-6, SRC8, ST1, JN4-6, AG1-9, TK3-5, SIM11-13, DC2-4, PRJ4, PRJ6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import resolve
from ..sources import external
from . import duck as dk
from . import inputs as i


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as the rows of three external catalogues."""
    part = i.table(spark, sf_dir, "part")
    source = F.element_at(F.array(*map(F.lit, external.SOURCES)), (F.col("p_size") % 3 + 1).cast("int"))
    titulo = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(": edición "), F.col("p_size").cast("string"))).otherwise(F.col("p_name"))
    year = F.when(F.col("p_size") % 7 != 0, F.col("p_size") + 1950)
    return part.select(source.alias("source"), F.col("p_partkey").alias("ord"), titulo.alias("titulo"), F.concat("p_brand", F.lit(" "), "p_type").alias("autor"), year.alias("year"))


_EXT = "ext AS (SELECT (['apple_books', 'google_books', 'openlibrary'])[p_size % 3 + 1] AS source, p_partkey AS ord, CASE WHEN p_partkey % 5 = 0 THEN p_name || ': edición ' || p_size ELSE p_name END AS titulo, p_brand || ' ' || p_type AS autor, CASE WHEN p_size % 7 <> 0 THEN p_size + 1950 END AS year FROM part)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for most suppliers' submissions, some broken, as JSON text; `reconocido` is any kind of value."""
    rows = i.table(spark, sf_dir, "supplier").join(i.table(spark, sf_dir, "part"), F.col("s_suppkey") == F.col("p_partkey"))
    k = F.col("s_suppkey")
    answer = F.to_json(F.struct(F.concat(F.lit(" "), "p_name").alias("titulo_canonico"), F.concat("p_brand", F.lit(" "), "p_type").alias("autor_canonico"), F.when(k % 3 != 0, F.lit(1990)).alias("year"), ((60 + k * 7 % 41) / 100).alias("confianza"), F.col("s_name").alias("razon")))
    said = F.when(k % 5 == 0, F.get(F.array(*map(F.lit, ("false", '""', "0", "null"))), (k % 4).cast("int"))).otherwise(F.get(F.array(*map(F.lit, ("true", '"true"', "1", '"no"', "{}"))), (k % 7 % 5).cast("int")))
    answer = F.concat(F.lit('{"reconocido":'), said, F.lit(","), F.substring(answer, 2, 2**31 - 1))
    return rows.filter("s_acctbal >= 0").select(k.alias("sub_id"), F.when(k % 9 == 0, "{broken").otherwise(answer).alias("content"))


_ANSWERS = "answers AS (SELECT s_suppkey AS sub_id, s_suppkey % 9 <> 0 AND s_suppkey % 5 <> 0 AS reconocido, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE p_name END AS titulo_canonico, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE p_brand || ' ' || p_type END AS autor_canonico, CASE WHEN s_suppkey % 9 <> 0 AND s_suppkey % 3 <> 0 THEN 1990 END AS year, CASE WHEN s_suppkey % 9 = 0 THEN 0.0::DOUBLE ELSE (60 + s_suppkey * 7 % 41) / 100::DOUBLE END AS confianza, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE s_name END AS razon FROM supplier JOIN part ON s_suppkey = p_partkey WHERE s_acctbal >= 0)"


def candidates_from_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers of three catalogues, one for each brand, as candidates."""
    part = i.table(spark, sf_dir, "part").withColumn("raw_id", F.col("p_brand"))
    name = F.when(F.col("p_size") % 4 != 0, F.concat(F.lit(" "), "p_name"))

    def raw(item) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item"))))
        return part.groupBy("raw_id").agg(F.to_json(F.transform(listed, lambda x: x.item)).alias("content"))

    date = F.concat(F.lit("19"), F.lpad((F.col("p_size") + 10).cast("string"), 2, "0"))
    a = external.apple(raw(F.struct(name.alias("trackName"), F.col("p_type").alias("artistName"), F.concat(date, F.lit("-05-06T07:00:00Z")).alias("releaseDate"))))
    g = external.google(raw(F.struct(F.struct(name.alias("title"), F.when(F.col("p_size") % 3 != 0, F.array("p_type", "p_brand")).alias("authors"), F.when(F.col("p_size") % 2 == 0, F.concat(date, F.lit("-05"))).otherwise(F.lit("s.f.")).alias("publishedDate")).alias("volumeInfo"))))
    o = external.openlibrary(raw(F.struct(name.alias("title"), F.array("p_type").alias("author_name"), (F.col("p_size") % 5 * 400).alias("first_publish_year"))))
    return a.unionByName(g).unionByName(o)


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates_from_sources(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("raw_id").alias("answers"))


def candidate_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = i.submissions(spark, sf_dir)
    return resolve.retrieve(subs.select("sub_id", resolve._query("titulo", "autor")), resolve.index(_catalog(spark, sf_dir), stored=True))


def verify_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resolve.score_candidates(i.submissions(spark, sf_dir), candidate_retrieval(spark, sf_dir))
    return scored.select("sub_id", "ord", F.round("sim_t", 6).alias("sim_t"), F.round("sim_a", 6).alias("sim_a"), F.round("sim_c", 6).alias("sim_c"))


def consensus_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = resolve.ranked_groups(i.submissions(spark, sf_dir), _catalog(spark, sf_dir))
    return groups.select("sub_id", "rank", "titulo", "autor", F.array_join("sources", ",").alias("sources"), F.round("sim_t", 6).alias("sim_t"), F.round("sim_a", 6).alias("sim_a"), F.round("sim_c", 6).alias("sim_c"), "year")


def llm_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed answers, whether they pass, and the prompt that asked for them."""
    a = external.answers(_answers(spark, sf_dir))
    passes = F.col("reconocido") & (F.col("confianza") >= resolve.ANSWER_LEAST) & (F.col("titulo_canonico") != "") & (F.col("autor_canonico") != "")
    prompt = resolve.prompt(F.col("titulo"), F.col("autor"))
    return a.join(i.submissions(spark, sf_dir).select("sub_id", "titulo", "autor"), "sub_id").select("sub_id", "reconocido", "titulo_canonico", "autor_canonico", "year", "confianza", "razon", passes.alias("passes"), prompt.alias("prompt"))


def answer_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.confirmations(external.answers(_answers(spark, sf_dir)), _catalog(spark, sf_dir))
    return found.select("sub_id", F.array_join("confirming", ",").alias("sources"), "confirmed_year")


def resolve_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs, catalog = i.submissions(spark, sf_dir), resolve.index(_catalog(spark, sf_dir), stored=True)  # read by three retrievals
    answers = external.answers(_answers(spark, sf_dir))
    # each part ends its lineage, so that the driver never plans them all at once
    decided = resolve.decide(subs, resolve.ranked_groups(subs, catalog).checkpoint(), answers, resolve.confirmations(answers, catalog).checkpoint())
    return resolve.hint(resolve.intake_outcome(decided))


QUERIES = {f.__name__: f for f in (candidates_from_sources, source_counts, candidate_retrieval, verify_scores, consensus_groups, llm_gate, answer_confirmations, resolve_decisions)}


def _retrieve(queries: str, out: str, base: int = 0) -> str:
    tokens = "list_distinct(list_filter(string_split({}, ' '), lambda t: length(t) >= 2))"
    return f"""
{out}_k AS (SELECT source, ord, titulo, autor, year, {dk.normalize_verify("concat_ws(' ', titulo, autor)")} AS n FROM ext),
{out}_p AS (SELECT source, ord, unnest({tokens.format('n')}) AS token FROM {out}_k),
{out}_w AS (SELECT token, CAST(floor(1000 * ln(1 + (SELECT count(*) FROM ext) / count(*)::DOUBLE)) AS BIGINT) AS weight FROM {out}_p GROUP BY token),
{out}_n AS (SELECT sub_id, {dk.normalize_verify('query')} AS n FROM {queries}),
{out}_a AS (SELECT sub_id, unnest({tokens.format('n')}) AS token FROM {out}_n),
{out}_h AS (SELECT sub_id, source, ord, sum(weight) AS score FROM {out}_a JOIN {out}_w USING (token) JOIN {out}_p USING (token) GROUP BY ALL),
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY sub_id, source ORDER BY score DESC, ord) AS rank FROM {out}_h),
{out} AS (SELECT sub_id, source, CAST({base} + list_position(['apple_books', 'google_books', 'openlibrary'], source) * 100 + rank AS INTEGER) AS ord, titulo, autor, year FROM {out}_r JOIN ext USING (source, ord) WHERE rank <= 15)"""


def _score(cands: str, subs: str, out: str) -> str:
    return f"""
{out}_c AS (SELECT c.*, coalesce(s.titulo, '') AS it, coalesce(s.autor, '') AS ia FROM {cands} c JOIN {subs} s USING (sub_id)),
{out}_t0 AS (SELECT DISTINCT it AS a, titulo AS b, {dk.normalize_verify('it')} AS an, {dk.normalize_verify('titulo')} AS bn FROM {out}_c),
{out}_t1 AS (SELECT *, {dk.strip_article('an', tx.ARTICLES_SHORT)} AS aa, {dk.strip_article('bn', tx.ARTICLES_SHORT)} AS ba FROM {out}_t0),
{out}_t2 AS (SELECT a, b, an, bn, {dk.strip_subtitle_verify('aa')} AS x, {dk.strip_subtitle_verify('ba')} AS y FROM {out}_t1),
{out}_t3 AS (SELECT x AS a, y AS b FROM {out}_t2), {dk.jaro_ctes(f'{out}_t3', f'{out}_tj', 1)},
{out}_t4 AS (SELECT *, string_split(x, ' ') AS xs, string_split(y, ' ') AS ys FROM {out}_t2),
{out}_t AS (SELECT t.a AS it, t.b AS titulo, CASE WHEN an = bn THEN 1.0::DOUBLE WHEN x = y THEN 0.97::DOUBLE ELSE greatest({dk.dice('x', 'y')}, {dk.word_pair('xs', 'ys')}, j.jw) END AS sim_t FROM {out}_t4 t JOIN {out}_tj j ON j.a = x AND j.b = y),
{out}_a0 AS (SELECT DISTINCT ia AS a, autor AS b, {dk.normalize_verify('ia')} AS an, {dk.normalize_verify('autor')} AS bn FROM {out}_c),
{out}_a1 AS (SELECT *, {dk.author_tokens('an')} AS x, {dk.author_tokens('bn')} AS y FROM {out}_a0),
{out}_a2 AS (SELECT *, array_to_string(x, ' ') AS xj, array_to_string(y, ' ') AS yj FROM {out}_a1),
{out}_a3 AS (SELECT xj AS a, yj AS b FROM {out}_a2), {dk.jaro_ctes(f'{out}_a3', f'{out}_aj', 1)},
{out}_a AS (SELECT t.a AS ia, t.b AS autor, CASE WHEN an = bn THEN 1.0::DOUBLE WHEN len(x) > 0 AND len(y) > 0 AND CASE WHEN len(x) <= len(y) THEN list_has_all(y, x) ELSE list_has_all(x, y) END THEN 0.95::DOUBLE ELSE greatest({dk.word_pair('x', 'y')}, j.jw) END AS sim_a FROM {out}_a2 t JOIN {out}_aj j ON j.a = xj AND j.b = yj),
{out} AS (SELECT c.*, sim_t, sim_a, sim_t * 0.55::DOUBLE + sim_a * 0.45::DOUBLE AS sim_c FROM {out}_c c JOIN {out}_t USING (it, titulo) JOIN {out}_a USING (ia, autor))"""


def _groups(scored: str, out: str) -> str:
    return f"""
{out}_0 AS (SELECT *, {dk.strip_article(dk.normalize_verify('titulo'), tx.ARTICLES_SHORT)} AS k0 FROM {scored}),
{out}_1 AS (SELECT *, {dk.strip_subtitle_verify('k0')} AS k1 FROM {out}_0),
{out}_2 AS (SELECT *, {dk.normalize_verify('k1')} AS key FROM {out}_1),
{out}_3 AS (SELECT sub_id, key, arg_max(titulo, (sim_t, -ord)) AS titulo, arg_max(autor, (sim_a, -ord)) AS autor, list(source ORDER BY ord) AS ls, max(sim_t) AS sim_t, max(sim_a) AS sim_a, max(sim_c) AS sim_c, min(nullif(year, 0)) AS year, min(ord) AS ord FROM {out}_2 GROUP BY sub_id, key),
{out}_4 AS (SELECT * EXCLUDE (ls), list_filter(ls, lambda s, i: list_position(ls, s) = i) AS sources FROM {out}_3),
{out} AS (SELECT *, CAST(row_number() OVER (PARTITION BY sub_id ORDER BY len(sources) DESC, sim_c DESC, ord) AS INTEGER) AS rank FROM {out}_4)"""


_BASE = ", ".join((i.CATALOG, i.SUBMISSIONS, _EXT, "q1 AS (SELECT sub_id, trim(concat_ws(' ', titulo, autor)) AS query FROM submissions)", _retrieve("q1", "r1"), _score("r1", "submissions", "s1")))
_RANKED = ", ".join((_BASE, _groups("s1", "g1"), "q2 AS (SELECT s.sub_id, trim(autor) AS query FROM submissions s LEFT JOIN (SELECT sub_id, sim_a FROM g1 WHERE rank = 1) t USING (sub_id) WHERE coalesce(t.sim_a, 0) < 0.70 AND length(trim(autor)) >= 4)", _retrieve("q2", "r2", 1000), _score("r2", "submissions", "s2"), "s3 AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2)", _groups("s3", "g2")))
_CONFIRM = ", ".join((_ANSWERS, "asked AS (SELECT sub_id, titulo_canonico AS titulo, autor_canonico AS autor FROM answers WHERE confianza >= 0.80 AND confianza < 0.92)", "q4 AS (SELECT sub_id, trim(concat_ws(' ', titulo, autor)) AS query FROM asked)", _retrieve("q4", "r4"), _score("r4", "asked", "s4"),
    "c0 AS (SELECT sub_id, list(source ORDER BY ord) AS ls, arg_min(nullif(year, 0), ord) FILTER (WHERE nullif(year, 0) IS NOT NULL) AS confirmed_year FROM s4 WHERE sim_t >= 0.85 AND sim_a >= 0.75 GROUP BY sub_id)",
    "confirmed AS (SELECT sub_id, list_filter(ls, lambda s, i: list_position(ls, s) = i) AS confirming, confirmed_year FROM c0)"))
_NV = dk.normalize_verify
_LABELS = "string_agg(titulo || ' — ' || autor, '; ' ORDER BY rank)"
_DECIDE = f"""
weak AS (SELECT sub_id, {_LABELS} AS weak FROM (SELECT *, row_number() OVER (PARTITION BY sub_id ORDER BY rank) AS k FROM g2 WHERE sim_a >= 0.65) WHERE k <= 4 GROUP BY sub_id),
sample AS (SELECT sub_id, {_LABELS} AS sample FROM g2 WHERE rank <= 2 GROUP BY sub_id),
d0 AS (SELECT s.sub_id, s.titulo AS st, s.autor AS sa, g.titulo AS gt, g.autor AS ga, g.sources AS gs, g.sim_t, g.sim_a, g.sim_c, g.year AS gy, weak, sample, a.sub_id IS NOT NULL AS answered, coalesce(reconocido, false) AS rec, a.titulo_canonico AS lt, a.autor_canonico AS la, a.year AS ly, confianza, confirming, confirmed_year
  FROM submissions s LEFT JOIN (SELECT * FROM g2 WHERE rank = 1) g USING (sub_id) LEFT JOIN weak USING (sub_id) LEFT JOIN sample USING (sub_id) LEFT JOIN answers a USING (sub_id) LEFT JOIN confirmed USING (sub_id)),
d1 AS (SELECT *, CASE WHEN coalesce(sim_c >= 0.85, false) AND {_NV('st')} = {_NV('gt')} AND {_NV('sa')} = {_NV('ga')} THEN 'canonical' WHEN coalesce(sim_c >= 0.85 OR (sim_a >= 0.85 AND sim_c >= 0.75), false) THEN 'group'
  WHEN rec AND confianza >= 0.80 AND lt <> '' AND la <> '' THEN CASE WHEN {_NV('st')} = {_NV('lt')} AND {_NV('sa')} = {_NV('la')} THEN 'canonical_answer' ELSE 'answer' END WHEN weak IS NOT NULL THEN 'weak' ELSE 'none' END AS cs FROM d0),
d2 AS (SELECT sub_id, CASE WHEN cs IN ('group', 'answer') THEN 'strong_match' WHEN cs = 'weak' THEN 'weak_match' WHEN cs = 'none' THEN 'no_match' END AS tipo, cs IN ('canonical', 'canonical_answer') AS already_canonical,
  CASE WHEN cs IN ('group', 'canonical') THEN 'apis_only' WHEN cs = 'canonical_answer' THEN 'gpt' WHEN cs = 'answer' THEN CASE WHEN confirming IS NOT NULL THEN 'gpt+apis' ELSE 'gpt' END WHEN NOT answered THEN 'apis_only_no_gpt' WHEN cs = 'weak' THEN 'apis_fallback' END AS via,
  CASE WHEN cs = 'none' THEN CASE WHEN answered THEN 'no_strong_match_anywhere' ELSE 'apis_weak_no_gpt' END END AS reason,
  CASE cs WHEN 'group' THEN gt WHEN 'answer' THEN lt END AS titulo_canonico, CASE cs WHEN 'group' THEN ga WHEN 'answer' THEN la END AS autor_canonico, CASE cs WHEN 'group' THEN gy WHEN 'answer' THEN coalesce(nullif(ly, 0), confirmed_year) END AS year,
  CASE cs WHEN 'group' THEN {dk.percent('sim_t')} WHEN 'answer' THEN {dk.percent('confianza')} END AS sim_titulo, CASE cs WHEN 'group' THEN {dk.percent('sim_a')} WHEN 'answer' THEN {dk.percent('confianza')} END AS sim_autor,
  CASE cs WHEN 'group' THEN array_to_string(gs, ',') WHEN 'answer' THEN array_to_string(['gpt-4o-mini'] || coalesce(confirming, []), ',') END AS sources,
  CASE cs WHEN 'group' THEN CASE WHEN len(gs) >= 2 THEN 'high' ELSE 'medium' END WHEN 'answer' THEN CASE WHEN confirming IS NOT NULL OR confianza >= 0.9 THEN 'high' ELSE 'medium' END END AS confidence,
  CASE WHEN cs = 'weak' THEN weak WHEN cs = 'none' AND answered THEN sample END AS candidates FROM d1)"""
_SIMS = "round(sim_t, 6) AS sim_t, round(sim_a, 6) AS sim_a, round(sim_c, 6) AS sim_c"
_FROM_SOURCES = """WITH p AS (SELECT *, p_brand AS raw_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS ord FROM part),
c AS (SELECT raw_id, 'apple_books' AS source, ord, p_name AS titulo, p_type AS autor, CAST('19' || lpad(CAST(p_size + 10 AS VARCHAR), 2, '0') AS INTEGER) AS year FROM p WHERE p_size % 4 <> 0
UNION ALL SELECT raw_id, 'google_books', ord, p_name, p_type, CASE WHEN p_size % 2 = 0 THEN CAST('19' || lpad(CAST(p_size + 10 AS VARCHAR), 2, '0') AS INTEGER) END FROM p WHERE p_size % 4 <> 0 AND p_size % 3 <> 0
UNION ALL SELECT raw_id, 'openlibrary', ord, p_name, p_type, CAST(nullif(p_size % 5 * 400, 0) AS INTEGER) FROM p WHERE p_size % 4 <> 0) """

ORACLE_SQL = {
    "candidates_from_sources": _FROM_SOURCES + "SELECT * FROM c",
    "source_counts": _FROM_SOURCES + "SELECT source, count(*) AS n, count(DISTINCT raw_id) AS answers FROM c GROUP BY source",
    "candidate_retrieval": f"WITH {_BASE} SELECT * FROM r1",
    "verify_scores": f"WITH {_BASE} SELECT sub_id, ord, {_SIMS} FROM s1",
    "consensus_groups": f"WITH {_RANKED} SELECT sub_id, rank, titulo, autor, array_to_string(sources, ',') AS sources, {_SIMS}, year FROM g2",
    "llm_gate": f"WITH {i.CATALOG}, {i.SUBMISSIONS}, {_ANSWERS} SELECT a.*, reconocido AND confianza >= 0.80 AND titulo_canonico <> '' AND autor_canonico <> '' AS passes, 'Título: \"' || titulo || '\"' || chr(10) || 'Autor: \"' || autor || '\"' AS prompt FROM answers a JOIN submissions USING (sub_id)",
    "answer_confirmations": f"WITH {_EXT}, {_CONFIRM} SELECT sub_id, array_to_string(confirming, ',') AS sources, confirmed_year FROM confirmed",
    "resolve_decisions": f"WITH {_RANKED}, {_CONFIRM}, {_DECIDE} SELECT *, CASE WHEN already_canonical THEN 'accept' WHEN tipo = 'strong_match' THEN 'suggest' WHEN tipo = 'weak_match' THEN 'choose' WHEN tipo = 'no_match' THEN 'ask' ELSE 'accept' END AS outcome, CASE WHEN already_canonical THEN 'canonical form' WHEN tipo = 'strong_match' THEN 'suggestion' WHEN tipo = 'weak_match' THEN 'candidates' WHEN tipo = 'no_match' THEN 'not found' ELSE 'unknown' END AS hint FROM d2",
}
