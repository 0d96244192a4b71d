"""Queries of the text forms and set similarities (N1-N16, N18, VAL1-2, VAL9, SIM3-6, ST3-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from . import duck as dk
from . import inputs as i


def normalize_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("titulo")
    return i.titles(spark, sf_dir).select("doc_id", tx.normalize(c).alias("dedup"), tx.normalize_verify(c).alias("verify"), tx.normalize_search(c).alias("search"))


def title_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = i.titles(spark, sf_dir).select("doc_id", tx.normalize(F.col("titulo")).alias("n"), tx.normalize_verify(F.col("titulo")).alias("v"))
    return n.select("doc_id", tx.strip_article(F.col("n")).alias("no_article"), tx.strip_subtitle(F.col("n")).alias("no_subtitle"), tx.strip_subtitle_verify(F.col("v")).alias("verify_bare"), F.array_join(tx.title_variants(F.col("n")), "|").alias("variants"))


def author_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = i.titles(spark, sf_dir).select("doc_id", tx.normalize(F.col("autor")).alias("n"), tx.normalize(F.concat_ws(", ", "autor", "source")).alias("m"))
    tokens, flipped = tx.author_tokens(F.col("n")), tx.author_tokens(F.col("m"))
    return n.select("doc_id", F.array_join(tokens, "|").alias("tokens"), F.array_join(flipped, "|").alias("flipped"), sim.tokens_subset(tokens, flipped).alias("subset"))


def stem_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = i.titles(spark, sf_dir).select("doc_id", tx.normalize(F.col("titulo")).alias("n"))
    return n.select("doc_id", tx.stem_sentence(F.col("n")).alias("stems"))


def phonetic_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = i.titles(spark, sf_dir).select("doc_id", tx.author_tokens(tx.normalize(F.col("autor"))).alias("t"))
    return n.select("doc_id", tx.phonetic_sentence(F.col("t")).alias("code"))


def jaccard_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = i.titles(spark, sf_dir).select("doc_id", tx.normalize(F.col("titulo")).alias("n"))
    return n.select("doc_id", F.array_join(tx.jaccard_tokens(F.col("n")), "|").alias("tokens"), F.array_join(tx.search_tokens(F.col("n")), "|").alias("search"), F.array_join(tx.strong_tokens(F.col("n")), "|").alias("strong"))


def slugify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.page_titles(spark, sf_dir).select("page_id", tx.slugify(F.col("titulo")).alias("slug"), tx.escape_html(F.col("titulo")).alias("escaped"))


def sanitize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return i.table(spark, sf_dir, "documents").select("doc_id", tx.sanitize(text, 200).alias("title"), tx.sanitize(text, 500).alias("note"), tx.sanitize_old(text, 200).alias("old"), tx.sanitize_request(text, 200).alias("request"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue titles by pairs of distinct names, and their authors' sources."""
    names = i.catalog(spark, sf_dir).select("titulo").distinct()
    subs = i.submissions(spark, sf_dir).select("sub_id", F.col("titulo").alias("a"))
    return subs.crossJoin(names.select(F.col("titulo").alias("b"))).select("sub_id", tx.normalize(F.col("a")).alias("a"), tx.normalize(F.col("b")).alias("b"))


def token_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select("sub_id", "a", "b", F.round(sim.token_jaccard(tx.jaccard_tokens(F.col("a")), tx.jaccard_tokens(F.col("b"))), 6).alias("jaccard"), F.round(sim.token_jaccard(tx.search_tokens(F.col("a")), tx.search_tokens(F.col("b"))), 6).alias("plain"))


def bigram_dice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("sub_id", "a", "b", F.round(sim.bigram_dice(F.col("a"), F.col("b")), 6).alias("dice"))


def best_word_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select("sub_id", "a", "b", F.round(sim.best_word_pair(F.split("a", " "), F.split("b", " ")), 6).alias("pair"), F.round(sim.best_word_pair(F.split("b", " "), F.split("a", " ")), 6).alias("back"))


QUERIES = {f.__name__: f for f in (normalize_titles, title_variants, author_tokens, stem_titles, phonetic_authors, jaccard_tokens, slugify_pages, sanitize_documents, token_jaccard_pairs, bigram_dice_pairs, best_word_pair)}

_FORMS = f"n AS (SELECT doc_id, {dk.normalize('titulo')} AS n, {dk.normalize_verify('titulo')} AS v FROM titles), a AS (SELECT *, {dk.strip_article('n')} AS na FROM n), s AS (SELECT *, {dk.strip_subtitle('n')} AS ns, {dk.strip_subtitle('na')} AS nb FROM a)"
_PAIRS = f"pr AS (SELECT sub_id, {dk.normalize('s.titulo')} AS a, {dk.normalize('c.titulo')} AS b FROM submissions s, (SELECT DISTINCT titulo FROM catalog) c), bare AS (SELECT *, {dk.strip_article('a')} AS aa, {dk.strip_article('b')} AS ba FROM pr), bares AS (SELECT *, {dk.strip_subtitle('aa')} AS ab, {dk.strip_subtitle('ba')} AS bb FROM bare)"
_DROP = "".join(tx.DROPPED_QUOTES)
_PLAIN = tx.PLAIN_QUOTES + tx.PLAIN_DASHES + tx.PLAIN_SPACES
_TO = "'" * len(tx.PLAIN_QUOTES) + "-" * len(tx.PLAIN_DASHES) + " " * len(tx.PLAIN_SPACES)


def _sanitize_sql(n: int) -> str:
    clean = f"replace(regexp_replace(translate(nfc_normalize(coalesce(text, '')), {dk.quoted(_PLAIN + _DROP)}, {dk.quoted(_TO)}), '[\\x00-\\x1F\\x7F]', '', 'g'), ',', ' ')"
    return f"({dk.collapse(clean)})[1:{n}]"


def _old_sql() -> str:
    clean = "regexp_replace(coalesce(text, ''), '[,\\r\\n\\t]', ' ', 'g')"
    return f"({dk.collapse(clean)})[1:200]"


def _request_sql() -> str:
    clean = "regexp_replace(nfc_normalize(coalesce(text, '')), '[\\x00-\\x1F\\x7F]', '', 'g')"
    return f"({dk.collapse(clean)})[1:200]"


ORACLE_SQL = {
    "normalize_titles": f"WITH {i.TITLES} SELECT doc_id, {dk.normalize('titulo')} AS dedup, {dk.normalize_verify('titulo')} AS verify, {dk.normalize_search('titulo')} AS search FROM titles",
    "title_variants": f"WITH {i.TITLES}, {_FORMS} SELECT doc_id, na AS no_article, ns AS no_subtitle, {dk.strip_subtitle_verify('v')} AS verify_bare, array_to_string({dk.variants('n', 'na', 'ns', 'nb')}, '|') AS variants FROM s",
    "author_tokens": f"WITH {i.TITLES}, n AS (SELECT doc_id, {dk.normalize('autor')} AS n, {dk.normalize("concat_ws(', ', autor, source)")} AS m FROM titles), t AS (SELECT doc_id, {dk.author_tokens('n')} AS t, {dk.author_tokens('m')} AS f FROM n) SELECT doc_id, array_to_string(t, '|') AS tokens, array_to_string(f, '|') AS flipped, len(t) > 0 AND len(f) > 0 AND CASE WHEN len(t) <= len(f) THEN list_has_all(f, t) ELSE list_has_all(t, f) END AS subset FROM t",
    "stem_titles": f"WITH {i.TITLES}, n AS (SELECT doc_id, {dk.normalize('titulo')} AS n FROM titles) SELECT doc_id, {dk.stem_sentence('n')} AS stems FROM n",
    "phonetic_authors": f"WITH {i.TITLES}, n AS (SELECT doc_id, {dk.normalize('autor')} AS n FROM titles), t AS (SELECT doc_id, {dk.author_tokens('n')} AS t FROM n) SELECT doc_id, {dk.phonetic_sentence('t')} AS code FROM t",
    "jaccard_tokens": f"WITH {i.TITLES}, {_FORMS} SELECT doc_id, array_to_string({dk.jaccard_tokens('nb')}, '|') AS tokens, array_to_string({dk.search_tokens('nb')}, '|') AS search, array_to_string(list_filter({dk.search_tokens('nb')}, lambda w: length(w) >= 4 AND w NOT IN {dk.words_in(tx.GENERIC_WORDS)}), '|') AS strong FROM s",
    "slugify_pages": f"WITH {i.PAGE_TITLES} SELECT page_id, regexp_replace(regexp_replace({dk.normalize_search('titulo')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, replace(replace(replace(replace(replace(titulo, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM page_titles",
    "sanitize_documents": f"SELECT doc_id, {_sanitize_sql(200)} AS title, {_sanitize_sql(500)} AS note, {_old_sql()} AS old, {_request_sql()} AS request FROM documents",
    "token_jaccard_pairs": f"WITH {i.CATALOG}, {i.SUBMISSIONS}, {_PAIRS}, t AS (SELECT sub_id, a, b, {dk.jaccard_tokens('ab')} AS x, {dk.jaccard_tokens('bb')} AS y, {dk.search_tokens('ab')} AS u, {dk.search_tokens('bb')} AS w FROM bares) SELECT sub_id, a, b, round({dk.token_jaccard('x', 'y')}, 6) AS jaccard, round({dk.token_jaccard('u', 'w')}, 6) AS plain FROM t",
    "bigram_dice_pairs": f"WITH {i.CATALOG}, {i.SUBMISSIONS}, {_PAIRS} SELECT sub_id, a, b, round({dk.dice('a', 'b')}, 6) AS dice FROM pr",
    "best_word_pair": f"WITH {i.CATALOG}, {i.SUBMISSIONS}, {_PAIRS}, w AS (SELECT sub_id, a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM pr) SELECT sub_id, a, b, round({dk.word_pair('x', 'y')}, 6) AS pair, round({dk.word_pair('y', 'x')}, 6) AS back FROM w",
}
