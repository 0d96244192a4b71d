"""Queries of sources, contents, requests and opt-outs (SRC1-3, SRC7, SRC9, PRJ1-3, ST2, TK7-9, N19-N24, VAL3-9, SS2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import content, requests
from ..sources import catalog as cat
from ..streaming import intake
from . import duck as dk
from . import inputs as i
from .search_queries import _escape


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of documents as lines of a file (line 1 would be the header), some with a tab
    before and a carriage return behind, some of a no-break space or a carriage return alone."""
    k, line = F.col("doc_id"), F.col("titulo")
    edited = F.when(k % 50 == 2, "\u00a0").when(k % 50 == 3, "\r").when(k % 5 == 1, F.concat(F.lit("\t"), line, F.lit("\u00a0\r"))).otherwise(line)
    return i.titles(spark, sf_dir).select((k + 2).alias("line_no"), edited.alias("line"))


def catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.catalog_rows(_lines(spark, sf_dir))


def csv_line_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.check_lines(_lines(spark, sf_dir))


def csv_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.first_failure(cat.check_lines(_lines(spark, sf_dir)))


def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as submissions, checked and written as lines."""
    subs = i.titles(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.when(F.col("doc_id") % 20 == 0, " ").otherwise("\u00a0\t")).otherwise(F.col("titulo")).alias("titulo"), F.when(F.col("doc_id") % 7 == 0, "“”").otherwise(F.col("autor")).alias("autor"), F.col("source").alias("nota"))
    checked = requests.required_fields(subs)
    return checked.select("doc_id", "reason", F.when(F.col("reason").isNull(), cat.csv_row(F.col("titulo"), F.col("autor"), F.col("nota"))).alias("line"))


def catalog_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of parts, the accepted suppliers' submissions appended in two batches, read back as one
    file: every line, what it holds, and what a strict reader says of it."""
    path = i.scratch(spark, "catalog")
    cat.start_catalog(spark, path)
    held = i.catalog(spark, sf_dir).select("line_no", "titulo", F.when(F.col("line_no") % 40 != 0, F.col("autor")).otherwise("").alias("autor"), F.when(F.col("line_no") % 50 == 0, "a,b").alias("nota"))
    cat.append_rows(held, path, 1, "line_no")
    subs = i.submissions(spark, sf_dir).withColumn("titulo", F.when(F.col("sub_id") % 10 == 0, "\u00a0\t").otherwise(F.col("titulo")))
    accepted = requests.required_fields(subs).filter("reason is null")
    for batch in (2, 3):
        cat.append_rows(accepted.filter(F.col("sub_id") % 2 == batch % 2), path, batch, "sub_id")
    cat.append_rows(accepted.filter("sub_id % 2 = 1"), path, 3, "sub_id")  # a batch that runs again
    lines = cat.read_catalog(spark, path)
    return cat.catalog_rows(lines).join(cat.check_lines(lines), "line_no", "left")


def payload_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    coded = cat.encode_payload(text)
    wrapped = F.concat(F.left(coded, F.lit(60)), F.lit("\n "), F.substring(coded, 61, 2**31 - 1))
    return i.table(spark, sf_dir, "documents").select("doc_id", coded.alias("payload"), (cat.decode_payload(wrapped) == text).alias("same"))


def _editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as editions documents: a turn is an edition, its sentences are phrases."""
    c = i.table(spark, sf_dir, "conversations").withColumn("s", F.split("text", r"\. "))
    item = F.to_json(F.struct(
        F.when(F.col("turn") % 5 != 3, F.concat(F.lit(" "), F.left("text", F.lit(20)))).alias("titulo"), F.col("role").alias("autor"), F.concat_ws("-", "role", "turn").alias("_slug"),
        F.concat(F.slice("s", 1, 3), F.array(F.lit("  "))).alias("frases"), F.slice("s", 2, 2).alias("frases_og"), F.struct(F.left(F.col("s")[0], F.lit(40)).alias("parrafoTop")).alias("tarjeta"),
    ))
    number = F.when(F.col("turn") % 3 == 2, F.concat(F.lit('"'), F.col("turn").cast("string"), F.lit('"'))).otherwise(F.col("turn").cast("string"))
    c = c.select("conv_id", "turn", F.concat(F.left(item, F.length(item) - 1), F.lit(',"_edicion_numero":'), number, F.lit("}")).alias("item"))
    listed = F.array_sort(F.collect_list(F.struct("turn", "item")))
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.concat(F.lit('{"libros":['), F.array_join(F.transform(listed, lambda x: x["item"]), ","), F.lit("]}")).alias("content"))


def editions_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = cat.flat_editions(cat.editions(_editions(spark, sf_dir)))
    return flat.select("doc_id", "pos", "titulo", "autor", "num", content.number_label(F.col("num")).alias("label"))


def editions_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _editions(spark, sf_dir)
    return cat.edition_totals(documents, cat.editions(documents))


def phrase_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of the newest edition of each document, one row for each phrase."""
    newest = cat.latest(cat.editions(_editions(spark, sf_dir)))
    pool = newest.select("doc_id", F.posexplode(content.phrase_pool(F.col("frases"), F.col("frases_og"), F.col("parrafo"))).alias("pos", "x"))
    return pool.select("doc_id", "pos", "x.tag", F.col("x.f").alias("phrase"))


def phrase_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default, closing and next phrase of the newest edition, its post and its links."""
    newest = cat.latest(cat.editions(_editions(spark, sf_dir)))
    p = newest.withColumn("pool", content.phrase_pool(F.col("frases"), F.col("frases_og"), F.col("parrafo")))
    p = p.select("doc_id", "slug", "pool", content.default_phrase(F.col("pool")).alias("first"), content.closing_phrase(F.col("pool")).alias("closing"))
    urls = content.public_urls(F.col("slug"))
    return p.select("doc_id", "first", "closing", content.first_unused(F.col("pool"), F.array("first", "closing")).alias("unused"), content.post_text(F.lit(None).cast("string"), F.col("first"), F.col("closing"), urls.edicion).alias("post"), urls.og.alias("og"))


def see_more_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = content.see_more(F.col("text"))
    return i.table(spark, sf_dir, "conversations").select("conv_id", "turn", parts["visible"].alias("visible"), F.length(parts["hidden"]).cast("long").alias("n_hidden"), parts["over"].alias("over"))


def strip_emoji(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.get(F.array(F.lit("✨ "), F.lit("⭐️  "), F.lit("🌙"), F.lit("")), (F.col("doc_id") % 4).cast("int")), F.coalesce("titulo", F.lit("")))
    return i.titles(spark, sf_dir).select("doc_id", content.strip_emoji(text).alias("plain"))


def image_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = i.page_titles(spark, sf_dir)
    slug = content.clean_slug(F.concat(F.lit(" "), F.col("host"), F.lit("_Aé")))
    kind = content.image_kind(F.when(F.col("page_id") % 2 == 0, "og").otherwise("x"))
    return pages.select("page_id", slug.alias("slug"), kind.alias("kind"), tx.escape_html(F.col("url")).alias("url"))


def optout_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://example.org/u?token=t"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("&email=u"), F.col("user_id").cast("string"), F.lit("%40example.org%20"))))
    parts = content.link_parts(url)
    return i.table(spark, sf_dir, "events").select("event_id", parts.email.alias("email"), parts.token.alias("token"))


def confirmed_optouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = i.table(spark, sf_dir, "events")
    actions = events.select("ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("email"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("token"), F.when(F.col("event_type") == "signup", "confirm").otherwise("stay").alias("action"))
    return intake.optouts_batch(actions).select("email", "token")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests, their options by event number."""
    k = F.col("event_id")

    def of(values: tuple, n: int, div: int = 1):
        return F.get(F.array(*(F.lit(v) for v in values)), (F.floor(k / div) % n).cast("int"))

    modes = (*requests.MODES, None, "otro")
    columns = {
        "modo": of(modes, len(modes)), "catalogo": of(("adulto", "kids", None, "otros"), 40, 3), "batch_size": of((" 20", "7x", "0", "abc", "200", None), 6, 2),
        "libro_input": of(("Título\t | Autor", "sin barra", None, "  "), 4, 6), "sentimiento": of((None, "calma \u0007 total"), 2, 5), "lente": of((None, "", "x"), 3), "nota_libro": of((None, "n"), 2),
        "punto_ciclo": of(("auto", "2 — Activo (flow)", None), 3, 4), "pilar": of(("auto", "mente", "otro", None), 9, 7), "hawkins_target": of((None, "paz (600)"), 2, 3),
    }
    columns |= {c: of(("true", "false", "on", "1", "x", None), 6, 1 + n) for n, c in enumerate(requests.FLAGS)}
    return i.table(spark, sf_dir, "events").select(k.alias("request_id"), *(v.cast("string").alias(c) for c, v in columns.items()))


def request_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests.request_delta(_requests(spark, sf_dir))
    entries = F.array_sort(F.transform(F.map_entries("inputs"), lambda e: F.concat(e.key, F.lit("="), e.value)))
    return r.select("request_id", "error", F.array_join(entries, "; ").alias("inputs"))


QUERIES = {f.__name__: f for f in (catalog_lines, catalog_append, csv_line_check, csv_first_failure, required_fields, payload_codec, editions_flat, editions_total, phrase_pool, phrase_choice, see_more_split, strip_emoji, image_slugs, optout_links, confirmed_optouts, request_delta)}

_LINES = f"""{i.TITLES}, ln AS (SELECT doc_id + 2 AS line_no,
  CASE WHEN doc_id % 50 = 2 THEN chr(160) WHEN doc_id % 50 = 3 THEN chr(13) WHEN doc_id % 5 = 1 THEN chr(9) || titulo || chr(160) || chr(13) ELSE titulo END AS line FROM titles)"""
_FAILS = f"{_LINES}, f AS (SELECT line_no, CASE WHEN length(line) - length(replace(line, ',', '')) <> 3 THEN 'expected 3 commas, got ' || (length(line) - length(replace(line, ',', ''))) WHEN instr(line, '\"') > 0 THEN 'unescaped double quote' END AS reason FROM ln WHERE {dk.trim('line')} <> '')"
_SAN = "replace(regexp_replace(translate(nfc_normalize(coalesce({}, '')), " + dk.quoted(tx.PLAIN_QUOTES + tx.PLAIN_DASHES + tx.PLAIN_SPACES + tx.DROPPED_QUOTES) + ", " + dk.quoted("'" * len(tx.PLAIN_QUOTES) + "-" * len(tx.PLAIN_DASHES) + " " * len(tx.PLAIN_SPACES)) + "), '[\\x00-\\x1F\\x7F]', '', 'g'), ',', ' ')"
_ED = f"""ed AS (SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, turn, role, text, string_split(text, '. ') AS s FROM conversations),
e AS (SELECT *, CASE WHEN turn % 5 <> 3 THEN {dk.trim("' ' || text[1:20]")} ELSE '' END AS titulo, {dk.trim('role')} AS autor, CASE WHEN turn % 3 <> 2 THEN turn::DOUBLE END AS num, role || '-' || turn AS slug,
  list_filter(s[1:3], lambda x: {dk.trim('x')} <> '') AS fr, list_filter(s[2:3], lambda x: {dk.trim('x')} <> '') AS og, {dk.trim('s[1][1:40]')} AS pa FROM ed),
pool AS (SELECT doc_id, slug, list_transform(fr, lambda x, k: {{'f': x, 'tag': 'frase ' || k}}) || list_transform(og, lambda x, k: {{'f': x, 'tag': 'og ' || k}}) || (CASE WHEN pa <> '' THEN [{{'f': pa, 'tag': 'párrafo'}}] ELSE [] END) AS p FROM e WHERE pos = 0)"""
_PICT = content.PICTOGRAPHS
_STRIP = dk.trim(f"regexp_replace(%s, '^{_PICT}\\x{{FE0F}}?\\s*', '')")


def _of(values: tuple, n: int, div: int = 1) -> str:
    listed = ", ".join("NULL" if v is None else dk.quoted(v) for v in values)
    return f"([{listed}]::VARCHAR[])[CAST(floor(event_id / {div}) AS BIGINT) % {n} + 1]"


def _request_sql() -> str:
    modes = (*requests.MODES, None, "otro")
    columns = {
        "modo": _of(modes, len(modes)), "catalogo": _of(("adulto", "kids", None, "otros"), 40, 3), "batch_size": _of((" 20", "7x", "0", "abc", "200", None), 6, 2), "libro_input": _of(("Título\t | Autor", "sin barra", None, "  "), 4, 6),
        "sentimiento": _of((None, "calma \u0007 total"), 2, 5), "lente": _of((None, "", "x"), 3), "nota_libro": _of((None, "n"), 2), "punto_ciclo": _of(("auto", "2 — Activo (flow)", None), 3, 4), "pilar": _of(("auto", "mente", "otro", None), 9, 7), "hawkins_target": _of((None, "paz (600)"), 2, 3),
    }
    columns |= {c: _of(("true", "false", "on", "1", "x", None), 6, 1 + n) for n, c in enumerate(requests.FLAGS)}
    raw = ", ".join(f"{v} AS {c}" for c, v in columns.items())

    def clean(c: str) -> str:
        x = dk.collapse(f"regexp_replace(nfc_normalize(coalesce({c}, '')), '[\\x00-\\x1F\\x7F]', '', 'g')")
        return f"({x})[1:{requests.LONGEST[c]}]" if c in requests.LONGEST else x

    cleaned = ", ".join(f"{clean(c)} AS {c}" for c in requests.TEXTS)
    gate = {"batch_size": "batch", "libro_input": "book"}
    sent = ", ".join(f"CASE WHEN {gate.get(c, 'true')} AND {c} <> '' AND {c} <> {dk.quoted(d)} THEN {c} END AS {c}" for c, d in requests.TEXTS.items())
    flags = ", ".join(f"CASE WHEN {c} IS NOT NULL AND ({c} IN ('true', '1', 'on')) <> {str(d).lower()} THEN CAST({c} IN ('true', '1', 'on') AS VARCHAR) END AS {c}" for c, d in requests.FLAGS.items())
    choices = " ".join(f"WHEN {c} IS NOT NULL AND {c} NOT IN {dk.words_in(v)} THEN 'choice: {c}'" for c, v in requests.CHOICES.items())
    names = sorted(["modo", *requests.TEXTS, *requests.FLAGS])
    pairs = ", ".join(f"'{c}=' || {c}" for c in names)
    return f"""WITH r0 AS (SELECT event_id AS request_id, {raw} FROM events),
r1 AS (SELECT request_id, CASE WHEN coalesce(modo, '') = '' THEN {dk.quoted(requests.ONE_BOOK)} ELSE modo END AS modo, {cleaned}, {', '.join(requests.FLAGS)} FROM r0),
r2 AS (SELECT *, modo IN {dk.words_in((requests.ONE_BOOK, requests.REBUILD))} AS book, modo IN {dk.words_in(requests.BATCHES)} AS batch FROM r1),
r3 AS (SELECT request_id, modo, book, libro_input AS text_, {sent}, {flags} FROM r2),
r4 AS (SELECT *, TRY_CAST(regexp_extract(coalesce(batch_size, ''), '^\\s*([+-]?[0-9]+)', 1) AS INTEGER) AS num FROM r3),
r5 AS (SELECT * REPLACE (coalesce(CAST(num AS VARCHAR), batch_size) AS batch_size), CASE WHEN modo NOT IN {dk.words_in(requests.MODES)} THEN 'mode' WHEN book AND text_ = '' THEN 'book missing' WHEN book AND instr(text_, '|') = 0 THEN 'book without a bar' {choices} WHEN batch_size IS NOT NULL AND NOT coalesce(num BETWEEN 1 AND 200, false) THEN 'batch size' END AS error FROM r4),
r6 AS (SELECT request_id, error, list_sort(list_filter([{pairs}], lambda x: x IS NOT NULL)) AS ins FROM r5),
r7 AS (SELECT request_id, coalesce(error, CASE WHEN len(ins) > 10 THEN 'too many options' END) AS error, ins FROM r6)
SELECT request_id, error, CASE WHEN error IS NULL THEN array_to_string(ins, '; ') END AS inputs FROM r7"""


ORACLE_SQL = {
    "catalog_lines": f"WITH {_LINES}, p AS (SELECT line_no, {dk.trim("string_split(line, ',')[1]")} AS titulo, {dk.trim("coalesce(string_split(line, ',')[2], '')")} AS autor FROM ln WHERE {dk.trim('line')} <> '') SELECT *, titulo <> '' AND autor <> '' AS compared FROM p",
    "catalog_append": f"""WITH {i.CATALOG}, {i.SUBMISSIONS},
h AS (SELECT row_number() OVER (ORDER BY line_no) AS k, titulo, CASE WHEN line_no % 40 <> 0 THEN autor ELSE '' END AS autor, CASE WHEN line_no % 50 = 0 THEN 1 ELSE 0 END AS extra FROM catalog),
s AS (SELECT sub_id, ({dk.collapse(_SAN.format('titulo'))})[1:200] AS titulo, ({dk.collapse(_SAN.format('autor'))})[1:200] AS autor FROM submissions WHERE sub_id % 10 <> 0),
a AS (SELECT row_number() OVER (ORDER BY sub_id % 2, sub_id) + (SELECT count(*) FROM h) AS k, titulo, autor, 0 AS extra FROM s),
l AS (SELECT k + 1 AS line_no, titulo, autor, extra FROM h UNION ALL SELECT k + 1, titulo, autor, extra FROM a)
SELECT line_no, titulo, autor, autor <> '' AS compared, CASE WHEN extra = 1 THEN 'expected 3 commas, got 4' END AS reason FROM l""",
    "csv_line_check": f"WITH {_FAILS} SELECT * FROM f WHERE reason IS NOT NULL",
    "csv_first_failure": f"WITH {_FAILS} SELECT min(line_no) AS line_no, arg_min(reason, line_no) AS reason, count(*) AS n_failures FROM f WHERE reason IS NOT NULL",
    "required_fields": f"WITH {i.TITLES}, s AS (SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN ' ' WHEN doc_id % 10 = 0 THEN chr(160) || chr(9) ELSE titulo END AS t, CASE WHEN doc_id % 7 = 0 THEN '“”' ELSE autor END AS a, source FROM titles), c AS (SELECT doc_id, {dk.trim('t')} = '' OR {dk.trim('a')} = '' AS blank, ({dk.collapse(_SAN.format('t'))})[1:200] AS t, ({dk.collapse(_SAN.format('a'))})[1:200] AS a, ({dk.collapse(_SAN.format('source'))})[1:500] AS n FROM s), r AS (SELECT *, CASE WHEN blank THEN 'required' WHEN t = '' OR a = '' THEN 'empty after cleaning' END AS reason FROM c) SELECT doc_id, reason, CASE WHEN reason IS NULL THEN t || ',' || a || ',,' || n END AS line FROM r",
    "payload_codec": "SELECT doc_id, to_base64(encode(text)) AS payload, true AS same FROM documents",
    "editions_flat": f"WITH {_ED} SELECT doc_id, pos, titulo, autor, num, CASE WHEN coalesce(num, 0) <> 0 THEN printf('#%03d · ', num::BIGINT) ELSE '' END AS label FROM e WHERE turn % 5 <> 3",
    "editions_total": f"WITH {_ED} SELECT doc_id, count(*) FILTER (WHERE turn % 5 <> 3) AS total FROM e GROUP BY doc_id",
    "phrase_pool": f"WITH {_ED}, u AS (SELECT doc_id, unnest(p) AS x, CAST(unnest(range(0, len(p))) AS INTEGER) AS pos FROM pool) SELECT doc_id, pos, x.tag AS tag, x.f AS phrase FROM u",
    "phrase_choice": f"WITH {_ED}, c AS (SELECT doc_id, slug, p, p[1].f AS first, coalesce(list_filter(p, lambda x: regexp_matches(x.f, '[?¿]'))[1].f, p[-1].f) AS closing FROM pool) SELECT doc_id, first, closing, list_filter(p, lambda x: x.f <> first AND x.f <> closing)[1].f AS unused, concat_ws(chr(10) || chr(10), {_STRIP % 'first'}, {_STRIP % 'closing'}) || chr(10) || chr(10) || 'https://example.org/t/' || slug || '/' AS post, 'https://example.org/t/' || slug || '/og.png' AS og FROM c",
    "see_more_split": "WITH h AS (SELECT conv_id, turn, text, instr(reverse(text[1:211]), ' ') AS b, length(text[1:211]) AS n FROM conversations), c AS (SELECT *, CASE WHEN b > 0 THEN n - b ELSE -1 END AS k FROM h), d AS (SELECT *, CASE WHEN k < 126 THEN 210 ELSE k END AS cut FROM c) SELECT conv_id, turn, CASE WHEN length(text) > 210 THEN text[1:cut] ELSE text END AS visible, CASE WHEN length(text) > 210 THEN length(text) - cut ELSE 0 END AS n_hidden, length(text) > 210 AS over FROM d",
    "strip_emoji": f"WITH {i.TITLES}, t AS (SELECT doc_id, (['✨ ', '⭐️  ', '🌙', ''])[doc_id % 4 + 1] || coalesce(titulo, '') AS x FROM titles) SELECT doc_id, {_STRIP % 'x'} AS plain FROM t",
    "image_slugs": f"WITH {i.PAGE_TITLES} SELECT page_id, regexp_replace(lower(trim(' ' || host || '_Aé')), '[^a-z0-9-]', '', 'g') AS slug, CASE WHEN page_id % 2 = 0 THEN 'og' ELSE 'tarjeta' END AS kind, {_escape('url')} AS url FROM page_titles",
    "optout_links": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'u' || user_id || '@example.org ' END AS email, 't' || event_id AS token FROM events",
    "confirmed_optouts": "SELECT 'u' || user_id AS email, arg_min('t' || event_id, ts) AS token FROM events WHERE event_type = 'signup' GROUP BY user_id",
    "request_delta": _request_sql(),
}
