"""Shaping of editions into phrases, posts and links (PRJ1-3, ST2, TK8-9, N19-N24)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx

SEE_MORE = 210
#: The main ranges of pictographs (by code point).
PICTOGRAPHS = r"[\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{23FF}\x{24C2}\x{25AA}-\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}]"


def clean_slug(slug: Column) -> Column:
    """PRJ2."""
    return F.regexp_replace(F.lower(tx.trim(slug)), "[^a-z0-9-]", "")


def image_kind(kind: Column) -> Column:
    return F.when(kind == "og", "og").otherwise("tarjeta")


def public_urls(slug: Column, base: str = "https://example.org") -> Column:
    """PRJ1: edition, card and preview addresses; null without a slug."""
    known = tx.trim(F.coalesce(slug, F.lit(""))) != ""
    root = F.concat(F.lit(f"{base}/t/"), tx.trim(slug), F.lit("/"))
    return F.when(known, F.struct(root.alias("edicion"), F.concat(root, F.lit("tarjeta.png")).alias("tarjeta"), F.concat(root, F.lit("og.png")).alias("og")))


def visible(phrases: Column) -> Column:
    """PRJ3: the strings with visible text; none for null."""
    return F.filter(F.coalesce(phrases, F.expr("cast(array() as array<string>)")), lambda x: F.length(tx.trim(x)) > 0)


def phrase_pool(frases: Column, frases_og: Column, parrafo: Column) -> Column:
    """ST2: array of (f, tag): phrases, preview phrases, paragraph, tagged and numbered from 1."""

    def tagged(phrases: Column, tag: str) -> Column:
        return F.transform(visible(phrases), lambda x, k: F.struct(x.alias("f"), F.concat(F.lit(tag), (k + 1).cast("string")).alias("tag")))

    last = F.when(F.coalesce(parrafo, F.lit("")) != "", F.array(F.struct(parrafo.alias("f"), F.lit("párrafo").alias("tag")))).otherwise(F.expr("cast(array() as array<struct<f: string, tag: string>>)"))
    return F.concat(tagged(frases, "frase "), tagged(frases_og, "og "), last)


def closing_phrase(pool: Column) -> Column:
    """TK8: the first phrase that asks something, else the last."""
    texts = F.transform(pool, lambda x: x.f)
    return F.coalesce(F.get(F.filter(texts, lambda x: x.rlike("[?¿]")), F.lit(0)), F.get(texts, F.size(texts) - 1))


def default_phrase(pool: Column) -> Column:
    """The first phrase."""
    return F.get(pool, F.lit(0)).f


def first_unused(pool: Column, used: Column) -> Column:
    """TK9: the first phrase that isn't in the post."""
    return F.get(F.filter(F.transform(pool, lambda x: x.f), lambda x: ~F.array_contains(F.array_compact(used), x)), F.lit(0))


def strip_emoji(text: Column) -> Column:
    """One leading pictograph goes, with its variation mark and blanks."""
    return tx.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{PICTOGRAPHS}\x{{FE0F}}?\s*", ""))


def post_text(hook: Column, phrase: Column, closing: Column, link: Column | None = None) -> Column:
    """The parts that there are, with a blank line between them, and the link at the end."""
    body = F.concat_ws("\n\n", strip_if(hook), strip_if(phrase), strip_if(closing))
    return body if link is None else F.concat(body, F.coalesce(F.concat(F.lit("\n\n"), link), F.lit("")))


def strip_if(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", strip_emoji(text))


def see_more(text: Column, limit: int = SEE_MORE) -> Column:
    """(visible, hidden, over). Cut at the last blank up to the limit, unless that is before
    three fifths of it."""
    head = F.left(text, F.lit(limit + 1))
    blank = F.instr(F.reverse(head), " ")
    at = F.when(blank > 0, F.length(head) - blank).otherwise(-1)
    cut = F.when(at < limit * 0.6, limit).otherwise(at).cast("int")
    over = F.length(text) > limit
    return F.struct(F.when(over, F.left(text, cut)).otherwise(text).alias("visible"), F.when(over, F.substring(text, cut + 1, F.length(text))).otherwise("").alias("hidden"), over.alias("over"))


def number_label(number: Column) -> Column:
    """N22."""
    return F.when(F.coalesce(number, F.lit(0)) != 0, F.format_string("#%03d · ", number.cast("long"))).otherwise("")


def link_parts(url: Column) -> Column:
    """(email, token) of a link's query string."""
    return F.struct(*(F.coalesce(F.try_url_decode(F.parse_url(url, F.lit("QUERY"), F.lit(key))), F.lit("")).alias(key) for key in ("email", "token")))
