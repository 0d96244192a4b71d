"""Answers of three catalogues and of a language model as tables (SRC4-6, SRC8, ST1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

APPLE = "array<struct<trackName: string, artistName: string, releaseDate: string>>"
GOOGLE = "array<struct<volumeInfo: struct<title: string, authors: array<string>, publishedDate: string>>>"
OPENLIBRARY = "array<struct<title: string, author_name: array<string>, first_publish_year: int>>"

#: The order in which candidates of the sources stand.
SOURCES = ("apple_books", "google_books", "openlibrary")


def _rows(raw: DataFrame, schema: str, source: str, titulo: str, autor: Column, year: Column) -> DataFrame:
    """raw(raw_id, content): JSON arrays, one row for each element with a title and an author."""
    items = raw.select("raw_id", F.posexplode(F.from_json("content", schema)).alias("ord", "r"))
    out = items.select("raw_id", F.lit(source).alias("source"), "ord", F.col(titulo).alias("titulo"), autor.alias("autor"), year.alias("year"))
    known = (F.coalesce("titulo", F.lit("")) != "") & (F.coalesce("autor", F.lit("")) != "")
    return out.filter(known).withColumn("titulo", tx.trim(F.col("titulo"))).withColumn("autor", tx.trim(F.col("autor")))


def apple(raw: DataFrame) -> DataFrame:
    return _rows(raw, APPLE, SOURCES[0], "r.trackName", F.col("r.artistName"), F.year(F.try_to_timestamp("r.releaseDate")))


def google(raw: DataFrame) -> DataFrame:
    year = F.col("r.volumeInfo.publishedDate").substr(1, 4).try_cast("int")
    return _rows(raw, GOOGLE, SOURCES[1], "r.volumeInfo.title", F.get("r.volumeInfo.authors", F.lit(0)), year)


def openlibrary(raw: DataFrame) -> DataFrame:
    return _rows(raw, OPENLIBRARY, SOURCES[2], "r.title", F.get("r.author_name", F.lit(0)), F.nullif(F.col("r.first_publish_year"), F.lit(0)))


def _kind(field: Column) -> Column:
    """BOOLEAN, STRING, VOID, a kind of number, OBJECT<...> or ARRAY<...>; null if there is no such field."""
    return F.schema_of_variant(field)


def _truthy(field: Column) -> Column:
    """What counts as true where any value may stand: all but false, null, zero and the empty text."""
    kind, text = _kind(field), F.try_variant_get(field, "$", "string")
    value = F.when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != "").when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(True))
    return F.coalesce(value.when(kind != "VOID", text.try_cast("double") != 0), F.lit(False))


def answers(raw: DataFrame) -> DataFrame:
    """raw(sub_id, content) to typed fields; what is missing or broken has its default. Any value that
    counts as true recognizes a book; a year or a confidence is one only as a number."""
    parsed = raw.select("sub_id", F.try_parse_json("content").alias("v"))

    def field(name: str) -> Column:
        return F.try_variant_get("v", f"$.{name}", "variant")

    def text(name: str) -> Column:
        return F.when(_truthy(field(name)), tx.trim(F.try_variant_get("v", f"$.{name}", "string"))).otherwise("").alias(name)

    def number(name: str, kind: str) -> Column:
        is_number = _kind(field(name)).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        return F.when(is_number, F.try_variant_get("v", f"$.{name}", kind))

    return parsed.select("sub_id", _truthy(field("reconocido")).alias("reconocido"), text("titulo_canonico"), text("autor_canonico"), number("year", "int").alias("year"), F.coalesce(number("confianza", "double"), F.lit(0.0)).alias("confianza"), text("razon"))
