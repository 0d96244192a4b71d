"""The given tables as catalogue, submissions and the rest, in Spark and in SQL (WITH parts)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{place}/{name}-{uuid.uuid4().hex}"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of documents: doc_id, titulo, autor (second and third word), source."""
    line = F.get(F.split("text", "\n"), 0)
    words = F.split(line, " ")
    return table(spark, sf_dir, "documents").select("doc_id", line.alias("titulo"), F.concat_ws(" ", F.get(words, 1), F.get(words, 2)).alias("autor"), "source")


TITLES = "titles AS (SELECT doc_id, string_split(text, chr(10))[1] AS titulo, concat_ws(' ', string_split(string_split(text, chr(10))[1], ' ')[2], string_split(string_split(text, chr(10))[1], ' ')[3]) AS autor, source FROM documents)"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a catalogue file: line_no (the header is line 1), titulo, autor."""
    part = table(spark, sf_dir, "part")
    return part.select((F.col("p_partkey") + 2).alias("line_no"), F.col("p_name").alias("titulo"), F.concat("p_brand", F.lit(" "), "p_type").alias("autor"))


CATALOG = "catalog AS (SELECT p_partkey + 2 AS line_no, p_name AS titulo, p_brand || ' ' || p_type AS autor FROM part)"


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One submission for each supplier: the part of its number, with an edit by its number."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "part"), F.col("s_suppkey") == F.col("p_partkey"))
    k, name = F.col("s_suppkey"), F.col("p_name")
    titulo = (
        F.when(k % 6 == 1, F.concat(F.left(name, F.lit(2)), F.substring(name, 4, 100)))
        .when(k % 6 == 2, F.concat(F.left(name, F.lit(1)), F.substring(name, 3, 1), F.substring(name, 2, 1), F.substring(name, 4, 100)))
        .when(k % 6 == 3, F.concat(F.lit("The "), name, F.lit("s")))
        .when(k % 6 == 4, F.concat(name, F.lit(": una guía")))
        .when(k % 6 == 5, F.concat(F.lit("Gran "), name, F.lit(" dos")))
        .otherwise(F.upper(name))
    )
    autor = F.when(k % 4 == 1, F.concat("p_type", F.lit(", "), "p_brand")).when(k % 4 == 2, F.col("p_brand")).when(k % 4 == 3, F.concat(F.left("p_type", F.lit(3)), F.lit("y & "), "p_brand")).otherwise(F.concat("p_brand", F.lit(" "), "p_type"))
    return rows.select(k.alias("sub_id"), titulo.alias("titulo"), autor.alias("autor"), F.col("s_name").alias("nota"), (k % 7 == 0).alias("confirm"))


SUBMISSIONS = """submissions AS (SELECT s_suppkey AS sub_id,
  CASE s_suppkey % 6 WHEN 1 THEN p_name[1:2] || p_name[4:] WHEN 2 THEN p_name[1:1] || p_name[3:3] || p_name[2:2] || p_name[4:]
    WHEN 3 THEN 'The ' || p_name || 's' WHEN 4 THEN p_name || ': una guía' WHEN 5 THEN 'Gran ' || p_name || ' dos' ELSE upper(p_name) END AS titulo,
  CASE s_suppkey % 4 WHEN 1 THEN p_type || ', ' || p_brand WHEN 2 THEN p_brand WHEN 3 THEN p_type[1:3] || 'y & ' || p_brand ELSE p_brand || ' ' || p_type END AS autor,
  s_name AS nota, s_suppkey % 7 = 0 AS confirm FROM supplier JOIN part ON s_suppkey = p_partkey)"""


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, titulo (the page's title element), host, url."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("titulo"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), "url")


PAGE_TITLES = "page_titles AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS titulo, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, url FROM pages)"
