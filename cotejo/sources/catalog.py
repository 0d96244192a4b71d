"""The catalogue as an unquoted CSV file and the editions documents (SRC1-3, SRC7, SRC9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

COLUMNS = ("titulo", "autor", "portada", "tagline")
#: Folders of appended rows are named BATCH=n.
BATCH = "append"


def _numbered(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines of all text files of a folder with file, start (the byte of their split) and seq, which grows
    inside a split; and for each split its lines, the last that isn't blank, and its first seq. Files are
    read in splits: a line's number is the lines of the splits before it and its place in its own. Splits
    are counted in a pass of their own, a row for each, so no task sees a whole file."""
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("bytes"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    full = tx.trim(F.col("line")) != ""
    counts = raw.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max(F.when(full, F.col("seq"))).alias("last"), F.sum(F.octet_length("line") + 1).alias("read"), F.max("bytes").alias("bytes"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return raw, counts.withColumn("before", F.coalesce(before, F.lit(0)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), line of text files, each split at its line feeds; a file that ends in one
    has an empty last line."""
    raw, splits = _numbered(spark, path)
    lines = raw.join(splits.select("file", "start", "first", "before"), ["file", "start"])
    lines = lines.select("file", (F.col("before") + F.col("seq") - F.col("first") + 1).alias("line_no"), "line")
    ends = splits.groupBy("file").agg(F.sum("n").alias("n"), F.sum("read").alias("read"), F.max("bytes").alias("bytes")).filter("read = bytes")
    return lines.union(ends.select("file", (F.col("n") + 1).alias("line_no"), F.lit("").alias("line")))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: line_no and line of a catalogue's folder as one file: the files that append_rows didn't write, by
    name, then its batches. Only the first line is a header. Blank lines at the end of a file go, as where
    one appends to it, so numbers run on without a gap."""
    raw, splits = _numbered(spark, path)
    batch = F.coalesce(F.regexp_extract("file", f"/{BATCH}=([0-9]+)/", 1).try_cast("long"), F.lit(-1))
    held = splits.groupBy("file").agg(F.max(F.when(F.col("last").isNotNull(), F.col("before") + F.col("last") - F.col("first") + 1)).alias("held")).na.fill(0)
    # A row for each file.
    base = F.sum("held").over(Window.orderBy(batch, "file").rowsBetween(Window.unboundedPreceding, -1))
    files = held.withColumn("base", F.coalesce(base, F.lit(0)))
    places = splits.join(files, "file").select("file", "start", "held", "base", (F.col("before") - F.col("first") + 1).alias("shift"))
    lines = raw.join(places, ["file", "start"]).withColumn("at", F.col("seq") + F.col("shift")).filter("at <= held")
    return lines.select((F.col("at") + F.col("base")).alias("line_no"), "line")


def catalog_rows(lines: DataFrame) -> DataFrame:
    """SRC1: lines(line_no, line), as of read_catalog, to line_no, titulo, autor and compared. The header and blank lines
    go; rows without a title and an author count, and aren't compared."""
    parts = F.split("line", ",")
    rows = lines.filter((F.col("line_no") > 1) & (tx.trim(F.col("line")) != ""))
    rows = rows.select("line_no", tx.trim(F.get(parts, 0)).alias("titulo"), tx.trim(F.coalesce(F.get(parts, 1), F.lit(""))).alias("autor"))
    return rows.withColumn("compared", (F.col("titulo") != "") & (F.col("autor") != ""))


def csv_row(titulo: Column, autor: Column, nota: Column) -> Column:
    """SRC2: one line of the file, from sanitized fields."""
    return F.concat_ws(",", titulo, autor, F.lit(""), F.coalesce(nota, F.lit("")))


def start_catalog(spark: SparkSession, path: str, columns: tuple[str, ...] = COLUMNS) -> None:
    """An empty catalogue: its header alone."""
    spark.range(1).select(F.lit(",".join(columns)).alias("value")).write.mode("errorifexists").text(f"{path}/{BATCH}=0000000000")


def append_rows(rows: DataFrame, path: str, batch: int, order: str) -> None:
    """SRC2: rows(titulo, autor, nota) as lines at the end of a catalogue's folder, by the column `order`.
    A batch (from 1, in the order of their numbers) is one commit; writing it again replaces it."""
    lines = rows.orderBy(order).select(csv_row(F.col("titulo"), F.col("autor"), F.col("nota")).alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\n").text(f"{path}/{BATCH}={batch:010d}")


def check_lines(lines: DataFrame, columns: int = len(COLUMNS)) -> DataFrame:
    """SRC3: line_no and reason of the lines that a strict reader refuses, and their file if lines have one.
    The header, line 1 of a file, says how many commas a line has; without one it is for `columns`. A file
    without a line feed, which is one line, is too short: that is said of its first line."""
    key = ["file"] if "file" in lines.columns else []
    commas = F.regexp_count("line", F.lit(","))
    rows = lines.select(*(key or [F.lit("").alias("file")]), "line_no", "line", commas.alias("commas"))
    head = rows.groupBy("file").agg(F.max(F.when(F.col("line_no") == 1, F.col("commas"))).alias("header"), F.count("*").alias("n_lines"), F.min("line_no").alias("first"))
    rows = rows.join(head, "file")
    width = F.coalesce("header", F.lit(columns - 1))
    reason = F.when(F.col("commas") != width, F.format_string("expected %d commas, got %d", width, F.col("commas"))).when(F.instr("line", '"') > 0, "unescaped double quote")
    reason = F.when((F.col("n_lines") < 2) & (F.col("line_no") == F.col("first")), "file too short").when((F.col("line_no") > 1) & (tx.trim(F.col("line")) != ""), reason)
    return rows.select(*key, "line_no", reason.alias("reason")).filter("reason is not null")


def first_failure(failures: DataFrame) -> DataFrame:
    """The first refused line, and how many there are."""
    return failures.agg(F.min("line_no").alias("line_no"), F.min_by("reason", "line_no").alias("reason"), F.count("*").alias("n_failures"))


def decode_payload(content: Column) -> Column:
    """SRC9: base64 with line breaks to text."""
    return F.decode(F.unbase64(F.regexp_replace(content, r"\s", "")), "UTF-8")


def encode_payload(text: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", "")


EDITIONS = "struct<libros: array<struct<titulo: string, autor: string, _edicion_numero: string, _slug: string, frases: array<string>, frases_og: array<string>, tarjeta: struct<parrafoTop: string>>>>"


def editions(documents: DataFrame) -> DataFrame:
    """documents(doc_id, content) of JSON to doc_id, pos and the fields of each edition. A number is
    kept only where the JSON has a bare number."""
    parsed = documents.select("doc_id", F.from_json("content", EDITIONS).alias("d"), F.try_parse_json("content").alias("v"))
    rows = parsed.select("doc_id", "v", F.posexplode("d.libros").alias("pos", "b"))
    kind = F.schema_of_variant(F.try_variant_get("v", F.concat(F.lit("$.libros["), F.col("pos").cast("string"), F.lit("]._edicion_numero")), "variant"))
    number = F.when(kind.isin("BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.col("b._edicion_numero").try_cast("double"))
    listed = (F.coalesce("b.titulo", F.lit("")) != "") & (F.coalesce("b.autor", F.lit("")) != "")
    return rows.select("doc_id", "pos", listed.alias("listed"), tx.trim(F.coalesce("b.titulo", F.lit(""))).alias("titulo"), tx.trim(F.coalesce("b.autor", F.lit(""))).alias("autor"), number.alias("num"), F.col("b._slug").alias("slug"), "b.frases", "b.frases_og", tx.trim(F.coalesce("b.tarjeta.parrafoTop", F.lit(""))).alias("parrafo"))


def flat_editions(editions_: DataFrame) -> DataFrame:
    """SRC7: the editions with a title and an author; one of blanks counts, and is empty then."""
    return editions_.filter("listed").select("doc_id", "pos", "titulo", "autor", "num")


def edition_totals(documents: DataFrame, editions_: DataFrame) -> DataFrame:
    """AG7: the number of listed editions of every document, 0 where there is none."""
    counts = flat_editions(editions_).groupBy("doc_id").agg(F.count("*").alias("total"))
    return documents.select("doc_id").distinct().join(counts, "doc_id", "left").select("doc_id", F.coalesce("total", F.lit(0)).alias("total"))


def latest(editions_: DataFrame) -> DataFrame:
    """TK7: the newest edition of each document stands first."""
    return editions_.filter("pos = 0")
