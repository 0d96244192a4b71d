"""Operator 5, benchmark decontamination: which documents hold passages of benchmark items.

Method: a prefix-filtered set join with containment 1. A window (10 consecutive item words, or a
whole shorter item) is a set of shingles of up to 5 words. The shingles are ordered by rarity in
the corpus; with containment 1 the necessary prefix is one token, so each window is indexed by
its rarest shingle alone. A document shingle that meets it proposes one place (positional bound),
which must lie inside the document and be as long as the item's window (length bound); the words
there are then compared one by one.

Document shingles that are in no window are dropped inside the scan by a bit table of fixed size
(2**22 places). It saturates for large benchmarks, which costs rows and loses none. What is left
meets the index in an equi-join; nothing is broadcast by hint, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .common import cut, documents, id_in, id_out

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLACES = 1 << 22


def _shingles(data: np.ndarray, offsets: np.ndarray, sizes: list[int]):
    """Words of the rows, and for each size the starts, rows and hashes of their shingles."""
    start, end, first = S.words(data, offsets, S.ALNUM)
    sums = S.prefix_sums(S.run_hashes(S.prefix_sums(S.byte_values(3, True)[data]), start, end))
    found = []
    for size in sizes:
        at, row = S.windows(first, size)
        found.append((size, at, row, S.mix(S.run_hashes(sums, at, at + size) + np.uint64(size))))
    return start, end, first, found


def _index(shingle: int):
    """Window texts to their shingles."""
    schema = pa.schema([("h", pa.int64()), ("off", pa.int32()), ("len", pa.int32()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("words"))
            for rows, data, offsets in S.text_parts(batch, "words"):
                part = texts.slice(rows.start, rows.stop - rows.start)
                _, _, first, found = _shingles(data, offsets, list(range(1, shingle + 1)))
                length = np.diff(first)
                for size, at, row, h in found:
                    keep = np.minimum(length, shingle)[row] == size
                    at, row, h = at[keep], row[keep], h[keep]
                    yield S.batch_of(schema, S.signed(h), (at - first[row]).astype(np.int32), length[row].astype(np.int32), part.take(pa.array(row)))

    return run


def _places(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(PLACES - 1)).astype(np.int64)


def _table(frame: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The bit table of the hashes in h, and the shingle sizes. At most PLACES x few rows."""
    got = frame.select(F.col("h").bitwiseAND(F.lit(PLACES - 1)).alias("place"), F.least("len", F.lit(99)).alias("len")).distinct().toArrow()
    table = np.zeros(PLACES, dtype=bool)
    table[got["place"].to_numpy()] = True
    return np.packbits(table), sorted(set(got["len"].to_pylist()))


def _counts(bits: np.ndarray, sizes: list[int]):
    """How often each shingle of the table occurs in the batch."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(bits).astype(bool)
        for batch in batches:
            for _, data, offsets in S.text_parts(batch):
                for _, _, _, h in _shingles(data, offsets, sizes)[3]:
                    value, n = np.unique(h[table[_places(h)]], return_counts=True)
                    if len(value):
                        yield S.batch_of(schema, S.signed(value), n)

    return run


def _candidates(bits: np.ndarray, sizes: list[int], window: int):
    """A row with n_words for each document (h null), and one for each shingle of the table with
    the words that a window around it can hold."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("h", pa.int64()), ("pos", pa.int64()), ("from", pa.int64()), ("context", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(bits).astype(bool)
        for batch in batches:
            ids = S.ids_of(batch)
            for rows, data, offsets in S.text_parts(batch):
                start, end, first, found = _shingles(data, offsets, sizes)
                count = np.diff(first)
                none = pa.nulls(len(count), pa.int64())
                yield S.batch_of(schema, ids[rows], count, none, none, none, pa.nulls(len(count), pa.string()))
                for size, at, row, h in found:
                    keep = table[_places(h)]
                    at, row, h = at[keep], row[keep], h[keep]
                    low = np.maximum(at - (window - size), first[row])
                    high = np.minimum(at + window, first[row + 1])
                    for k in range(0, len(at), 20_000):
                        part = slice(k, k + 20_000)
                        context = [b" ".join(data[start[j] : end[j]].tobytes().lower() for j in range(a, b)).decode() for a, b in zip(low[part], high[part], strict=True)]
                        r = row[part]
                        yield S.batch_of(schema, ids[rows][r], count[r], S.signed(h[part]), at[part] - first[r], low[part] - first[r], context)

    return run


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), 0)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an item's window) and items (sorted ids, as strings,
    of the items with a window in the document) for every row of docs.

    Null and empty texts have no words, on either side; an item without words matches nothing, an
    item of fewer words than `window` is one window. A null item_id is left out of items. A null
    doc_id is kept; rows that repeat a doc_id are one document, whose hits count for each row.
    Other columns are ignored; an empty table on either side gives no hits."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text").cast("string")).alias("w")).filter("size(w) > 0")
    last = F.greatest(F.size("w") - window, F.lit(0))
    item_windows = item.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("k")).select("item_id", F.array_join(F.slice("w", F.col("k") + 1, window), " ").alias("words")).distinct()
    item_windows = cut(item_windows, "windows")
    shingles = cut(item_windows.select("words").distinct().mapInArrow(_index(shingle), "h long, off int, len int, words string"), "shingles")

    texts = docs.select(id_in(), F.col("text").cast("string").alias("text"))
    size = F.least("len", F.lit(shingle)).alias("len")
    bits, sizes = _table(shingles.select("h", size))
    counts = texts.select("text").mapInArrow(_counts(bits, sizes), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rarest = shingles.join(counts, "h", "left").groupBy("words", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "off")).alias("least"))
    index = cut(rarest.filter("least.n > 0").select("least.h", "least.off", "len", "words"), "index")

    bits, sizes = _table(index.select("h", size))
    scan = cut(texts.mapInArrow(_candidates(bits, sizes, window), "doc_id long, n_words long, h long, pos long, from long, context string"), "candidates")
    begin = F.col("pos") - F.col("off") - F.col("from")
    found = scan.filter("h is not null").join(index, "h").filter((begin >= 0) & (F.array_join(F.slice(F.split("context", " "), F.greatest(begin, F.lit(0)).cast("int") + 1, F.col("len")), " ") == F.col("words")))
    found = cut(found.select("doc_id", (F.col("pos") - F.col("off")).alias("begin"), "len", "words").distinct(), "found")
    hit = found.select("doc_id", "begin", "len").distinct().select("doc_id", F.explode(F.sequence("begin", F.col("begin") + F.col("len") - 1)).alias("pos")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    items = found.select("doc_id", "words").distinct().join(item_windows, "words").filter("item_id is not null").select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    out = scan.filter("h is null").select("doc_id", "n_words").join(hit, "doc_id", "left").join(items, "doc_id", "left")
    return out.select(id_out(), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS t
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS t
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
f AS (SELECT doc_id, n, k, t FROM dw WHERE (n, t) IN (SELECT n, t FROM iw)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM f) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT f.doc_id, iw.item_id FROM f JOIN iw USING (n, t)) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)
"""
