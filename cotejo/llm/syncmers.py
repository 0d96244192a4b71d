"""Operator 2, document fingerprints from closed syncmers.

A k-mer is K consecutive words. It is a closed syncmer if the least of its inner substrings of S
words (by hash) stands at its first or last place: a property of the k-mer alone, so that equal
passages have equal anchors wherever they stand, and of any K - S + 1 k-mers in a row at least
one is chosen. The fingerprint is the bottom sketch of the anchors' hashes; the likeness of two
is the share of the union's least hashes that both hold.

All of it is array functions. Each text and each edited text is sketched once; the only text that
moves is each document once by its id, and the head of each next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, documents, id_in, id_out, let as _let

K, INNER, SKETCH = 4, 2, 64


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def anchors(hashes: Column, k: int = K, inner: int = INNER) -> Column:
    """Array of (pos, hash): the closed syncmers of an array of word hashes. A text of few words,
    but not none, that has no syncmer has one anchor of all of them."""
    w = k - inner + 1

    def of(h: Column) -> Column:
        inners = F.transform(F.sequence(F.lit(0), F.size(h) - inner), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(inner))))

        def chosen(m: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.least(F.get(m, i), F.get(m, i + w - 1)) <= F.least(*(F.get(m, i + j) for j in range(1, w))))
            return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(*(F.get(h, i + j) for j in range(k))).alias("hash")))

        # of a few k-mers none may be chosen
        few = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(h).alias("hash")))
        none = F.expr("cast(array() as array<struct<pos: int, hash: bigint>>)")
        def some(m: Column) -> Column:
            return _let(chosen(m), lambda x: F.when(F.size(x) > 0, x).otherwise(few))

        return F.when(F.size(h) >= k, _let(inners, some)).when(F.size(h) > 0, few).otherwise(none)

    return _let(hashes, of)


def sketch(text: Column, size: int = SKETCH) -> Column:
    """The least distinct anchor hashes, sorted."""
    return F.slice(F.sort_array(F.array_distinct(anchors(word_hashes(text)).getField("hash"))), 1, size)


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Estimated share of common anchors, 0 to 1; two empty sketches are alike."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    return _let(union, lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)))


def printed(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n and half of each id (half of its code points, rounded down), the id before it in
    descending order (`upper`, after the last the first) and that one's half (`upper_half`)."""
    ids = docs.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n"))
    ids = cut(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    edges = ids.groupBy("part").agg(F.min(F.struct("doc_id", "n")).alias("first"))
    row = Window.orderBy("part")  # a row for each partition
    edges = edges.select("part", F.coalesce(F.lead("first").over(row), F.first("first").over(row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    own = F.lead(F.struct("doc_id", "n")).over(Window.partitionBy("part").orderBy("doc_id"))
    out = ids.withColumn("upper", own).join(edges, "part").withColumn("upper", F.coalesce("upper", "after"))
    return out.select("doc_id", "n", F.col("upper.doc_id").alias("upper"), F.floor(F.col("upper.n") / 2).cast("int").alias("upper_half"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, the sketches `hashes` and `edited_hashes`, and near_edited
    and near_next for every row of docs. The edited text has its last half replaced by the head of
    the next document in descending order of doc_id.

    A null text is empty; a null doc_id sorts last in that order; rows that repeat a doc_id are one
    document, whose head and sketch as a next one are those of its longest text (of several, the
    one with the greatest head); a single document is its own next. Other columns are ignored; an
    empty table gives an empty result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(id_in(), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    # a text is sketched once; what needs it later has the 64 numbers by id and hash
    sketches = cut(texts.select("doc_id", "text_hash", sketch(F.col("text")).alias("hashes")).groupBy("doc_id", "text_hash").agg(F.first("hashes").alias("hashes")), "sketches")
    own = texts.join(neighbours(texts), "doc_id")
    heads = own.groupBy(F.col("upper").alias("doc_id")).agg(F.max(F.struct("n", F.char_length("text").alias("chars"), F.left("text", F.col("upper_half")).alias("head"), "text_hash", F.col("doc_id").alias("next_id"))).alias("next"))
    both = own.select("doc_id", "text", "text_hash", F.char_length("text").alias("chars")).join(heads, "doc_id")
    half = F.floor(F.col("chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("chars") - half), F.left("next.head", half))
    both = both.select("doc_id", "text_hash", F.col("chars").cast("long").alias("n_chars"), edited.alias("edited"), "next.next_id", F.col("next.text_hash").alias("next_hash"))
    both = cut(both.select("doc_id", "text_hash", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_hashes"), "next_id", "next_hash"), "edited")
    both = both.join(sketches, ["doc_id", "text_hash"]).join(sketches.toDF("next_id", "next_hash", "next_hashes"), ["next_id", "next_hash"])
    return both.select(id_out(), "n_chars", "edited_sha256", "hashes", "edited_hashes", likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir)).select("doc_id", "n_chars", "edited_sha256", printed(F.col("hashes")).alias("fingerprint"), printed(F.col("edited_hashes")).alias("edited_fingerprint"), "near_edited", "near_next")
