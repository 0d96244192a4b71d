"""A corpus through language ID, line dedup, near-dedup, decontamination and packing.

Each stage works on all rows that its predecessor kept. Nulls, empty tables and other edge cases
are as the operators define them; a stage drops a row only by its own decision.
"""

from __future__ import annotations

from collections.abc import Callable

from cotejo.llm import decontaminate, langid, lines, near, packing
from cotejo.llm.common import cut, documents, drop, free, id_in
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose doc_id is (left_semi) or isn't (left_anti) in ids; two nulls are equal."""
    rows = docs.select(F.struct("*").alias("row"), id_in())
    return rows.join(ids.select(id_in()).distinct(), "doc_id", how).select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that no language is found in (null, or without a letter)."""
    model = langid.train(docs.filter(~langid.held_out()))
    if not model.families:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score = free(docs, "lang_pred", "score")
    return langid.label(docs, model, lang, score).filter(F.col(lang) != langid.UNKNOWN).drop(lang, score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that an earlier line nearly equals, short ones too, and drops documents with
    nothing left. n_chars is that of the new text, where there is such a column."""
    found = lines.without_lines(docs, lines.removed_lines(docs, short=True))
    left = found.filter((F.size("removed") == 0) | F.col("kept").rlike(r"\S"))
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return left.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies (word shingles at 0.8). Of
    rows that repeat an id and a text it keeps the one that is least as JSON."""
    kept = _only(docs, near.near_dedup(docs, percent=80).filter("kept"), "left_semi")
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    rows = kept.select("doc_id", "text", F.struct("*").alias("row"))
    return rows.groupBy("doc_id", "text").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _only(docs, found.filter("n_hit > 0"), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Tokens and packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
