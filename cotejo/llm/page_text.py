"""Operator 11, HTML extraction: the article's blocks of a page by a decision tree.

Method: a page is cut into flat text blocks (page_blocks). Each has its words and link density, those of
the blocks before and after it, the unlinked words of its container, also as a share of those that no tag or
name puts outside the article, and whether one puts it outside or inside. A decision tree (pyspark.ml) learns from the
blocks of a small labelled table of pages and is compiled to a column, so pages are scanned once: Python
cuts blocks in Arrow batches, array functions do all else, and nothing is shuffled.

All of a page's text takes part. Null or empty html, or a page without text of an article, gives ''. Null
page_id and url stay, repeated rows give repeated rows, an empty table an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .page_blocks import Block, blocks
from .page_samples import MARK, pages

_FIELDS = {"text": "string", "words": "int", "letters": "int", "linked": "int", "family": "int", "off": "boolean", "on": "boolean", "heading": "boolean"}
_BLOCK_TYPE = f"array<struct<{', '.join(f'{k}: {v}' for k, v in _FIELDS.items())}>>"
_ARROW = pa.list_(pa.struct([(k, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[v]) for k, v in _FIELDS.items()]))
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "family", "share", "off", "on", "heading")
#: Depth of the tree, and blocks that a leaf has at least.
DEPTH, LEAF = 6, 2


def with_blocks(rows: DataFrame, html: str) -> DataFrame:
    """rows, which must have no other column of these names, with `blocks` instead of html."""
    held = [c for c in rows.columns if c != html]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in held), f"blocks {_BLOCK_TYPE}"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(Block._fields, b)) for b in blocks(h or "")] for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), pa.array(found, _ARROW)], [*held, "blocks"])

    return rows.select(*(f"`{c}`" for c in held), html).mapInArrow(split, schema)


def featured(found: str) -> Column:
    """The blocks with the features of each, in page order."""
    total = F.aggregate(found, F.lit(0), lambda a, b: a + F.when(~b["off"] & (3 * b["linked"] < b["letters"]), b["words"]).otherwise(F.lit(0)))

    def number(value: Column) -> Column:
        return F.coalesce(value.cast("double"), F.lit(0.0))

    def density(b: Column) -> Column:
        return number(b["linked"] / b["letters"])

    def features(b: Column, k: Column) -> Column:
        before, after = F.get(found, k - 1), F.get(found, k + 1)
        share = number(b["family"] / F.greatest(total, F.lit(1)))
        values = (number(b["words"]), density(b), number(before["words"]), density(before), number(after["words"]), density(after))
        values += (number(b["family"]), share, number(b["off"]), number(b["on"]), number(b["heading"]))
        return F.struct(b["text"].alias("text"), *(v.alias(n) for v, n in zip(values, FEATURES)))

    return F.transform(found, features)


def train(spark: SparkSession, samples: list[str] | None = None) -> str:
    """The description of a tree fitted to the blocks of pages whose article's blocks begin with MARK."""
    rows = spark.createDataFrame([(h,) for h in samples or pages()], "html string")
    found = with_blocks(rows, "html").select(F.inline(featured("blocks")))
    found = found.withColumn("label", F.startswith("text", F.lit(MARK)).cast("double"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
    model = DecisionTreeClassifier(maxDepth=DEPTH, minInstancesPerNode=LEAF, maxBins=256, seed=1).fit(vectors)
    return model.toDebugString


def rule(tree: str, block: Column) -> Column:
    """A fitted tree, as its description, over a block with features: true for the article."""
    lines = [line.strip() for line in tree.splitlines()[1:] if line.strip()]

    def node() -> Column:
        line = lines.pop(0)
        if leaf := re.match(r"Predict: (\S+)", line):
            return F.lit(float(leaf[1]) > 0.5)
        at, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        lines.pop(0)  # "Else" of the same split
        return F.when(block[FEATURES[int(at)]] <= float(bound), low).otherwise(node())

    return node()


def extract(rows: DataFrame, tree: str) -> DataFrame:
    """page_id, url, text, n_chars and blocks (those of the article) for each row of page_id, url, html."""
    found = with_blocks(rows.select("page_id", "url", "html"), "html")
    kept = F.transform(F.filter(featured("blocks"), lambda b: rule(tree, b)), lambda b: b["text"])
    out = found.select("page_id", "url", kept.alias("blocks"))
    text = F.array_join("blocks", "\n\n")
    return out.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), train(spark))


#: What the pages of the given tables hold between <article> and </article>, without any classifier.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, regexp_split_to_array(h, '</?(?:h1|p)>') AS b FROM a),
t AS (SELECT page_id, url, list_transform(b, lambda x: trim(regexp_replace(
    replace(replace(regexp_replace(replace(regexp_replace(x, '<br>', ' ', 'g'), '<b>', ''), '&amp;?', '&', 'g'), '&quot;', '"'), '&#x27;', ''''), '\s+', ' ', 'g'))) AS b FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM t)
"""
