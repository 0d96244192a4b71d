"""Operator 12, vector code compression: product quantization whose entries are found by Orchard search.

Method: a vector is cut into four parts, each with a codebook of at most 256 entries. For every entry a
list of all entries by distance from it is kept. A search scans the list of its current entry, marks what
it visits, jumps to the list of an entry that is nearer (or as near with a lower index), and stops where
the list is beyond twice the current distance: by the triangle inequality the rest is farther. Distances
are squared whole numbers, so "twice" is four times, and results are exact, ties included.

The table of whole numbers is written once. A round is one scan of it: tasks hold the codebooks (4 * 256
entries, whatever the rows) and give one sum for each entry, which Spark adds up; the driver sees 1,024 sums.
Errors by label are added up before they meet rows, and labels are salted, so a hot label is no hot task.

Rows whose vector is null or has a null or non-finite component go. Vectors shorter than the longest, or
of a length that four doesn't divide, end in zeros. Components count as within 2^17, which keeps sums of
squares of 64 components whole longs. Null ids sort first; rows that repeat an id count each. No rows left: an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Largest magnitude of a component as a whole number.
REACH = 1 << 27
#: Rows that are searched together, and list places that a search reads at once.
ROWS, STRIDE = 2048, 8
SALTS = 64


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v: kept rows as whole numbers, floor(1024 * x)."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * 1024, F.lit(float(REACH))), F.lit(float(-REACH)))).cast("int"))
    return vectors.filter(F.col("embedding").isNotNull() & good).select("vec_id", "label", whole.alias("v"))


@dataclass
class Codebook:
    """Entries of one part position, and for each entry all entries by distance from it."""

    entries: np.ndarray

    def __post_init__(self):
        apart = np.stack([((self.entries - e) ** 2).sum(1) for e in self.entries])
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.near, axis=1)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the lowest of equal ones, and its squared distance."""
        found = [self._search(x[k : k + ROWS]) for k in range(0, len(x), ROWS)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(x), len(self.entries)
        now, place, live = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        best = ((x - self.entries[0]) ** 2).sum(1)
        visited = np.zeros((n, size), bool)
        visited[:, 0] = True
        while live.size:
            at = place[live, None] + np.arange(STRIDE)
            inside = at < size
            at = np.minimum(at, size - 1)
            entry = self.near[now[live, None], at]
            inside &= self.apart[now[live, None], at] <= 4 * best[live, None]
            row, col = np.nonzero(inside & ~visited[live[:, None], entry])
            who, what = live[row], entry[row, col]
            visited[who, what] = True
            gap = ((x[who] - self.entries[what]) ** 2).sum(1)
            # The nearest of a row's new entries, the lowest index of equal ones.
            order = np.lexsort((what, gap, who))
            who, what, gap = who[order], what[order], gap[order]
            lead = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, bool)
            who, what, gap = who[lead], what[lead], gap[lead]
            better = (gap < best[who]) | ((gap == best[who]) & (what < now[who]))
            who, what, gap = who[better], what[better], gap[better]
            place[live] += STRIDE
            now[who], best[who], place[who] = what, gap, 0
            jumped = np.zeros(n, bool)
            jumped[who] = True
            # A list ends, or is beyond twice the distance, at its first place that isn't inside.
            live = live[inside.all(1) | jumped[live]]
        return now, best


def _parts(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as rows * parts * width, with zeros after short ones."""
    lists = batch.column(batch.schema.get_field_index("v"))
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), PARTS * width), np.int64)
    out[np.arange(PARTS * width) < size[:, None]] = lists.flatten().to_numpy()
    return out.reshape(len(lists), PARTS, width)


def _sums(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """part, entry, n, s0, s1, ...: how many parts have this entry as their nearest, and their sum."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        count, total = np.zeros((PARTS, len(books[0])), np.int64), np.zeros((PARTS, len(books[0]), width), np.int64)
        for batch in batches:
            x = _parts(batch, width)
            for p, book in enumerate(found if len(x) else []):
                code, _ = book.search(x[:, p])
                np.add.at(count[p], code, 1)
                np.add.at(total[p], code, x[:, p])
        part, entry = np.nonzero(count)
        sums = total[part, entry]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (part, entry, count[part, entry], *sums.T)], names)

    names = ["part", "entry", "n", *(f"s{k}" for k in range(width))]
    partial = rows.select("v").mapInArrow(tally, ", ".join(f"{c} long" for c in names))
    return partial.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names[2:]))


def codebooks(rows: DataFrame, width: int) -> list[np.ndarray]:
    """The codebooks of the part positions after ROUNDS rounds over all rows."""
    whole = F.concat("v", F.array_repeat(F.lit(0), F.lit(PARTS * width) - F.size("v"))).alias("v")
    first = rows.select("vec_id", whole).orderBy(F.col("vec_id").asc_nulls_first(), "v").limit(ENTRIES).collect()
    start = np.array([r.v for r in first], np.int64).reshape(len(first), PARTS * width)
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(PARTS)]
    for _ in range(ROUNDS):
        for r in _sums(rows, books, width).collect():
            books[r.part][r.entry] = np.array(r[3:], np.int64) // r.n
    return books


def _coded(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """vec_id, label, code, error of all rows."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        for batch in batches:
            x = _parts(batch, width)
            if not len(x):
                continue
            codes, gaps = zip(*(book.search(x[:, p]) for p, book in enumerate(found)))
            code = [row.tobytes().hex() for row in np.stack(codes, 1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(sum(gaps))], ["vec_id", "label", "code", "error"])

    schema = T.StructType([*rows.select("vec_id", "label").schema, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.mapInArrow(assign, schema)


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 and label of all kept rows of vectors."""
    rows = cut(integers(vectors), "vectors")
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    width = -(-(longest or 0) // PARTS)
    if longest is None:
        books, coded = [], rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        books = codebooks(rows, width)
        coded = cut(_coded(rows, books, width), "codes")
    numbers = ",".join(str(x) for b in books for x in b.reshape(-1).tolist())
    digest = hashlib.sha256(numbers.encode()).hexdigest()
    # Inside a struct nulls are equal; each salt of rows has its own copy of a label's sum.
    label = F.struct("label").alias("l")
    sums = coded.groupBy(label).agg(F.sum("error").alias("label_error"))
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.select("*", label, F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int").alias("salt"))
    out = salted.join(sums, ["l", "salt"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "label")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """All distances in every round: no lists, no search. A chunk is one part of one vector."""
    assign = """n{r} AS (SELECT vec_id, p, x, k % 256 AS entry, k // 256 AS d FROM (SELECT vec_id, p, x, min(256 * d + entry) AS k FROM
    (SELECT vec_id, p, x, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM chunk JOIN b{r} USING (p)) GROUP BY ALL)),"""
    update = """m{r} AS (SELECT p, entry, list(s ORDER BY i) AS c FROM
    (SELECT p, entry, i, floor(sum(x[i]) / count(*))::BIGINT AS s FROM n{r}, unnest(range(1, 17)) AS u(i) GROUP BY ALL) GROUP BY ALL),
b{s} AS (SELECT p, entry, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (p, entry)),"""
    rounds = "\n".join(assign.format(r=r) + "\n" + update.format(r=r, s=r + 1) for r in range(ROUNDS))
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
chunk AS (SELECT vec_id, p, v[16 * p + 1:16 * p + 16] AS x FROM kept, unnest(range(4)) AS u(p)),
b0 AS (SELECT p, rank() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, x AS c FROM chunk QUALIFY entry < 256),
{rounds}
{assign.format(r=ROUNDS)}
e AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM n{ROUNDS} JOIN kept USING (vec_id) GROUP BY ALL),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256, label FROM e, h
"""


#: For vectors of 64 components, as in the given tables.
ORACLE = _oracle()
