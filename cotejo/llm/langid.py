"""Operator 6, language ID: first the family, then one-versus-one linear SVMs inside it.

Features are hashed byte trigrams of the text with A-Z lowered and every other ASCII byte as a
blank, as shares of all trigrams. The machines (families against each other, and the languages of
one family against each other) are squared-hinge linear SVMs, fitted by accelerated gradient steps
on a bounded sample of labelled rows: at most SAMPLE of each language, chosen by a hash of id and
text. Every label counts; a pair's machine is fitted in a task, which has the rows of its two
classes only, and the driver holds the machines. Prediction is one pass over the whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from . import spans as S
from .common import crc_remainder, cut, documents, id_in

SAMPLE, FEATURES = 300, 4096
UNKNOWN = "und"
#: Families of some languages by ISO 639-1 code. Others are a family of their own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa", "ur"),
}

_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family_of(language: str) -> str:
    return next((name for name, own in FAMILIES.items() if language in own), language)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the rows' trigrams, a blank before and after each row; where each row begins.
    A row of n bytes has n of them."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    padded = np.full(len(data) + 2 * (len(offsets) - 1), 32, dtype=np.uint32)
    middle = np.arange(len(data)) + 2 * row + 1
    padded[middle] = _FOLD[data]
    code = padded[middle - 1] << np.uint32(16) | padded[middle] << np.uint32(8) | padded[middle + 1]
    return ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64), offsets


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features that a row has, and their shares."""
    schema = pa.schema([("lang", pa.string()), ("at", pa.binary()), ("x", pa.binary())])
    for batch in batches:
        langs = batch.column(batch.schema.get_field_index("lang"))
        for rows, data, offsets in S.text_parts(batch):
            grams, edge = _grams(data, offsets)
            own = [np.unique(grams[a:b], return_counts=True) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            shares = [(n / max(1, n.sum())).astype(np.float32).tobytes() for _, n in own]
            yield S.batch_of(schema, langs.slice(rows.start, rows.stop - rows.start), [at.astype(np.uint16).tobytes() for at, _ in own], shares)


def _matrix(at: pa.ChunkedArray, shares: pa.ChunkedArray) -> np.ndarray:
    x = np.zeros((len(at), FEATURES), dtype=np.float32)
    for k, (own, values) in enumerate(zip(at.to_pylist(), shares.to_pylist(), strict=True)):
        x[k, np.frombuffer(own, dtype=np.uint16)] = np.frombuffer(values, dtype=np.float32)
    return x


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, np.zeros(FEATURES)
    for batch in batches:
        for at, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[np.frombuffer(at, dtype=np.uint16)] += np.frombuffer(x, dtype=np.float32)
        n += batch.num_rows
    if n:
        yield S.batch_of(pa.schema([("n", pa.int64()), ("total", pa.binary())]), [n], [total.tobytes()])


def _fit(scale: np.ndarray):
    """The machine of the pair that a group has the rows of; `first` says that a row is of its first class."""
    schema = pa.schema([("pair", pa.int32()), ("w", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("lang", "ascending"), ("at", "ascending"), ("x", "ascending")])
        x = _matrix(table["at"], table["x"])
        x *= scale
        w = fit_svm(x, np.where(table["first"].to_numpy(), 1.0, -1.0))
        return pa.table([table["pair"][:1], [np.append(w[:-1] * scale, w[-1]).astype(np.float32).tobytes()]], schema=schema)

    return run


def fit_svm(x: np.ndarray, y: np.ndarray, steps: int = 150, penalty: float = 1e-3) -> np.ndarray:
    """Weights, the last for the constant, of a linear squared-hinge SVM; both classes (y -1, 1)
    weigh the same. x is in single precision and isn't copied."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    rate = 1 / (2 * (np.einsum("ij,ij->i", x, x).max() + 1) + penalty)
    w = ahead = np.zeros(x.shape[1] + 1)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1].astype(np.float32) + ahead[-1]))
        pull = share * slack * y
        slope = np.append(pull.astype(np.float32) @ x, pull.sum())
        new = ahead - rate * (penalty * ahead - 2 * slope)
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w


class Pair(NamedTuple):
    family: bool
    a: str
    b: str


class Model:
    """Machines by pair: of families, and of the languages inside each family."""

    def __init__(self, langs: list[str]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(family_of(lang), []).append(lang)
        self.pairs = [Pair(True, a, b) for a, b in combinations(sorted(self.families), 2)]
        self.pairs += [Pair(False, a, b) for group in self.families.values() for a, b in combinations(group, 2)]
        self.machines: list[np.ndarray] = []

    def dealt(self) -> list[tuple[str, int, bool]]:
        """The languages of each pair's two classes: language, pair, and whether it is of the first."""
        sides = [(k, p.family, c, c == p.a) for k, p in enumerate(self.pairs) for c in (p.a, p.b)]
        return [(lang, k, first) for k, family, c, first in sides for lang in (self.families[c] if family else [c])]

    @staticmethod
    def _winner(classes: list[str], margins: dict[tuple[str, str], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The class of each row with most of the pairwise votes (then the larger margins), and
        its mean pairwise chance."""
        vote, chance = np.zeros((len(classes), n)), np.zeros((len(classes), n))
        if len(classes) == 1:
            return np.zeros(n, dtype=np.int64), np.ones(n)
        at = {c: i for i, c in enumerate(classes)}
        for (a, b), m in margins.items():
            p = 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
            for c, q in ((a, p), (b, 1 - p)):
                vote[at[c]] += (q > 0.5) + 1e-3 * q
                chance[at[c]] += q / (len(classes) - 1)
        best = vote.argmax(axis=0)
        return best, chance[best, np.arange(n)]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        grams, edge = _grams(data, offsets)
        n, size = len(edge) - 1, np.maximum(1, np.diff(edge))
        margins = []
        for w in self.machines:
            sums = np.concatenate([[0.0], np.cumsum(w[grams], dtype=np.float64)])
            margins.append((sums[edge[1:]] - sums[edge[:-1]]) / size + w[-1])
        kin = sorted(self.families)
        best, score = self._winner(kin, {(p.a, p.b): m for p, m in zip(self.pairs, margins, strict=True) if p.family}, n)
        pick = np.empty(n, dtype=object)
        for i, family in enumerate(kin):
            group = self.families[family]
            own, chance = self._winner(group, {(p.a, p.b): m for p, m in zip(self.pairs, margins, strict=True) if not p.family and p.a in group}, n)
            mine = best == i
            pick[mine] = np.array(group, dtype=object)[own[mine]]
            score = np.where(mine, score * chance, score)
        return list(pick), score


def train(docs: DataFrame, label: str = "lang", rows: int = SAMPLE) -> Model:
    """Fit on rows of docs that have a text and a label, at most `rows` of each label."""
    known = docs.filter(F.col("text").isNotNull() & F.col(label).isNotNull()).select(id_in(), F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("lang"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.xxhash64("doc_id", "text")
    some = known.join(F.broadcast(counts), "lang").filter(F.pmod(place, F.lit(1_000_003)) < 3.0 * rows / F.col("n") * 1_000_003)
    order = Window.partitionBy("lang").orderBy(place, "doc_id", "text")
    sample = cut(some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rows).select("lang", "text").mapInArrow(_features, "lang string, at binary, x binary"), "sample")
    model = Model([r.lang for r in sample.select("lang").distinct().collect()])
    if not model.pairs:
        return model
    sums = sample.select("at", "x").mapInArrow(_sums, "n long, total binary").collect()
    mean = sum(np.frombuffer(r.total) for r in sums) / sum(r.n for r in sums)
    scale = (1 / np.sqrt(mean + 1e-5)).astype(np.float32)
    dealt = docs.sparkSession.createDataFrame(model.dealt(), "lang string, pair int, first boolean")
    fitted = sample.join(F.broadcast(dealt), "lang").groupBy("pair").applyInArrow(_fit(scale), "pair int, w binary").collect()
    model.machines = [np.frombuffer(r.w, dtype=np.float32) for r in sorted(fitted, key=lambda r: r.pair)]
    return model


def _predict(model: Model, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = np.zeros(256, dtype=np.int64)
        letter[65:91] = letter[97:123] = 1
        for batch in batches:
            for rows, data, offsets in S.text_parts(batch):
                if model.families:
                    langs, score = model.predict(data, offsets)
                else:
                    langs, score = [UNKNOWN] * (len(offsets) - 1), np.zeros(len(offsets) - 1)
                plain = np.concatenate([[0], np.cumsum(letter[data])])[offsets]
                for k in np.flatnonzero(np.diff(plain) == 0):
                    if not any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode()):
                        langs[k], score[k] = UNKNOWN, 0.0
                part = batch.slice(rows.start, rows.stop - rows.start)
                columns = [*part.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *names])

    return run


def label(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns of docs, with a language and a score (0 to 1) under names that docs
    doesn't have. Null texts and texts without a
    letter are `und` with score 0, and so is all else if the model learned no language. Ties go
    to the name that sorts first. Nulls in other columns don't matter, a null doc_id is kept, rows
    that repeat are predicted each, and an empty table gives an empty result."""
    schema = StructType([*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])
    return docs.mapInArrow(_predict(model, (lang, score)), schema)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for every row of docs; see label."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return label(texts, model).select("doc_id", "lang_pred", "score")


def held_out() -> Column:
    return crc_remainder(3) == 1


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs.filter(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
