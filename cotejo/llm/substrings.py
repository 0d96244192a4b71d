"""Operator 10, substring dedup: remove words covered by passages seen in earlier documents.

Method: difference-cover anchors. Modulo PERIOD, every difference of two positions is a
difference of two COVER residues. So any two equal passages of `window` words hold, at the same
place in both, an anchor of `window - PERIOD + 1` words that starts at a cover position of its
document on either side. Only anchors at cover positions are hashed (6 of 31); anchors found in
two documents then extend to the windows around them, whose hashes (96 bits) decide.

Shuffles: anchors (a hash, an id), windows near shared anchors, and the texts by id. Hot anchors
and windows are pre-aggregated to a smallest and a largest id before the shuffle, and what two
documents share is written as a table of its own; the joins back then are plain equi-joins with one
row a key on the other side, whose hot partitions AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .common import cut, documents, drop, id_in, id_out

#: A perfect difference cover, 6 residues whose differences are all of 1..30.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)


def _word_sums(data: np.ndarray, offsets: np.ndarray, seed: int):
    start, end, first = S.words(data, offsets, S.SPACE)
    hashes = S.run_hashes(S.prefix_sums(S.byte_values(seed, False)[data]), start, end)
    return first, S.prefix_sums(hashes)


def _anchors(window: int):
    width = window - PERIOD + 1
    cover = np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = S.ids_of(batch)
            for rows, data, offsets in S.text_parts(batch):
                first, sums = _word_sums(data, offsets, 7)
                start, row = S.windows(first, width)
                pos = start - first[row]
                keep = cover[pos % PERIOD]
                start, row, pos = start[keep], row[keep], pos[keep]
                yield S.batch_of(schema, S.signed(S.run_hashes(sums, start, start + width)), ids[rows][row], pos.astype(np.int32))

    return run


def _windows(window: int):
    schema = pa.schema([("w", pa.int64()), ("w2", pa.int32()), ("doc_id", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, near = S.ids_of(batch), batch.column(batch.schema.get_field_index("near"))
            for rows, data, offsets in S.text_parts(batch):
                first, sums = _word_sums(data, offsets, 7)
                _, check = _word_sums(data, offsets, 1009)
                part = near.slice(rows.start, rows.stop - rows.start)
                at = np.asarray(part.flatten(), dtype=np.int64)
                row = np.repeat(np.arange(len(part)), np.diff(np.asarray(part.offsets)))
                # an anchor at word i lies in the windows that start at i - PERIOD + 1 .. i
                marks = np.zeros(first[-1] + 2, dtype=np.int32)
                top = first[row + 1] - window + 1
                low, high = np.maximum(first[row], first[row] + at - PERIOD + 1), np.minimum(first[row] + at + 1, top)
                good = low < high
                np.add.at(marks, low[good], 1)
                np.add.at(marks, high[good], -1)
                start = np.flatnonzero(np.cumsum(marks)[: first[-1]] > 0)
                row = np.searchsorted(first, start, "right") - 1
                second = (S.run_hashes(check, start, start + window) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield S.batch_of(schema, S.signed(S.run_hashes(sums, start, start + window)), second, ids[rows][row], (start - first[row]).astype(np.int32))

    return run


def _assemble(window: int):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, col, hit = S.ids_of(batch), batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("hits"))
            out: list[tuple] = []
            size = 0
            for k in range(len(ids)):
                parts = (col[k].as_py() or "").encode().split()
                runs = []
                if hit[k].is_valid:
                    starts = np.unique(np.asarray(hit[k].values, dtype=np.int64))
                    starts = starts[starts + window <= len(parts)]
                    covered = np.zeros(len(parts) + 1, dtype=np.int32)
                    covered[starts] += 1
                    np.add.at(covered, starts + window, -1)
                    a, b = S.as_runs(np.flatnonzero(np.cumsum(covered)[:-1] > 0))
                    runs = [{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)]
                edge = [0, *(x for r in runs for x in (r["start"], r["end"])), len(parts)]
                kept = [w for a, b in zip(edge[::2], edge[1::2], strict=True) for w in parts[a:b]]
                text = b" ".join(kept).decode()
                out.append((ids[k], len(parts), len(parts) - len(kept), runs, text))
                size += len(text)
                if size > 8 << 20:
                    yield S.batch_of(schema, *map(list, zip(*out, strict=True)))
                    out, size = [], 0
            if out:
                yield S.batch_of(schema, *map(list, zip(*out, strict=True)))

    return run


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, spans (runs of removed words) and kept (the words left, joined
    by one blank) for every row of docs.

    A null text has no words; words are the runs without blank or \\x09-\\x0D. A text of fewer
    words than `window` keeps them all. A null doc_id sorts before all others. Rows that repeat a
    doc_id are one document: what is found in any of them goes from each. Other columns are
    ignored; an empty table gives an empty result."""
    if window < PERIOD + 8:
        raise ValueError(f"window must be at least {PERIOD + 8}: the anchors would be too short")
    texts = docs.select(id_in(), F.col("text").cast("string").alias("text"))
    anchors = texts.mapInArrow(_anchors(window), "h long, doc_id long, pos int")
    shared = cut(anchors.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h"), "shared")
    near = cut(anchors.hint("merge").join(shared.hint("merge"), "h").groupBy("doc_id").agg(F.collect_list("pos").alias("near")), "anchors")
    drop(shared)
    windows = cut(texts.join(near, "doc_id").mapInArrow(_windows(window), "w long, w2 int, doc_id long, pos int"), "windows")
    least = cut(windows.groupBy("w", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").drop("hi"), "least")
    hits = cut(windows.hint("merge").join(least.hint("merge"), ["w", "w2"]).filter("lo < doc_id").groupBy("doc_id").agg(F.collect_list("pos").alias("hits")), "hits")
    drop(near, windows, least)
    out = texts.join(hits, "doc_id", "left").mapInArrow(_assemble(window), "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")
    return out.withColumn("doc_id", id_out())


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
