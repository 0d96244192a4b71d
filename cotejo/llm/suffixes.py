"""Operator 3, suffix-array dedup: remove bytes of strings that also start in an earlier document.

Method: Burrows-Wheeler transforms of shards, merged by interleave refinement. Suffixes are dealt
by content, so that no task sees them all: runs of `window`-byte windows with one minimizer (the
least hash of 16 bytes inside) form a context; equal windows have equal minimizers and meet in one
bucket. Contexts whose minimizer is in one document drop out. Equal contexts count once, with
their least document: later ones are covered whole. Only different contexts of a minimizer need
suffix order, each from its first place. A bucket's contexts are dealt to shards; each shard's
transform is built alone; the merge starts with the shards one after the other and in each round
deals the interleaved suffixes by the symbol before them, stably, through each shard's LF mapping.
After h rounds the order is that of the first h symbols, and blocks, which split where symbols or
earlier blocks do, are intervals with a common prefix of h. At `window` rounds the blocks are the
repeated intervals; no suffix is compared or sorted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .common import cut, documents, id_in, id_out

ANCHOR = 16
SHARDS = 4
STEP = 7
#: Contexts that one bucket holds on average: few, so that its arrays stay in the CPU's cache.
BUCKET = 4_000
_U = np.uint64
_SEED = 23


def _anchor_hashes(sums: np.ndarray) -> np.ndarray:
    """48-bit hashes of all runs of ANCHOR bytes."""
    _, down = S.powers(len(sums))
    n = len(sums) - ANCHOR
    x = (sums[ANCHOR:] - sums[:n]) * down[:n]
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    return x >> _U(16)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _contexts(window: int):
    """h (minimizer), body (hash of the bytes), doc_id and place (start and number of windows, in
    one number) of each context."""
    schema = pa.schema([("h", pa.int64()), ("body", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = S.ids_of(batch)
            for rows, data, offsets in S.text_parts(batch):
                if len(data) < window:
                    continue
                sums = S.prefix_sums(S.byte_values(_SEED, False)[data])
                least = _sliding_min(_anchor_hashes(sums), window - ANCHOR + 1)
                inside = np.ones(len(least), dtype=bool)  # the window ends in its row
                for end in offsets[1:-1]:
                    inside[max(0, end - window + 1) : end] = False
                starts = inside.copy()
                starts[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
                stops = inside.copy()
                stops[:-1] &= ~inside[1:] | (least[1:] != least[:-1])
                a, b = np.flatnonzero(starts), np.flatnonzero(stops)
                row = np.searchsorted(offsets, a, "right") - 1
                yield S.batch_of(schema, S.signed(least[a]), S.signed(S.run_hashes(sums, a, b + window)), ids[rows][row], (a - offsets[row]) << 32 | (b - a + 1))

    return run


def _strings(window: int):
    """The bytes of the contexts listed in `places`."""
    schema = pa.schema([("h", pa.int64()), ("body", pa.int64()), ("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = S.ids_of(batch), batch.column(batch.schema.get_field_index("places"))
            texts = batch.column(batch.schema.get_field_index("text"))
            for k in range(len(ids)):
                own, data = places[k].values, (texts[k].as_py() or "").encode()
                cuts = [data[p >> 32 : (p >> 32) + (p & 0xFFFFFFFF) + window - 1] for p in own.field("place").to_pylist()]
                yield S.batch_of(schema, own.field("h"), own.field("body"), np.full(len(cuts), ids[k]), cuts)

    return run


def _live(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, window: int) -> np.ndarray:
    """Contexts that can share a window with another one of their minimizer. The other bytes of a
    common window are split between its sides in some way; by steps of STEP bytes on the left, a
    common window means common bytes on both sides in one of a few widths. A context without a
    partner in any of them is out. Contexts with their minimizer twice stay."""
    sums = S.prefix_sums(S.byte_values(_SEED, False)[data])
    owner = np.repeat(np.arange(len(h)), np.diff(offsets))
    at = np.arange(len(data) - ANCHOR + 1)
    place = at[(_anchor_hashes(sums) == h[owner[at]]) & (at + ANCHOR <= offsets[owner[at] + 1])]
    row, first, count = np.unique(owner[place], return_index=True, return_counts=True)
    live = np.zeros(len(h), dtype=bool)
    live[row[count > 1]] = True
    row, place = row[count == 1], place[first[count == 1]]
    rest = window - ANCHOR
    for left in range(0, rest + 1, STEP):
        low, high = place - left, place + ANCHOR + max(0, rest - left - STEP + 1)
        fits = (low >= offsets[row]) & (high <= offsets[row + 1])
        side = S.mix(S.run_hashes(sums, low[fits], high[fits]) ^ h[row[fits]])
        order = np.argsort(side)
        side = side[order]
        twin = np.zeros(len(side) + 1, dtype=bool)
        twin[1:-1] = side[1:] == side[:-1]
        live[row[fits][order[twin[1:] | twin[:-1]]]] = True
    # a minimizer with a double keeps all its contexts
    return live | np.isin(h, h[np.setdiff1d(np.flatnonzero(live), row)])


def transform(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The transform of strings, each with an end below all bytes (ends in order of the strings),
    and the suffix array. Symbols are byte + 1, the end is 0; UTF-8 has no byte over 254."""
    k = len(offsets) - 1
    text = np.zeros(len(data) + k, dtype=np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(k), np.diff(offsets))] = data + np.uint8(1)
    n = len(text)
    ends = np.flatnonzero(text == 0)
    to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the end
    key, padded = np.zeros(n, dtype=_U), np.concatenate([text, np.zeros(8, np.uint8)])
    for j in range(8):
        key = key << _U(8) | np.where(j < to_end, padded[j : n + j], 0).astype(_U)
    depth = 8
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(n, dtype=bool)
        new[1:] = (key[order[1:]] != key[order[:-1]]) | (to_end[order[1:]] < depth)
        rank = np.empty(n, dtype=_U)
        rank[order] = np.cumsum(new).astype(_U)
        if new.all():
            break
        key = rank << _U(32) | rank[np.minimum(np.arange(n) + depth, n - 1)]
        depth *= 2
    return text[order - 1], order


def merged_blocks(bwts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms: the suffixes (as rank in their shard, shards one after the other) in the
    order of their first `depth` symbols, and the block of each, equal where these are."""
    lf, base = [], 0
    for bwt in bwts:
        own = np.empty(len(bwt), dtype=np.int32)
        own[np.argsort(bwt, kind="stable")] = np.arange(base, base + len(bwt), dtype=np.int32)
        lf.append(own)
        base += len(bwt)
    symbols, step = np.concatenate(bwts), np.concatenate(lf)
    suffix, block = np.arange(base, dtype=np.int32), np.zeros(base, dtype=np.int32)
    for _ in range(depth):
        before = symbols[suffix]
        order = np.argsort(before, kind="stable")
        before, held = before[order], block[order]
        split = np.zeros(base, dtype=bool)
        np.not_equal(before[1:], before[:-1], out=split[1:])
        split[1:] |= held[1:] != held[:-1]
        suffix, block = step[suffix[order]], np.cumsum(split, dtype=np.int32)
    return suffix, block


def _take(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(offsets)[rows]
    edge = np.concatenate([[0], np.cumsum(size)])
    return data[np.arange(edge[-1]) + np.repeat(offsets[rows] - edge[:-1], size)], edge


def covered(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, window: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the windows that are also in a string of a smaller doc."""
    parts = [p for p in np.array_split(np.arange(len(doc)), min(shards, len(doc))) if len(p)]
    bwts, string, offset = [], [], []
    for part in parts:
        own, edge = _take(data, offsets, part)
        bwt, sa = transform(own, edge)
        bwts.append(bwt)
        begin = edge[:-1] + np.arange(len(part))  # with the ends of the strings before
        row = np.searchsorted(begin, sa, "right") - 1
        string.append(part[row])
        offset.append(sa - begin[row])
    suffix, block = merged_blocks(bwts, window)
    string, offset = np.concatenate(string)[suffix], np.concatenate(offset)[suffix]
    whole = offset + window <= np.diff(offsets)[string]
    string, offset, block = string[whole], offset[whole], block[whole]
    if not len(block):
        return string, offset
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    least = np.repeat(np.minimum.reduceat(doc[string], first), np.diff(np.append(first, len(block))))
    hit = least < doc[string]
    return string[hit], offset[hit]


def _merge(window: int, shards: int):
    schema = pa.schema([("h", pa.int64()), ("body", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        batch = table.select(["bytes"]).combine_chunks().to_batches()[0]
        h, body, doc = (table[c].to_numpy() for c in ("h", "body", "doc_id"))
        _, data, offsets = next(S.text_parts(batch, "bytes", most=1 << 62))
        rows = np.flatnonzero(_live(data, offsets, h.view(_U), window))
        if not len(rows):
            return schema.empty_table()
        rows = rows[np.lexsort((body[rows], h[rows]))]
        data, offsets = _take(data, offsets, rows)
        string, offset = covered(data, offsets, doc[rows], window, shards)
        a, b = S.as_runs(np.sort(string * (1 << 32) + offset))
        string = rows[a >> 32]
        return pa.table([h[string], body[string], (a & 0xFFFFFFFF).astype(np.int32), (b - ((a >> 32) << 32)).astype(np.int32)], schema=schema)

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])
    for batch in batches:
        ids, texts, hits = S.ids_of(batch), batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("hits"))
        out: list[tuple] = []
        size = 0
        for k in range(len(ids)):
            data, runs = (texts[k].as_py() or "").encode(), []
            if hits[k].is_valid:
                own = hits[k].values
                change = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(change, np.minimum(own.field("start").to_numpy(), len(data)), 1)
                np.add.at(change, np.minimum(own.field("end").to_numpy(), len(data)), -1)
                a, b = S.as_runs(np.flatnonzero(np.cumsum(change)[:-1] > 0))
                runs = [{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)]
            edge = [0, *(x for r in runs for x in (r["start"], r["end"])), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
            out.append((ids[k], len(data), len(data) - len(kept), runs, kept))
            size += len(kept)
            if size > 8 << 20:
                yield S.batch_of(schema, *map(list, zip(*out, strict=True)))
                out, size = [], 0
        if out:
            yield S.batch_of(schema, *map(list, zip(*out, strict=True)))


def suffix_dedup(docs: DataFrame, window: int = 50, shards: int = SHARDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal runs of removed bytes) and kept (the bytes left,
    binary, as a run may end inside a character) for every row of docs.

    A null text is empty; texts under `window` bytes keep all. A null doc_id sorts before all
    others. Rows that repeat a doc_id are one document: what is found in any of them goes from
    each. Other columns are ignored; an empty table gives an empty result."""
    texts = docs.select(id_in(), F.col("text").cast("string").alias("text"))
    contexts = texts.mapInArrow(_contexts(window), "h long, body long, doc_id long, place long")
    shared = contexts.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h")
    contexts = cut(contexts.join(shared, "h"), "contexts")
    firsts = cut(contexts.groupBy("h", "body").agg(F.min(F.struct("doc_id", "place")).alias("first")), "firsts")
    several = firsts.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    places = cut(firsts.join(several, "h").groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("h", "body", "first.place")).alias("places"), F.count("*").alias("c")), "places")
    buckets = max(1, (places.agg(F.sum("c")).first()[0] or 0) // BUCKET)
    strings = texts.join(places.select("doc_id", "places"), "doc_id").mapInArrow(_strings(window), "h long, body long, doc_id long, bytes binary")
    runs = strings.groupBy(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket")).applyInArrow(_merge(window, shards), "h long, body long, a int, b int")
    runs = cut(runs, "runs")

    of_first = contexts.join(firsts, ["h", "body"]).select("h", "body", "doc_id", F.shiftright("place", 32).alias("start"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("n"), (F.col("doc_id") > F.col("first.doc_id")).alias("later"))
    whole = of_first.filter("later").select("doc_id", "start", (F.col("start") + F.col("n") + window - 1).alias("end"))
    partly = of_first.filter("not later").join(runs, ["h", "body"]).select("doc_id", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b") + window - 1).alias("end"))
    hits = cut(whole.union(partly).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("hits")), "hits")
    out = texts.join(hits, "doc_id", "left").mapInArrow(_assemble, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
    return out.withColumn("doc_id", id_out())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
