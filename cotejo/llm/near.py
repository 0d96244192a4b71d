"""Operator 9, MinHash near-dedup with sequential Bayesian verification.

Texts of equal word sequences are one node, named by the least doc_id that has them; where one doc_id
would name several, as rows repeat it with different texts, they get names above all ids, and the texts of
a doc_id are linked afterwards. 128 MinHash values of a node's
5-word shingles make bands whose width follows the threshold: 25 of 5 at 0.85, 32 of 4 at 0.8, so
that a pair at the threshold shares none with probability 1e-6 at most (4e-7 and 5e-8).
Not all pairs of a bucket are made. First the member with most company is compared with the
others, which links a group of copies in one step. Buckets whose members are then in different
components join up to clusters, and there each node outside the cluster's largest component (a
query) meets all nodes of the cluster (its targets), in blocks of about QUERIES by TARGETS nodes, so
that no task holds a cluster. Signatures meet first, and a block puts out the nodes that go on, not
the pairs; only those bring their texts to the block. There it keeps its own union of components,
so that a query looks only for components it isn't linked with, nearest signatures first, and puts
out the links found.

A proposed pair goes through its signature in batches of 16. With m of n values equal and a flat
prior, the chance that the similarity reaches the threshold is P(Binomial(n + 1, t) <= m); the
pair is pruned once that falls under `miss`. What survives is counted on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .common import cut, documents, id_in, id_out
from .components import components

VALUES, BATCH, MISSED = 128, 16, 1e-6
#: Names of nodes that aren't a doc_id; ids are taken to be smaller.
FRESH = 1 << 62
#: Queries and targets of one block, about, and groups that small clusters are dealt to.
QUERIES, TARGETS, SMALL_GROUPS = 256, 2048, 1 << 12
_A = S.mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
_B = S.mix(np.arange(1001, VALUES + 1001, dtype=np.uint64))


def shingle_rows(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct hashed shingles of each row."""
    start, end, first = S.words(data, offsets, S.SPACE)
    sums = S.prefix_sums(S.run_hashes(S.prefix_sums(S.byte_values(11, True)[data]), start, end))
    at, row = S.windows(first, size)
    hashes, edge = S.run_hashes(sums, at, at + size), np.searchsorted(row, np.arange(len(first)))
    out = []
    for k in range(len(offsets) - 1):
        n = first[k + 1] - first[k]
        if n >= size:
            out.append(np.unique(hashes[edge[k] : edge[k + 1]]))
        elif n:
            out.append(S.run_hashes(sums, first[k : k + 1], first[k + 1 : k + 2]) + np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(VALUES, 2**32 - 1, dtype=np.uint64)
    for k in range(0, len(shingles), 4096):
        np.minimum(least, ((shingles[k : k + 4096] * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(axis=1), out=least)
    return least.astype(np.uint32)


def _sketch(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h = S.ids_of(batch), batch.column(batch.schema.get_field_index("h")).to_numpy()
            for rows, data, offsets in S.text_parts(batch):
                sets = shingle_rows(data, offsets, size)
                keys = [hashlib.blake2b(b" ".join(data[a:b].tobytes().lower().split()), digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                sigs = [signature(x).tobytes() if len(x) else None for x in sets]
                yield S.batch_of(schema, ids[rows], h[rows], list(map(len, sets)), [k if s else None for k, s in zip(keys, sigs, strict=True)], sigs)

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), VALUES)


def width(percent: int) -> int:
    """The most values a band can have so that a pair at the threshold shares a band, but for MISSED."""
    return max((r for r in range(1, VALUES + 1) if (1 - (percent / 100) ** r) ** (VALUES // r) <= MISSED), default=1)


def _bands(width: int):
    schema, count = pa.schema([("band", pa.int64()), ("node", pa.int64())]), VALUES // width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                values, nodes = _matrix(part.column(1)).astype(np.uint64), part.column(0).to_numpy()
                out = []
                for band in range(count):
                    h = np.full(len(nodes), band + 1, dtype=np.uint64)
                    for j in range(band * width, band * width + width):
                        h = S.mix(h * np.uint64(31) + values[:, j])
                    out.append(h)
                yield S.batch_of(schema, S.signed(np.concatenate(out)), np.tile(nodes, count))

    return run


def least_matches(threshold: float, miss: float) -> dict[int, int]:
    """For n compared values, the least matches with which a pair goes on."""
    out = {}
    for n in range(BATCH, VALUES + 1, BATCH):
        chance = 0.0
        for m in range(n + 1):
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= miss:
                out[n] = m
                break
    return out


def _prune(threshold: float, miss: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    needs = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x, y = _matrix(batch.column(2)), _matrix(batch.column(3))
            alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
            for n, least in needs.items():
                cols = slice(n - BATCH, n)
                matches = matches + (x[alive, cols] == y[alive, cols]).sum(axis=1)
                keep = matches >= least
                alive, matches = alive[keep], matches[keep]
            yield S.batch_of(schema, a[alive], b[alive])

    return run


def _exact(size: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def one(column: pa.Array, k: int) -> np.ndarray:
        data = np.frombuffer((column[k].as_py() or "").encode(), dtype=np.uint8)
        return shingle_rows(data, np.array([0, len(data)]), size)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, np.ndarray] = (None, np.zeros(0))
        for batch in batches:
            a, b, keep = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            for k in range(len(a)):
                if held[0] != a[k]:
                    held = (a[k], one(batch.column(2), k))
                x, y = held[1], one(batch.column(3), k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            yield S.batch_of(schema, a[keep], b[keep])

    return run


def _met(sig: np.ndarray, sigs: np.ndarray, needs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The places of the signatures that go on against sig, and how many values they have equal."""
    alive, matches = np.arange(len(sigs)), np.zeros(len(sigs), dtype=np.int64)
    for n, least in needs.items():
        cols = slice(n - BATCH, n)
        matches = matches + (sigs[alive, cols] == sig[cols]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive, matches


def _sides(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of queries and of targets of each cluster in a group."""
    cluster, query = table["cluster"].to_numpy(), table["query"].to_numpy()
    order = np.argsort(cluster, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
        yield rows[query[rows]], rows[~query[rows]]


def _in_play(percent: int, miss: float):
    """The rows of a group that go on, by their signatures, with a row of another component."""
    needs = least_matches(percent / 100, miss)

    def run(table: pa.Table) -> pa.Table:
        sigs, root, held = _matrix(table["sig"]), table["root"].to_numpy(), np.zeros(len(table), dtype=bool)
        for queries, targets in _sides(table):
            theirs = sigs[targets]
            for q in queries:
                others = targets[_met(sigs[q], theirs, needs)[0]]
                others = others[root[others] != root[q]]
                held[others] = True
                held[q] = len(others) > 0
        return table.filter(pa.array(held))

    return run


def _cluster_links(size: int, percent: int, miss: float):
    """Links of the queries of each cluster in a group with targets of other components."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    needs = least_matches(percent / 100, miss)

    def run(table: pa.Table) -> pa.Table:
        sigs, texts, found = _matrix(table["sig"]), table["text"], []
        node, root = table["node"].to_numpy(), table["root"].to_numpy()
        for queries, targets in _sides(table):
            theirs, sets, parent = sigs[targets], {}, {}

            def shingles(k: int, sets=sets) -> np.ndarray:
                if k not in sets:
                    data = np.frombuffer((texts[int(k)].as_py() or "").encode(), dtype=np.uint8)
                    sets[k] = shingle_rows(data, np.array([0, len(data)]), size)[0]
                return sets[k]

            def find(r: int, parent=parent) -> int:
                while parent.get(r, r) != r:
                    r = parent[r]
                return r

            for q in queries:
                alive, matches = _met(sigs[q], theirs, needs)
                for k in targets[alive[np.argsort(-matches, kind="stable")]]:
                    a, b = find(root[q]), find(root[k])
                    if a == b:
                        continue
                    x, y = shingles(q), shingles(k)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        parent[max(a, b)] = min(a, b)
                        found.append((node[q], node[k]))
        return pa.table([[x for x, _ in found], [y for _, y in found]], schema=schema)

    return run


def _blocks(state: DataFrame) -> DataFrame:
    """state(node, root, cluster) dealt to blocks: task_key, and whether the row is a query there or a
    target. Small clusters share groups; a large one is a grid of query blocks and target blocks."""
    parts = state.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("size"))
    small = F.col("size") <= QUERIES
    blocks = [F.when(small, 1).otherwise(F.ceil(n / per)).cast("long") for n, per in ((F.col("size") - F.col("most.n"), QUERIES), (F.col("size"), TARGETS))]
    main = main.select("cluster", small.alias("small"), F.col("most.root").alias("main"), blocks[0].alias("i_end"), blocks[1].alias("j_end"))
    rows = state.join(main, "cluster")

    def dealt(rows: DataFrame, own: str, others: str, query: bool) -> DataFrame:
        own_block = F.pmod(F.xxhash64("node", F.lit(own)), F.col(f"{own}_end")).alias(own)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{others}_end") - 1)).alias(others)
        key = F.when(F.col("small"), F.pmod(F.xxhash64("cluster"), F.lit(SMALL_GROUPS))).otherwise(F.xxhash64("cluster", "i", "j").bitwiseOR(F.lit(SMALL_GROUPS)))
        return rows.select("*", own_block, every).select(key.alias("task_key"), "cluster", "node", "root", F.lit(query).alias("query"))

    # a cluster of one component has no queries, and needs no targets
    return dealt(rows.filter("root != main"), "i", "j", True).union(dealt(rows.filter("i_end > 0"), "j", "i", False))


def _named(nodes: DataFrame) -> DataFrame:
    """nodes with their name, node: doc_id, or one above all ids where several texts have this doc_id."""
    twice = cut(nodes.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("twice")), "twice")
    if twice.isEmpty():
        return nodes.withColumn("node", F.col("doc_id"))
    fresh = F.xxhash64("key").bitwiseAND(F.lit(FRESH - 1)) + F.lit(FRESH)
    return nodes.join(twice, "doc_id", "left").withColumn("node", F.when(F.col("twice"), fresh).otherwise(F.col("doc_id"))).drop("twice")


def _same_document(placed: DataFrame) -> DataFrame:
    """Links of each doc_id that has several texts, or whose text isn't named by an id, with its texts."""
    mixed = placed.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter(f"lo < hi or hi >= {FRESH}").select("doc_id")
    return placed.join(mixed, "doc_id").filter("node is not null").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()


def near_links(docs: DataFrame, percent: int = 85, size: int = 5, miss: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """Two tables: every row's doc_id, n_shingles and node (null without words), and node, root for
    nodes that hang on a smaller root. See near_dedup."""
    texts = docs.select(id_in(), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    base = cut(texts.mapInArrow(_sketch(size), "doc_id long, h long, n_shingles long, key binary, sig binary"), "sketches")
    nodes = base.filter("sig is not null").groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.any_value("sig").alias("sig"))
    nodes = cut(_named(cut(nodes.select("key", "least.*", "sig"), "texts")), "nodes")
    placed = cut(base.join(nodes.select("key", "node"), "key", "left").select("doc_id", "n_shingles", "node"), "placed")
    sigs = nodes.select("node", "sig")
    bands = sigs.mapInArrow(_bands(width(percent)), "band long, node long")
    crowd = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut(bands.join(crowd, "band"), "members")
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    members = cut(members.join(company, "node"), "members")
    # by merge at every size: the texts would else move only where the ids are too many to broadcast
    asked = nodes.select("node", "doc_id", "h").join(members.select("node").distinct(), "node")
    bodies = cut(texts.join(asked.hint("merge"), ["doc_id", "h"]).groupBy("node").agg(F.max("text").alias("text")), "bodies")

    pivot = members.groupBy("band").agg(F.max(F.struct("company", "node")).alias("top")).select("band", F.col("top.node").alias("a"))
    pairs = members.join(pivot, "band").filter("node != a").select("a", F.col("node").alias("b")).distinct()
    with_sigs = pairs.hint("merge").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b").join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")).hint("merge"), "a")
    alive = cut(with_sigs.select("a", "b", "sa", "sb").mapInArrow(_prune(percent / 100, miss), "a long, b long"), "alive")
    with_texts = alive.hint("merge").join(bodies.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(bodies.select(F.col("node").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    links = cut(with_texts.select("a", "b", "ta", "tb").mapInArrow(_exact(size, percent), "a long, b long"), "links")
    roots = components(links)

    state = members.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    several = state.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n"), F.min("node").alias("hub")).filter("r0 < r1 and n > 2").select("band", "hub")
    state = cut(state.join(several, "band"), "open")
    clusters = components(state.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    state = state.select("node", "root").distinct().join(clusters.toDF("node", "cluster"), "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    dealt = _blocks(cut(state, "clusters")).join(sigs, "node").select("task_key", "cluster", "node", "root", "query", "sig")
    alive = cut(dealt.groupBy("task_key").applyInArrow(_in_play(percent, miss), dealt.schema), "in_play")
    more = alive.join(bodies, "node").groupBy("task_key").applyInArrow(_cluster_links(size, percent, miss), "a long, b long")
    return placed, components(cut(more.union(roots.toDF("a", "b")).union(_same_document(placed)), "links"))


def near_dedup(docs: DataFrame, percent: int = 85, size: int = 5, miss: float = 1e-5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs. Two documents are linked
    if their sets of distinct `size`-word shingles (A-Z lowered; words are runs without blank or
    \\x09-\\x0D) have 100 * intersection >= percent * union; component_id is the least doc_id that
    links lead to, and kept says that it is the document's own.

    Fewer words than `size` make one shingle of all of them; null, empty and blank texts have
    none and are linked with nothing. A null doc_id sorts before all others. Rows that repeat a
    doc_id, nulls too, are one document: their texts are linked with each other, and whatever is near one of
    them is linked with all. Other columns are ignored; an empty table gives an empty result."""
    base, roots = near_links(docs, percent, size, miss)
    out = base.join(roots, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node", "doc_id").alias("component_id"))
    return out.select(id_out(), "n_shingles", id_out("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))
