"""Operator 7, LM scoring: marginal likelihood over all segmentations of a subword lattice.

The pieces and their scores are those of a public vocabulary; no tokenizer is trained. It is a BPE
model, whose scores are merge ranks (0, -1, -2, ...), so a score becomes a share (rank + b) ** -a.
Part of all weight follows these shares, and part the pieces' counts in the vocabulary's own
segmentation of the training words. a, b and the two parts are those under which the training pieces
are likeliest, each piece left out of its own count (fit_weights); a byte piece, which has no merge,
and a run of blanks rank after all merges. A word is a lattice of pieces over its characters,
with a chain of byte pieces under each character, so that every word has a path; the forward
recursion adds all paths in log space, with a chance to go on after each piece, so that all words
together have mass 1. `score` is the product of the marginals of a text's words, and of one end.
`word_score` is another model beside it: a word as a whole, with its discounted training count, and
its lattice marginal with the mass that the discount (0.5 a word type) set free.

Scale: a block of texts (about 24 MB) emits each of its distinct words once, so hot words are
pre-aggregated; counts and lattice run once per distinct word of the corpus; words with their
values go back to the blocks that hold them, where texts are added up. Only counters and the
piece counts (as many as the vocabulary has) pass through the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import spans as S
from .common import crc_remainder, cut, documents, id_in, id_out

BLOCK_BYTES = 24 << 20
WORDS_A_TASK = 50_000
DISCOUNT = 0.5
#: What fit_weights tries for a and b, and its rounds for the parts.
EXPONENTS, OFFSETS, ROUNDS = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0), (1.0, 10.0, 100.0, 1000.0), 50
#: Longer words go through the lattice one by one.
LONG = 48
MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MODELS: dict = {}


def vocabulary(path: str | None = None):
    if path not in _MODELS:
        import public_tokenizers
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return _MODELS[path]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows' blocks: by task, and by bytes inside a task."""
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 32
    block = size = 0
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        own = []
        for n in pa.compute.binary_length(texts).to_pylist():
            if size and size + (n or 0) > BLOCK_BYTES:
                block, size = block + 1, 0
            size += n or 0
            own.append(base + block)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *batch.columns], names=["block", *batch.schema.names])


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, word, and its count in the block's training texts (0 for others)."""
    schema = pa.schema([("block", pa.int64()), ("word", pa.string()), ("c", pa.int64())])

    def out(block: int, train: Counter, rest: set):
        words = [*train, *(rest - train.keys())]
        for k in range(0, len(words), 100_000):
            part = words[k : k + 100_000]
            yield S.batch_of(schema, [block] * len(part), [w.decode() for w in part], [train.get(w, 0) for w in part])

    block, train, rest = None, Counter(), set()
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for own, held_out, text in zip(columns["block"].to_pylist(), columns["held_out"].to_pylist(), columns["text"], strict=True):
            if own != block:
                if block is not None:
                    yield from out(block, train, rest)
                block, train, rest = own, Counter(), set()
            (rest if held_out else train).update(_tokens(text.as_py()))
    if block is not None:
        yield from out(block, train, rest)


def _piece_counts(path: str | None):
    schema = pa.schema([("piece", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = vocabulary(path), Counter()
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for ids, c in zip(model.encode(words, num_threads=1), n, strict=True):
                for piece in ids:
                    counts[piece] += c
        yield S.batch_of(schema, list(counts), list(counts.values()))

    return run


def piece_ranks(path: str | None) -> np.ndarray:
    """Merge rank of each piece; -1 for pieces that no lattice has (control, unknown)."""
    model = vocabulary(path)
    rank = np.array([-model.get_score(i) for i in range(model.get_piece_size())])
    other = np.array([model.is_control(i) or model.is_unknown(i) for i in range(len(rank))], dtype=bool)
    whole = np.array([model.is_byte(i) or not model.id_to_piece(i).strip(MARK) for i in range(len(rank))], dtype=bool)
    rank[whole] = rank[~whole & ~other].max() + 1
    rank[other] = -1
    return rank


def fit_weights(rank: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, tuple[float, float, float]]:
    """Weights of pieces, which add up to 1, and (a, b, part of the counts). For each a and b the part
    is found by expectation maximisation; without counts a and b are 1 and 10 and the part is 0."""
    held = rank >= 0
    counts = np.where(held, counts, 0).astype(float)
    seen = counts.sum()
    tried = []
    for a in EXPONENTS if seen > 1 else (1.0,):
        for b in OFFSETS if seen > 1 else (10.0,):
            share = np.where(held, np.maximum(rank, 0) + b, np.inf) ** -a
            share /= share.sum()
            part = likelihood = 0.0
            if seen > 1:
                part, own = 0.5, counts > 0
                n, given, others = counts[own], share[own], (counts[own] - 1) / (seen - 1)
                for _ in range(ROUNDS):
                    part = float((n * part * others / ((1 - part) * given + part * others)).sum() / (seen + 1))  # one piece more, from the shares
                likelihood = float((n * np.log((1 - part) * given + part * others)).sum())
            tried.append((likelihood, a, b, part, share))
    _, a, b, part, share = max(tried, key=lambda t: t[0])
    return (1 - part) * share + part * counts / max(1.0, seen), (a, b, part)


class Lattice:
    """Log weights of pieces; marginal() is the log chance of a word over all its segmentations."""

    def __init__(self, path: str | None, weights: np.ndarray, go_on: float):
        model = vocabulary(path)
        self.stop = math.log(1 - go_on) - math.log(go_on)
        self.log, self.byte = {}, [0.0] * 256
        for i, w in enumerate(weights.tolist()):
            if w:
                value = math.log(w) + math.log(go_on)
                if model.is_byte(i):
                    self.byte[int(model.id_to_piece(i)[3:5], 16)] = value
                else:
                    self.log[model.id_to_piece(i)] = value
        self.heads = {piece[:k] for piece in self.log for k in range(1, len(piece))}
        self.tables = {}
        for n in {len(p) for p in self.log}:
            pieces = [p for p in self.log if len(p) == n]
            h = self._sums(np.frombuffer("".join(pieces).encode("utf-32-le"), dtype="<u4").reshape(len(pieces), n))[:, n]
            order = np.argsort(h)
            self.tables[n] = h[order], np.array([self.log[pieces[k]] for k in order])

    @staticmethod
    def _sums(points: np.ndarray) -> np.ndarray:
        """Rolling hashes of the heads of rows of code points."""
        out = np.zeros((points.shape[0], points.shape[1] + 1), dtype=np.uint64)
        for k in range(points.shape[1]):
            out[:, k + 1] = out[:, k] * _BASE + points[:, k] + np.uint64(1)
        return out

    def marginal(self, word: str) -> float:
        """One word, of any length."""
        text, get, heads = MARK + word, self.log.get, self.heads
        n = len(text)
        terms: list[list[float]] = [[] for _ in range(n + 1)]
        terms[0].append(0.0)
        for b in range(n):
            own = terms[b]
            top = max(own)
            a = top if len(own) == 1 else top + math.log(sum(math.exp(x - top) for x in own))
            terms[b] = []
            terms[b + 1].append(a + sum(self.byte[x] for x in text[b].encode()))
            e = b + 1
            while e <= n:
                piece = text[b:e]
                value = get(piece)
                if value is not None:
                    terms[e].append(a + value)
                if piece not in heads:
                    break
                e += 1
        top = max(terms[n])
        return top + math.log(sum(math.exp(x - top) for x in terms[n])) + self.stop

    def _of_length(self, texts: list[str], n: int) -> np.ndarray:
        """The recursion over many words of n characters (the mark included) at once."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").reshape(len(texts), n)
        sums, values = self._sums(points), {}
        for size, (keys, logs) in self.tables.items():
            if size <= n:
                h = sums[:, size:] - sums[:, : n - size + 1] * np.uint64(pow(int(_BASE), size, 1 << 64))
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                values[size] = np.where(keys[at] == h, logs[at], -np.inf)
        chars, place = np.unique(points, return_inverse=True)
        chain = np.array([sum(self.byte[x] for x in chr(c).encode()) for c in chars.tolist()])[place].reshape(points.shape)
        alpha = np.zeros((n + 1, len(texts)))
        for e in range(1, n + 1):
            ways = [alpha[e - 1] + chain[:, e - 1], *(alpha[e - size] + v[:, e - size] for size, v in values.items() if size <= e)]
            top = np.maximum.reduce(ways)
            alpha[e] = top + np.log(sum(np.exp(w - top) for w in ways))
        return alpha[n] + self.stop

    def marginals(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            out[at] = self._of_length([MARK + words[k] for k in at], n + 1) if n <= LONG else [self.marginal(words[k]) for k in at]
        return out


def lattice_parts(path: str | None, counts: dict[int, int], n_words: int) -> tuple[np.ndarray, float]:
    """Weights of the pieces and the chance to go on after one, from the pieces' counts in n_words words."""
    rank = piece_ranks(path)
    n = np.zeros(len(rank))
    n[list(counts)] = list(counts.values())
    n[rank < 0] = 0
    return fit_weights(rank, n)[0], min(0.95, max(0.05, 1 - n_words / (n.sum() + 1)))


def _marginals(path: str | None, weights: np.ndarray, go_on: float):
    schema = pa.schema([("word", pa.string()), ("c", pa.int64()), ("lattice", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = None
        for batch in batches:
            lattice = lattice or Lattice(path, weights, go_on)
            yield S.batch_of(schema, batch.column(0), batch.column(1), lattice.marginals(batch.column(0).to_pylist()))

    return run


def word_scores(c: np.ndarray, lattice: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Log10 chances of words with training counts c and log marginals: base, and whole or lattice."""
    base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    if not n:
        return base, lattice / math.log(10)
    backoff = lattice + math.log(DISCOUNT * v / n)
    whole = np.log(np.maximum(c - DISCOUNT, 0) / n, where=c > 0, out=np.full(len(c), -np.inf))
    return base, np.logaddexp(whole, backoff) / math.log(10)


def _texts_of_block(n: int, v: int, ends: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("word_score", pa.float64())])
    end_base = math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
    end_score = math.log10(ends / n) if ends else end_base

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        c, lattice = words["c"].to_numpy(), words["lattice"].to_numpy()
        base, whole = word_scores(c, lattice, n, v)
        at = {w.encode(): k for k, w in enumerate(words["word"].to_pylist())}
        out = []
        for text in texts["text"]:
            own = np.fromiter((at[w] for w in _tokens(text.as_py())), dtype=np.int64)
            out.append((len(own) + 1, int((c[own] > 0).sum()) + (ends > 0), float(base[own].sum()) + end_base, float(lattice[own].sum()) / math.log(10) + end_score, float(whole[own].sum()) + end_score))
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([texts["doc_id"], texts["held_out"], *(pa.array(x, type=schema.field(i + 2).type) for i, x in enumerate(columns))], schema=schema)

    return run


def lm_scores(docs: DataFrame, held_out, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (the
    lattice marginal) and word_score (whole words beside it) for every row of docs; held_out is a
    boolean Column of docs, and the rows where it is true aren't learned from.

    Words are runs without blank or \\x09-\\x0D, A-Z lowered; null, empty and blank texts are one
    end token. Without training rows every word goes through the lattice and the end has the base
    chance. A null doc_id is kept; rows that repeat a doc_id are counted and scored each. Other
    columns are ignored; an empty table gives an empty result."""
    texts = docs.select(id_in(), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    blocks = cut(texts.mapInArrow(_blocks, "block long, doc_id long, held_out boolean, text string"), "blocks")
    block_words = cut(blocks.mapInArrow(_block_words, "block long, word string, c long"), "block-words")
    words = cut(block_words.groupBy("word").agg(F.sum("c").alias("c")), "words")
    total, types, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.count("*")).first()
    ends = blocks.filter("not held_out").count()
    n, v = total + ends, types + (ends > 0)
    counts = {r.piece: r.n for r in words.filter("c > 0").select("word", "c").mapInArrow(_piece_counts(path), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    # small rows, much work: more tasks than their bytes would make
    values = words.select("word", "c").repartition(1 + distinct // WORDS_A_TASK).mapInArrow(_marginals(path, *lattice_parts(path, counts, total)), "word string, c long, lattice double")
    with_values = block_words.select("block", "word").join(cut(values, "values"), "word")
    scored = blocks.groupBy("block").cogroup(with_values.groupBy("block")).applyInArrow(_texts_of_block(n, v, ends), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, word_score double")
    return scored.select(id_out(), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "word_score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir), crc_remainder(5) == 1)
