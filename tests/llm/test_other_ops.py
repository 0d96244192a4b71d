"""Operators 1, 2, 4, 6 and 7, and the pipeline: brute force, round trips, held-out accuracy."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from cotejo.llm import common, langid, lm_score, packing, queries, sharding, syncmers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .conftest import by_id


def test_sharding(docs, rows):
    got = sharding.propagate(docs).collect()
    assert len(got) == len(rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1 and set(shards) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    texts = Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    assert texts == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)


def test_sharding_keeps_copies_together(spark):
    rows = [(i, f"text {i if i >= 300 else i // 3}") for i in range(1000)] + [(i, "hot") for i in range(1000, 1500)]
    got = sharding.propagate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text, where = dict(rows), defaultdict(Counter)
    for r in got:
        where[text[r.doc_id]][r.shard] += 1
    spread = [len(where[f"text {k}"]) for k in range(100)]
    assert sum(spread) / 100 < 1.2 and sum(n for _, n in where["hot"].most_common(3)) > 425
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1

    def cut_edges(shard):
        """Pairs of equal texts in different shards, among the groups of three."""
        own = defaultdict(list)
        for i, t in rows:
            own[t].append(shard[i])
        return sum(a != b for k in range(100) for a, b in itertools.combinations(own[f"text {k}"], 2))

    assert cut_edges({r.doc_id: r.shard for r in got}) < 0.2 * cut_edges({i: i % 8 for i, _ in rows})


def test_sharding_query(spark, sf_dir):
    got = queries.QUERIES["op1_sharding"](spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in common.documents(spark, sf_dir).select("doc_id").collect())
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def test_fingerprints(docs, rows):
    texts = by_id(rows)
    order = sorted(texts, reverse=True)
    got = {(-(2**63) if r.doc_id is None else r.doc_id): r for r in syncmers.fingerprints(docs).collect()}
    assert set(got) == set(texts)
    for k, i in enumerate(order):
        t, nxt = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert len(got[i].hashes) >= bool(words(t))
    same = defaultdict(set)
    for i, r in got.items():
        same[texts[i]].add(tuple(r.hashes))
    assert all(len(v) == 1 for v in same.values())


def test_fingerprints_over_again(docs, rows):
    """Syncmers, sketch and likeness in plain Python, on Spark's hashes of words and of runs of hashes."""
    texts = by_id(rows)
    got = {(-(2**63) if r.doc_id is None else r.doc_id): r for r in syncmers.fingerprints(docs).collect()}
    spark = docs.sparkSession
    order = sorted(texts, reverse=True)
    edited = {i: texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[order[(k + 1) % len(order)]][: len(texts[i]) // 2] for k, i in enumerate(order)}
    every = sorted({w for t in [*texts.values(), *edited.values()] for w in words(t)})
    of = {r.w: r.h for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    runs = set()
    for t in [*texts.values(), *edited.values()]:
        h = [of[w] for w in words(t)]
        runs |= {tuple(h[k : k + n]) for n in (2, 4) for k in range(len(h) - n + 1)}
        runs |= {tuple(h)} if 0 < len(h) else set()
    hashed = {}
    for n in {len(r) for r in runs}:
        own = [r for r in runs if len(r) == n]
        df = spark.createDataFrame([(list(r),) for r in own], "h array<long>")
        few = F.xxhash64("h")
        exact = F.xxhash64(*(F.get("h", F.lit(j)) for j in range(n))) if n in (2, 4) else few
        for r, x in zip(own, df.select(exact.alias("a"), few.alias("b")).collect(), strict=True):
            hashed[r] = x.a
            hashed[r, "all"] = x.b

    def sketch(t):
        h = tuple(of[w] for w in words(t))
        chosen = set()
        for k in range(len(h) - 3):
            inner = [hashed[h[k + j : k + j + 2]] for j in range(3)]
            if min(inner[0], inner[2]) <= inner[1]:
                chosen.add(hashed[h[k : k + 4]])
        return sorted(chosen or ({hashed[h, "all"]} if h else set()))[:64]

    def like(a, b):
        union = sorted({*a, *b})[:64]
        return sum(x in a and x in b for x in union) / len(union) if union else 1.0

    for k, i in enumerate(order):
        a, b, c = sketch(texts[i]), sketch(edited[i]), sketch(texts[order[(k + 1) % len(order)]])
        assert (got[i].hashes, got[i].edited_hashes) == (a, b)
        assert got[i].near_edited == pytest.approx(like(a, b)) and got[i].near_next == pytest.approx(like(a, c))
    long = [i for i in order if len(words(texts[i])) > 30]
    assert sum(got[i].near_edited > got[i].near_next for i in long) > 0.5 * len(long)


def test_anchors_are_closed_syncmers_in_any_context(spark):
    rng = random.Random(2)
    passage = [f"w{rng.randrange(99)}" for _ in range(40)]
    texts = [" ".join(passage), " ".join(["a", "b"] + passage + ["c"])]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    a, b = (r.x for r in df.select("k", syncmers.anchors(syncmers.word_hashes(F.col("t"))).alias("x")).orderBy("k").collect())
    shared = {(x.pos + 2, x.hash) for x in a} & {(x.pos, x.hash) for x in b}
    assert len(shared) == len(a) >= (40 - syncmers.K + 1) // (syncmers.K - syncmers.INNER + 1)
    gaps = sorted(x.pos for x in a)
    assert max(q - p for p, q in zip(gaps, gaps[1:], strict=False)) <= syncmers.K - syncmers.INNER + 1


def test_packing(docs, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, capacity=64, with_ids=True).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, packing.END]
        copies = sum(x[0] == i for x in rows)
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in pieces[i]})
        assert len(pieces[i]) == copies * len(own)
        assert [x for p in own for x in p[4]] == ids and [p[0] for p in own] == list(range(len(own)))
        assert all(p[3] == zlib.crc32(np.array(p[4], dtype="<u4").tobytes()) and p[2] == len(p[4]) for p in own)
        assert all(p[2] == 64 for p in own[1:])
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64


def test_encoder_equals_the_tokenizers_file():
    """Random strings of all kinds of characters, with blanks, the added token and parts of it."""
    tok, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(6)
    kinds = [range(32, 127), range(0, 33), range(0xA0, 0x250), range(0x370, 0x530), range(0x590, 0x700), range(0x900, 0xA00), range(0x2000, 0x2070), range(0x3040, 0x30FF), range(0x4E00, 0x9000), range(0x1F300, 0x1F700), range(0x300, 0x370)]
    words = ["<|endoftext|>", "<|endof", "text|>", "'s", " 're", "  ", "\n\n", "\r\n", "the", " The", "123", " 4567"]

    def text():
        parts = [rng.choice(words) if rng.random() < 0.5 else "".join(chr(rng.choice(rng.choice(kinds))) for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(12))]
        return "".join(parts)

    texts = [text() for _ in range(4000)]
    encode = packing.encoder().encode
    for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(t, allowed_special="all") == e.ids


def test_packing_needs_few_sequences(spark):
    """Every length, ties and repeats, in order of arrival, against the least possible number."""
    rng = random.Random(11)
    rows = [(k, " a" * (rng.randrange(1, 90) if k % 3 else 20)) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for open_bins in (packing.OPEN_BINS, 200):
        got = packing.pack(docs, capacity=100, open_bins=open_bins).select("sequence_id", "length").collect()
        assert len({r.sequence_id for r in got}) <= (1.05 if open_bins > 200 else 1.2) * math.ceil(sum(r.length for r in got) / 100)


def test_best_fit_bins():
    rng = random.Random(4)
    lengths = sorted((rng.randrange(1, 100) for _ in range(2000)), reverse=True)
    for open_bins in (3, 4000):
        where, offset = packing.best_fit(lengths, 100, open_bins)
        filled = defaultdict(int)
        for n, b, o in zip(lengths, where, offset, strict=True):
            assert o == filled[b] and o + n <= 100
            filled[b] += n
    assert len(filled) <= 1.01 * math.ceil(sum(lengths) / 100)


def test_language_id(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    model = langid.train(docs.filter(~langid.held_out()))
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.held_out()).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_id_edges(spark, docs, rows, nothing):
    model = langid.train(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    letters = Counter(langid.UNKNOWN if not any(c.isalpha() for c in t or "") else "en" for _, t, *_ in rows)
    assert Counter(r.lang_pred for r in got) == letters
    assert {r.lang_pred for r in langid.identify(docs, langid.train(nothing)).collect()} == {langid.UNKNOWN}
    assert langid.identify(nothing, model).count() == 0
    digits = spark.createDataFrame([(1, "12 34"), (2, "Ж1"), (3, None)], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(digits, model).orderBy("doc_id").collect()] == ["und", "en", "und"]


def test_lm_scores(docs, rows):
    held = common.crc_remainder(5) == 1

    def out(i):
        return zlib.crc32(str("" if i is None else i).encode()) % 5 == 1

    tokens = [(i, (t or "").encode().lower().split()) for i, t, *_ in rows]
    counts, ends = Counter(), 0
    for i, w in tokens:
        if not out(i):
            counts.update(w)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    expected = Counter()
    for i, w in tokens:
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        expected[i, out(i), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, round(base, 6)] += 1
    got = lm_score.lm_scores(docs, held).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    # the model over again: counts of the vocabulary's own pieces, and every word by itself
    segmented = Counter()
    for w, c in counts.items():
        for piece in lm_score.vocabulary().encode(w.decode()):
            segmented[piece] += c
    lattice, end = lm_score.Lattice(None, *lm_score.lattice_parts(None, segmented, n - ends)), math.log10(ends / n)
    own = {i: w for i, w in tokens}
    for r in got:
        marginals = [lattice.marginal(x.decode()) for x in own[r.doc_id]]
        assert r.score == pytest.approx(sum(marginals) / math.log(10) + end)
        whole = [math.log10((counts[x] - 0.5) / n + math.exp(m) * 0.5 * v / n) if counts[x] else (m + math.log(0.5 * v / n)) / math.log(10) for x, m in zip(own[r.doc_id], marginals, strict=True)]
        assert r.word_score == pytest.approx(sum(whole) + end)


def test_lattice_sums_over_all_segmentations():
    lattice = lm_score.Lattice(None, *lm_score.lattice_parts(None, {5: 10, 300: 4}, 10))

    def every(text):
        """All ways to cut a text into pieces and chains of byte pieces."""
        if not text:
            return [0.0]
        ways = [sum(lattice.byte[x] for x in text[0].encode()) + rest for rest in every(text[1:])]
        for k in range(1, len(text) + 1):
            if text[:k] in lattice.log:
                ways += [lattice.log[text[:k]] + rest for rest in every(text[k:])]
        return ways

    for word in ("a", "the", "niño", "x9"):
        total = math.log(sum(math.exp(w) for w in every(lm_score.MARK + word))) + lattice.stop
        assert lattice.marginal(word) == pytest.approx(total)
    rng = random.Random(7)
    many = ["".join(rng.choice("aetnño中🙂<x0") for _ in range(rng.randrange(1, 60))) for _ in range(400)] + ["information", "the", "niño"]
    assert lattice.marginals(many).tolist() == pytest.approx([lattice.marginal(w) for w in many])


def test_lattice_weights():
    """The weight formula over again, in plain Python; a, b and the part are the likeliest of those near."""
    model, rng = lm_score.vocabulary(), random.Random(5)
    rank = lm_score.piece_ranks(None)
    merges = [i for i in range(len(rank)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and model.id_to_piece(i).strip("▁")]
    assert [rank[i] for i in merges] == [-model.get_score(i) for i in merges]
    last = 1 + max(rank[i] for i in merges)
    assert all(rank[i] == (-1 if model.is_control(i) or model.is_unknown(i) else last) for i in set(range(len(rank))) - set(merges))
    counts = np.zeros(len(rank))
    for _ in range(20_000):
        counts[merges[min(len(merges) - 1, int(rng.paretovariate(0.6)))]] += 1
    weights, (a, b, part) = lm_score.fit_weights(rank, counts)
    seen = sum(counts)

    def weight(a, b, part, left_out):
        shares = [(r + b) ** -a if r >= 0 else 0.0 for r in rank.tolist()]
        mass = sum(shares)
        return [(1 - part) * s / mass + part * max(0.0, c - left_out) / (seen - left_out) for s, c in zip(shares, counts.tolist(), strict=True)]

    assert weights.tolist() == pytest.approx(weight(a, b, part, 0)) and sum(weights) == pytest.approx(1)

    def likelihood(*parts):
        return sum(c * math.log(w) for c, w in zip(counts.tolist(), weight(*parts, 1), strict=True) if c)

    best = likelihood(a, b, part)
    assert 0 < part < 1 and best > likelihood(a, b, part * 0.97) and best > likelihood(a, b, part + 0.03 * (1 - part))
    assert all(best >= likelihood(x, y, part) - 1e-6 for x in lm_score.EXPONENTS for y in lm_score.OFFSETS)
    assert lm_score.fit_weights(rank, np.zeros(len(rank)))[1] == (1.0, 10.0, 0.0)
    one = np.zeros(len(rank))
    one[merges[7]] = 50  # a single piece in all words: the others keep some weight
    assert lm_score.fit_weights(rank, one)[0][merges].min() > 0


def test_empty_tables(nothing):
    assert sharding.propagate(nothing).count() == 0
    assert syncmers.fingerprints(nothing).count() == 0
    assert packing.pack(nothing).count() == 0
    assert lm_score.lm_scores(nothing, common.crc_remainder(5) == 1).count() == 0


def test_pipeline_stages(spark, sf_dir):
    """Each stage on what the one before kept: the rows and texts that brute force keeps of its input."""
    from .test_dedup_ops import benchmark_hits, groups, item_windows, near_lines, shingle_sets

    docs = common.documents(spark, sf_dir)
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.cut(stage(spark, docs, sf_dir), name)
        if name != names[-1]:
            assert docs.columns == columns
        kept[name] = [r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()]

    def same(name, expected):
        key = repr
        assert sorted(kept[name][1], key=key) == sorted(expected, key=key)

    before, _ = kept["language_id"]
    same("language_id", [r for r in before if any(c.isalpha() for c in r["text"] or "")])
    before, _ = kept["line_dedup"]
    gone, expected = near_lines({r["doc_id"]: r["text"] for r in before}), []
    for r in before:
        lines = r["text"].split("\n")
        left = [x for k, x in enumerate(lines) if (r["doc_id"], k) not in gone]
        if len(left) == len(lines) or "".join(left).strip():
            expected.append(r | {"text": "\n".join(left), "n_chars": len("\n".join(left))})
    assert gone
    same("line_dedup", expected)
    before, after = kept["near_dedup"]
    root = groups(shingle_sets([(r["doc_id"], r["text"]) for r in before]), 80)
    same("near_dedup", [r for r in before if root[r["doc_id"]] == r["doc_id"]])
    # line dedup leaves no near copies in these tables, so the stage also takes what came before it
    before = kept["line_dedup"][0]
    root = groups(shingle_sets([(r["doc_id"], r["text"]) for r in before]), 80)
    given = common.documents(spark, sf_dir).filter(F.col("text").rlike(r"\p{L}"))
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, given, sf_dir).collect()}
    assert left == {i for i in root if root[i] == i} and len(left) < len(before)
    before, after = kept["decontamination"]
    windows = item_windows([(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    assert len(after) < len(before)
    same("decontamination", [r for r in before if not benchmark_hits(r["text"], windows)[1]])
    before, after = kept[names[-1]]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths, used = Counter(), Counter()
    for r in after:
        lengths[r["doc_id"]] += r["length"]
        used[r["sequence_id"]] += r["length"]
    assert lengths == {r["doc_id"]: 1 + len(tokenizer.encode(r["text"], add_special_tokens=False).ids) for r in before}
    assert max(used.values()) <= 1024 and len(used) < 1.1 * sum(used.values()) / 1024 + 2


def test_pipeline_edges(spark, docs, nothing, sf_dir):
    own = ("_id", "_lang", "_score", "_lines", "_parts", "_key", "_removed", "row", "kept", "removed", "lang_pred", "score", "score_", "text_hash", "line_no")
    clash = docs.drop(*own).select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in own))
    for given in (clash.withColumn("source", F.lit(None).cast("string")), nothing):
        out = given
        for _, stage in corpus_pipeline.STAGES:
            out = common.cut(stage(spark, out, sf_dir), "edges")
            if given is not nothing and "_key" in out.columns:
                assert out.columns == given.columns and out.filter(F.concat_ws(",", *own) != F.concat_ws(",", *(F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in own))).count() == 0
        assert out.count() == 0 if given is nothing else out.count() > 10


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline"} == set(range(1, 14))


def test_pipeline_near_dedup_at_80(spark):
    """Copies of bases at similarities around 0.8 and 0.85."""
    from .test_dedup_ops import groups, shingle_sets

    rng, rows = random.Random(8), []
    for b in range(40):
        base = [f"w{rng.randrange(9999)}" for _ in range(200)]
        rows.append((2 * b, " ".join(base)))
        for k in rng.sample(range(2, 198), 1 + b % 6):
            base[k] += "x"
        rows.append((2 * b + 1, " ".join(base)))
    sets = shingle_sets(rows)
    root = groups(sets, 80)
    assert root != groups(sets)
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {r.doc_id for r in got} == {i for i in root if root[i] == i}


def test_pipeline_line_dedup_takes_short_lines(spark):
    docs = spark.createDataFrame([(1, "first\nAll rights reserved.", 0), (2, "second\nAll rights reserved.", 0), (3, "first", 0)], "doc_id long, text string, n_chars long")
    got = corpus_pipeline.line_dedup(spark, docs, "").collect()
    assert {r.doc_id: r.text for r in got} == {1: "first\nAll rights reserved.", 2: "second"}


def test_packing_finds_the_added_token_in_texts(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n y<|endoftext|", "<|END|> <|endoftext |>"]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    assert {r.doc_id: r.ids for r in got} == {k: [*tok.encode(t, add_special_tokens=False).ids, packing.END] for k, t in enumerate(texts)}
    assert any(50256 in r.ids for r in got)


def test_language_id_learns_every_label(spark):
    rng, rows = random.Random(5), []
    for k in range(64):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(6)]
        rows += [(None if j else k, " ".join(rng.choice(own) for _ in range(40)), f"x{k}") for j in range(4 if k % 2 else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.label(docs, langid.train(docs)).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.lang for r in got)
