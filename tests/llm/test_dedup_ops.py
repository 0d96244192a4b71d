"""Operators 3, 5, 8, 9 and 10 against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from cotejo.llm import components, decontaminate, lines, near, spans, substrings, suffixes
from pyspark.sql import functions as F

from .conftest import by_id


def covered(texts: dict, window: int) -> dict:
    """For sequences by id: the covered mask of each."""
    first: dict = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - window + 1):
            first.setdefault(tuple(texts[i][k : k + window]), i)
    out = {}
    for i, t in texts.items():
        mask = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if first[tuple(t[k : k + window])] < i:
                mask[k : k + window] = b"\1" * window
        out[i] = mask
    return out


def null_id(i):
    return -(2**63) if i is None else i


def test_suffix_dedup(docs, rows):
    texts = {i: t.encode() for i, t in by_id(rows).items()}
    masks = covered(texts, 50)
    got = suffixes.suffix_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        i = null_id(r.doc_id)
        assert bytes(r.kept) == bytes(x for x, m in zip(texts[i], masks[i], strict=True) if not m)
        assert (r.n_bytes, r.n_removed) == (len(texts[i]), sum(masks[i]))
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_merged_transforms_equal_a_full_sort():
    rng = random.Random(1)
    strings = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 40))).encode() for _ in range(40)]
    np = pytest.importorskip("numpy")
    bwts, tails = [], []
    for part in (strings[:17], strings[17:]):
        data = np.frombuffer(b"".join(part), dtype=np.uint8)
        edge = np.cumsum([0, *map(len, part)])
        bwt, sa = suffixes.transform(data, edge)
        bwts.append(bwt)
        joined = b"".join(x + b"\0" for x in part)
        tails += [joined[k:].split(b"\0")[0] for k in sa]
    suffix, block = suffixes.merged_blocks(bwts, 6)
    keys = [tails[k][:6] for k in suffix]
    assert keys == sorted(keys)
    whole = [(k, b) for k, b in zip(keys, block.tolist(), strict=True) if len(k) == 6]
    assert len({k for k, _ in whole}) == len({b for _, b in whole}) == len(set(whole))


def test_substring_dedup(docs, rows):
    texts = {i: t.encode().split() for i, t in by_id(rows).items()}
    masks = covered(texts, 50)
    got = substrings.substring_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        i = null_id(r.doc_id)
        assert r.kept.encode() == b" ".join(x for x, m in zip(texts[i], masks[i], strict=True) if not m)
        assert (r.n_words, r.n_removed) == (len(texts[i]), sum(masks[i]))


def test_difference_cover():
    differences = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert differences == set(range(substrings.PERIOD))


def shingle_sets(rows, size=5):
    out = {}
    for i, t in by_id(rows).items():
        w = t.encode().lower().split()
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def groups(sets, percent=85):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_dedup(docs, rows):
    sets = shingle_sets(rows)
    root = groups(sets)
    got = near.near_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        i = null_id(r.doc_id)
        assert (r.n_shingles, null_id(r.component_id), r.kept) == (len(sets[i]), root[i], root[i] == i)


@pytest.mark.parametrize("twice", [5, None])
def test_near_dedup_of_repeated_ids(spark, twice):
    """Rows that repeat an id with different texts link what is near any of them."""
    rng = random.Random(9)
    a, b, c, d = ([f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(4))
    near_a, near_b = a[:-1] + ["other"], b[:-1] + ["other"]
    rows = [(twice, a), (twice, b), (7, near_a), (8, near_b), (9, c), (12, d), (12, c), (12, []), (13, d), (20, a), (21, d[:-1] + ["x"])]
    got = near.near_dedup(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()
    root = {twice: twice, 7: twice, 8: twice, 9: 9, 12: 9, 13: 9, 20: twice, 21: 9}
    assert sorted((null_id(r.doc_id), r.n_shingles, null_id(r.component_id)) for r in got if r.n_shingles) == sorted((null_id(i), 76, null_id(root[i])) for i, t in rows if t)
    assert {r.doc_id for r in got if r.kept and r.n_shingles} == {twice, 9}


@pytest.mark.parametrize(("queries", "targets"), [(near.QUERIES, near.TARGETS), (8, 32)])
def test_near_dedup_of_a_hot_group(spark, monkeypatch, queries, targets):
    """Many near copies at all distances from a base: chains, stragglers, several components; also
    where a cluster is a grid of many small blocks."""
    monkeypatch.setattr(near, "QUERIES", queries)
    monkeypatch.setattr(near, "TARGETS", targets)
    rng = random.Random(9)
    base = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(150)] = f"z{i}x{rng.randrange(9)}"
        rows.append((1000 - i, " ".join(words)))
    root = groups(shingle_sets(rows))
    got = near.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == root
    assert 1 < len(set(root.values())) < 300


def test_least_matches_is_a_posterior_bound():
    needs = near.least_matches(0.85, 1e-5)
    assert all(needs[n] <= 0.85 * n for n in needs) and needs[128] > 85


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100}


def near_lines(texts: dict) -> set:
    """(id, line) of the lines that an earlier line nearly equals, in order of ids."""
    seen, gone = [], set()
    for i in sorted(texts):
        for k, line in enumerate(texts[i].split("\n")):
            w = [x.decode() for x in line.encode().split()]
            own = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
            if any(not own.isdisjoint(x) and 5 * len(own & x) >= 4 * len(own | x) for x in seen):
                gone.add((i, k))
            if own:
                seen.append(own)
    return gone


def item_words(text) -> list[str]:
    plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain)


def item_windows(items) -> dict:
    """The ids of the items that have a window of words."""
    out = defaultdict(set)
    for i, t in items:
        w = item_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            out[tuple(w[k : k + 10])].add(i)
    return out


def benchmark_hits(text, windows: dict) -> tuple[int, set, set]:
    """Number of words, places of those hit, and ids of the items found."""
    w, hit, found = item_words(text), set(), set()
    for size in {len(x) for x in windows}:
        for k in range(len(w) - size + 1):
            if (own := tuple(w[k : k + size])) in windows:
                hit |= set(range(k, k + size))
                found |= windows[own]
    return len(w), hit, found


def test_line_dedup(docs, rows):
    gone = near_lines(by_id(rows))
    got = lines.line_dedup(docs).collect()
    assert len(got) == len(rows)
    null_texts = {null_id(i) for i, t, *_ in rows if t is None}
    for r in got:
        i = null_id(r.doc_id)
        if i in null_texts:
            assert (r.n_lines, r.removed, r.kept) == (0, [], None)
            continue
        parts = by_id(rows)[i].split("\n")
        assert r.removed == [k for k in range(len(parts)) if (i, k) in gone]
        assert r.kept == "\n".join(p for k, p in enumerate(parts) if (i, k) not in gone)
    assert gone


def test_contamination(spark, docs, rows):
    texts = by_id(rows)
    long = next(t for t in texts.values() if len(t) > 9000).split()
    items = [(1, " ".join(long[100:112])), (2, "Uno-DOS"), (3, ""), (4, None), (5, "no such words"), (None, " ".join(long[5:30])), (6, " ".join(long[100:112]) + " zzz")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    windows = item_windows(items)
    got = decontaminate.contamination(docs, bench).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, found = benchmark_hits(texts[null_id(r.doc_id)], windows)
        assert (r.n_words, r.n_hit, r["items"]) == (n, len(hit), sorted(str(x) for x in found if x is not None))


def test_empty_tables(spark, docs, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert suffixes.suffix_dedup(nothing).count() == 0
    assert substrings.substring_dedup(nothing).count() == 0
    assert near.near_dedup(nothing).count() == 0
    assert lines.line_dedup(nothing).count() == 0
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert decontaminate.contamination(docs, bench).filter("n_hit > 0").count() == 0


def test_word_spans_never_cross_rows():
    pa = pytest.importorskip("pyarrow")
    batch = pa.RecordBatch.from_pydict({"text": ["ab cd", None, "ef", "", " g"]})
    (_, data, offsets), *_ = list(spans.text_parts(batch))
    start, end, first = spans.words(data, offsets, spans.SPACE)
    assert [bytes(data[a:b]) for a, b in zip(start, end, strict=True)] == [b"ab", b"cd", b"ef", b"g"]
    assert first.tolist() == [0, 2, 2, 3, 3, 4]


def test_line_dedup_of_short_lines(spark):
    rng = random.Random(12)
    some = ["All rights reserved.", "one", "a\tb\tc\td\te\tf g", "a b c d e f g", "保留所有权利。", "  one ", "two one", "", " \t", "one two three four", "one two three four five\r"]
    texts = {i: "\n".join(rng.choice(some) + ("x" if rng.random() < 0.2 else "") for _ in range(rng.randrange(1, 9))) for i in range(60)}
    seen: list[set] = []
    gone = defaultdict(list)
    for i, t in sorted(texts.items()):
        for k, line in enumerate(t.split("\n")):
            w = line.encode().split()
            x = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
            if x and any(5 * len(x & y) >= 4 * len(x | y) for y in seen):
                gone[i].append(k)
            elif x:
                seen.append(x)
    got = lines.removed_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed for r in got} == gone
    assert len({texts[i].split("\n")[k] for i in gone for k in gone[i]}) > 8


def edited_lines(rng) -> dict:
    """Texts of lines and their edited copies at all distances; among them lines of few different words, long ones, and a passage in many."""
    passage = [f"p{k}" for k in range(12)]

    def line(n, words):
        return [f"w{rng.randrange(words)}" for _ in range(n)]

    bases = [line(n, words) for n in (3, 6, 9, 14, 30, 60) for words in (8, 10**6)] + [line(300, 2), line(700, 10**6), line(4300, 10**6)]
    bases += [passage + line(n, 10**6) for n in (3, 6, 12, 40) for _ in range(6)]
    out = {}
    for i in range(40):
        parts = []
        for base in rng.sample(bases, 6):
            copy = list(base)
            for _ in range(rng.randrange(0, 2 + len(copy) // 12)):
                k = rng.randrange(len(copy))
                copy[k : k + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"] * rng.randrange(2)
            cut = rng.choice([0, 0, len(copy) // 10, len(copy) // 5])
            parts.append(" ".join(copy[cut:] if rng.random() < 0.5 else copy[: len(copy) - cut]))
        out[i] = "\n".join(parts)
    return out


@pytest.mark.parametrize("cold", [1, 4, 64])
def test_line_dedup_of_pairs_and_of_hot_tokens(spark, monkeypatch, cold):
    """Lines of a token are paired at once, or, where there are more than COLD, ordered by rarity first."""
    monkeypatch.setattr(lines, "COLD", cold)
    texts = edited_lines(random.Random(21))
    want = defaultdict(list)
    for i, k in sorted(near_lines(texts)):
        want[i].append(k)
    got = lines.removed_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed for r in got} == want
    assert 30 < sum(map(len, want.values())) < 200


def test_lines_that_can_not_match_get_no_sets(spark, monkeypatch):
    """Lines that share a passage, but not their length, leave before their texts are read again."""
    asked, sets = [], lines._sets

    def seen(texts, company, *rest):
        asked.append(sorted(r.doc_id for r in company.select("doc_id").collect()))
        return sets(texts, company, *rest)

    monkeypatch.setattr(lines, "_sets", seen)
    passage = [f"p{k}" for k in range(16)]
    texts = {n: " ".join(passage + [f"w{n}x{k}" for k in range(n)]) for n in (0, 100, 1000)}
    texts[2000] = texts[100] + " more"
    got = lines.removed_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert [(r.doc_id, r.removed) for r in got] == [(2000, [0])]
    assert asked == [[100, 2000]]


def test_kept_lines_hold_a_text_once(docs):
    removed = lines.removed_lines(docs)
    assert "text" not in lines.without_lines(docs, removed).schema["row"].dataType.names
