"""Retrieval by bounds against plain scoring of every row."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from cotejo.operators import resolve
from cotejo.plans import registry

CATALOG = "source string, ord int, titulo string, autor string, year int"


def plain(queries, catalog, limit):
    """sub_id, source and ord of the best rows, in order."""
    held = {(s, o): set((t or "").split() + (a or "").split()) for s, o, t, a, _ in catalog}
    df = Counter(w for words in held.values() for w in words)
    out = {}
    for sub, query in queries:
        words = [w for w in dict.fromkeys((query or "").split()) if w in df]
        scored = defaultdict(list)
        for (source, ord_), own in held.items():
            score = sum(math.floor(1000 * math.log(1 + len(held) / df[w])) for w in words if w in own)
            if score:
                scored[source].append((-score, ord_))
        for source, rows in scored.items():
            out[sub, source] = [o for _, o in sorted(rows)[:limit]]
    return out


@pytest.mark.parametrize("stored", [False, True])
def test_retrieve_equals_plain_scores(spark, stored):
    rng = random.Random(3)
    # a few very common words, a long tail, repeated rows, one source that is nearly empty
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    catalog = []
    for k in range(900):
        titulo = " ".join(rng.sample(words, rng.randrange(0, 6)) + ["common"] * (k % 3 != 0))
        catalog.append((resolve.SOURCES[2 if k % 90 == 0 else k % 2], k, titulo or None, rng.choice([None, "", "hot name", "w1 w2"]), None))
    catalog += [(s, o + 1000, t, a, y) for s, o, t, a, y in catalog[:200]]
    queries = [(k, " ".join(rng.sample(words, rng.randrange(1, 7)))) for k in range(120)]
    queries += [(200, None), (201, ""), (202, "common"), (203, "common hot name"), (204, "unheard"), (205, "w1 w1 w2"), (206, " ".join(f"w{k}" for k in range(60)))]
    rows = spark.createDataFrame(catalog, CATALOG)
    found = resolve.retrieve(spark.createDataFrame(queries, "sub_id long, query string"), resolve.index(rows, 7, stored), 7)
    text = {(s, o): (t, a) for s, o, t, a, _ in catalog}
    got = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: r.ord):
        got[r.sub_id, r.source].append((r.titulo, r.autor))
    assert dict(got) == {k: [text[k[1], o] for o in rows_] for k, rows_ in plain(queries, catalog, 7).items()}


def test_retrieve_from_nothing(spark):
    queries = spark.createDataFrame([(1, "a title")], "sub_id long, query string")
    rows = spark.createDataFrame([(resolve.SOURCES[0], 1, "a title", "name", 1990)], CATALOG)
    assert resolve.retrieve(queries, rows.limit(0)).count() == 0
    assert resolve.retrieve(queries.limit(0), rows).count() == 0
    assert [r.ord for r in resolve.retrieve(queries, rows, base=1000).collect()] == [1101]


def test_copies_are_one_kind(spark):
    texts = ["red ring", "ring red", "red bolt", "old ring"]
    catalog = [(resolve.SOURCES[k % 2], k, texts[k // 2 % 4], "brand" if k % 5 else None, k) for k in range(400)]
    queries = [(k, ["red ring", "RING red", "bolt red brand", "old"][k % 4]) for k in range(40)]
    found = resolve.index(spark.createDataFrame(catalog, CATALOG), 7)
    assert found.known.count() == found.known.select("source", "tokens").distinct().count() * 7 == 12 * 7  # 400 rows before
    got = defaultdict(list)
    for r in sorted(resolve.retrieve(spark.createDataFrame(queries, "sub_id long, query string"), found).collect(), key=lambda r: r.ord):
        got[r.sub_id, r.source].append(r.year)
    assert dict(got) == plain([(k, q.lower()) for k, q in queries], catalog, 7)


@pytest.mark.parametrize("name", ["answer_confirmations", "verify_scores", "consensus_groups", "resolve_decisions"])
def test_plans_stay_small(spark, sf_dir, name):
    """The driver never plans retrieval and scoring at once (38 joins for the first two before)."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 5
