from __future__ import annotations

import pytest
from cotejo.functions import text as tx
from cotejo.operators import search
from pyspark.sql import functions as F

CASES = [("gratitud", "La gramática del vino", 0), ("mi libro inventado", "El libro del ego", 0), ("inventado", "invertir", 0), ("tu momento", "Este es tu momento", 0.90), ("victor hugo", "Victor Hugo", 1), ("habitos atomico", "Hábitos atómicos", 0.97), ("habtos atomicos", "Hábitos atómicos", 0.9854), ("sapines", "Sapiens", 0.9714), ("el", "El ego", 0.97)]


def test_relevance(spark):
    q = spark.createDataFrame([(c[0],) for c in CASES], "q string").select(tx.normalize_search(F.col("q")).alias("q")).distinct()
    f = spark.createDataFrame([(c[1],) for c in CASES], "f string").select(tx.normalize_search(F.col("f")).alias("f")).distinct()
    got = {(r.q, r.f): r.rel for r in search.relevance(q, f).collect()}
    norm = {r.x: r.y for r in spark.createDataFrame([(c[1],) for c in CASES], "x string").select("x", tx.normalize_search(F.col("x")).alias("y")).collect()}
    for q_, f_, rel in CASES:
        assert got.get((q_, norm[f_]), 0) == pytest.approx(rel, abs=1e-4)


def test_ranking_with_and_without_author(spark):
    items = spark.createDataFrame([(1, 1, "Los miserables", "Victor Hugo"), (2, 2, "Nuestra Señora", "Victor Hugo"), (3, 3, "Los miserables del mar", None)], "item_id long, ord long, titulo string, autor string")
    queries = spark.createDataFrame([(1, "victor hugo"), (2, "los miserables | hugo"), (3, "|hugo"), (4, None), (5, "los miserables|")], "query_id long, query string")
    got = [(r.query_id, r["rank"], r.item_id) for r in search.rank(queries, items).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 3), (5, 1, 1), (5, 2, 3)]


def test_highlight(spark):
    rows = [("Él & Niño", "nino|x"), ("Él", "z"), (None, "a"), ("Un e\u0301xito <b>", "exito"), ("e\u0301e\u0301", "é"), ("a", ""), ("", "a")]
    got = spark.createDataFrame(rows, "t string, q string").select(search.highlight(F.col("t"), F.col("q"))).collect()
    assert [r[0] for r in got] == ["Él &amp; <mark>Niño</mark>", "Él", "", "Un <mark>e\u0301xito</mark> &lt;b&gt;", "<mark>e</mark>\u0301e\u0301", "a", ""]


def test_short_queries_lose_nothing(spark):
    """Every query against every field by the rules for direct hits, without an index."""
    fields = ["el arte de la guerra", "it", "yo el supremo", "a", "de a poco", "guerra y paz", "x y z"]
    asked = ["it", "a", "y", "el", "de la", "yo", "z x", "gu", "guerra", "arte de", "q", "la gue"]
    got = {(r.q, r.f) for r in search.relevance(spark.createDataFrame([(q,) for q in asked], "q string"), spark.createDataFrame([(f,) for f in fields], "f string")).collect()}
    want = {(q, f) for q in asked for f in fields if q in f or all(any(w.startswith(a) for w in f.split()) for a in q.split())}
    assert want <= got
