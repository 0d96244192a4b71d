from __future__ import annotations

import random

import pytest
from cotejo.operators import requests
from cotejo.sources import catalog as cat
from cotejo.sources import external


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_catalogue_file(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text('titulo,autor,portada,tagline\nDune,Herbert,,\n\nsolo\n, x,,\nbad,"q",,\n')
    lines = cat.read_catalog(spark, str(tmp_path / "csv"))
    assert [(r.line_no, r.titulo, r.compared) for r in cat.catalog_rows(lines).orderBy("line_no").collect()] == [(2, "Dune", True), (4, "solo", False), (5, "", False), (6, "bad", True)]
    assert cat.first_failure(cat.check_lines(lines)).first().line_no == 4


def test_lines_are_those_of_the_files(spark, tmp_path, small_splits):
    """Files of many splits, with blank lines, other line ends and no end at all, against plain Python."""
    rng = random.Random(4)
    (tmp_path / "in").mkdir()
    texts = {f"f{k}.csv": "".join(rng.choice(["a,b", "é" * 40, "", "x\ry", "long " * 70]) + "\n" for _ in range(60)) for k in range(3)}
    texts |= {"g.csv": "head", "h.csv": "head\n", "i.csv": "a\nb"}
    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes(text.encode())
    lines = cat.read_lines(spark, str(tmp_path / "in"))
    assert lines.rdd.getNumPartitions() > 3
    got = sorted((r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in lines.collect())
    assert got == sorted((name, k, line) for name, text in texts.items() for k, line in enumerate(text.split("\n"), 1))
    short = {(r.file.rsplit("/", 1)[1], r.reason) for r in cat.check_lines(lines).collect() if r.reason == "file too short"}
    assert short == {("g.csv", "file too short")}


def test_each_file_has_its_header(spark):
    lines = spark.createDataFrame([("a", 1, "x,y"), ("a", 2, "1,2"), ("b", 1, "x"), ("b", 2, "1"), ("b", 3, "1,2")], "file string, line_no long, line string")
    assert [tuple(r) for r in cat.check_lines(lines).collect()] == [("b", 3, "expected 0 commas, got 1")]


def test_appended_rows_are_read_back(spark, tmp_path, small_splits):
    path = str(tmp_path / "cat")
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat" / "base.csv").write_text("titulo,autor,portada,tagline\nDune,Herbert,,\n \u00a0\n\n")
    rows = spark.createDataFrame([(k, f"T{k}", "A", None) for k in range(40)], "k long, titulo string, autor string, nota string").repartition(5)
    for batch, part in ((1, "k < 30"), (2, "k >= 30"), (1, "k < 30")):  # a batch that runs again
        cat.append_rows(rows.filter(part), path, batch, "k")
    got = [(r.line_no, r.titulo, r.compared) for r in cat.catalog_rows(cat.read_catalog(spark, path)).orderBy("line_no").collect()]
    assert got == [(2, "Dune", True), *((3 + k, f"T{k}", True) for k in range(40))]
    assert cat.check_lines(cat.read_catalog(spark, path)).collect() == []


def test_an_empty_catalogue_has_a_header(spark, tmp_path):
    path = str(tmp_path / "new")
    cat.start_catalog(spark, path)
    assert cat.catalog_rows(cat.read_catalog(spark, path)).collect() == []
    cat.append_rows(spark.createDataFrame([("Nueva", "A", "n")], "titulo string, autor string, nota string"), path, 1, "titulo")
    assert [(r.line_no, r.titulo) for r in cat.catalog_rows(cat.read_catalog(spark, path)).collect()] == [(2, "Nueva")]


def test_what_counts_as_true(spark):
    values = {"true": True, "false": False, '"true"': True, '"false"': True, '""': False, "0": False, "0.0": False, "2": True, "0.5": True, "-1": True, "null": False, "[]": True, "{}": True}
    rows = [(k, f'{{"reconocido": {v}, "titulo_canonico": " a ", "autor_canonico": {v}}}') for k, v in enumerate(values)]
    broken = [(90, "{broken"), (91, None), (92, "[]"), (93, "{}"), (94, '{"year": "1990", "confianza": "0.9"}'), (95, '{"year": 1990, "confianza": 0.9}')]
    got = {r.sub_id: r for r in external.answers(spark.createDataFrame(rows + broken, "sub_id long, content string")).collect()}
    assert [got[k].reconocido for k in range(len(values))] == list(values.values())
    assert got[0].titulo_canonico == "a" and got[2].autor_canonico == "true" and got[5].autor_canonico == ""
    for k in (90, 91, 92, 93, 94):
        assert (got[k].reconocido, got[k].titulo_canonico, got[k].year, got[k].confianza) == (False, "", None, 0.0)
    assert (got[95].year, got[95].confianza) == (1990, 0.9)


def test_blank_fields_are_required(spark):
    rows = [(1, "\t", "x"), (2, "\u00a0", "x"), (3, None, "x"), (4, "“”", "x"), (5, "a", "b")]
    got = requests.required_fields(spark.createDataFrame([(*r, None) for r in rows], "k long, titulo string, autor string, nota string"))
    assert [r.reason for r in got.orderBy("k").collect()] == ["required", "required", "required", "empty after cleaning", None]
