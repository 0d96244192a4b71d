from __future__ import annotations

import datetime as dt

from cotejo.operators import dedup
from cotejo.sources import catalog as cat
from cotejo.streaming import intake
from pyspark.sql import functions as F

SUBS = [(1, "Dune", "Frank Herbert"), (2, "Sapiens", "Yuval Noah Harari"), (3, "Sapiens", "Yuval Noah Harari"), (4, "", "x"), (5, "Rebelión en la granja", "George Orwell"), (6, "dune", "frank herbert")]


def _catalog(spark, path):
    start = spark.createDataFrame([(2, "Dune", "Frank Herbert", "")], "line_no long, titulo string, autor string, nota string")
    start.write.parquet(f"{path}/batch_id=-1")
    return path


def _titles(spark, path):
    return sorted(r.titulo for r in spark.read.schema(intake.CATALOG).parquet(path).collect())


def test_intake_stream_equals_one_batch_and_replays(spark, tmp_path):
    source, one = str(tmp_path / "in"), _catalog(spark, str(tmp_path / "one"))
    many = _catalog(spark, str(tmp_path / "many"))
    subs = spark.createDataFrame([(*s, "", False) for s in SUBS], "sub_id long, titulo string, autor string, nota string, confirm boolean")
    for k in range(2):
        subs.filter(F.col("sub_id") % 2 == k).coalesce(1).write.parquet(f"{source}/part={k}")
    stream = spark.readStream.schema(subs.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    query = intake.start_intake(stream, many, str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    intake.accept_batch(spark, subs, 0, one)
    assert _titles(spark, many) == _titles(spark, one) == ["Dune", "Rebelión en la granja", "Sapiens"]
    intake.accept_batch(spark, subs, 0, one)
    assert _titles(spark, one) == ["Dune", "Rebelión en la granja", "Sapiens"]


def test_rows_are_taken_in_turn(spark):
    """2 is like 1 and goes; 3 is like 2 only and stays; 5 waits for 4, which is like 3 and goes."""
    rows = spark.createDataFrame([(k,) for k in range(1, 7)], "sub_id long")
    blocks = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 4), (6, 1), (6, 4)], "sub_id long, earlier long")
    assert sorted(r.sub_id for r in intake.in_turn(rows, blocks).collect()) == [1, 3, 5]
    assert sorted(r.sub_id for r in intake.in_turn(rows, blocks.limit(0)).collect()) == [1, 2, 3, 4, 5, 6]


def test_heads_equal_all_rows_at_once(spark, monkeypatch):
    titles, authors = ["Dune", "Dunes", "Dune: una novela", "Sapiens", "Sapines", "Rayuela", "1984"], ["Frank Herbert", "F. Herbert", "Yuval Harari"]
    rows = [(k, titles[k * 5 % 7], authors[k * 7 % 11 % 3], "", k % 4 == 1) for k in range(40)]
    subs = spark.createDataFrame(rows, "sub_id long, titulo string, autor string, nota string, confirm boolean").checkpoint()
    found = [r for r in dedup.similar_rows(subs, subs.withColumnRenamed("sub_id", "line_no")).collect() if r.line_no < r.sub_id]
    taken = []
    for k, *_, confirm in rows:
        if not any(r.sub_id == k and r.line_no in taken and (r.tier == "exact" or not confirm) for r in found):
            taken.append(k)
    for head in (9, 2000):
        monkeypatch.setattr(intake, "HEAD", head)
        assert sorted(r.sub_id for r in intake.in_heads(subs).collect()) == taken and 4 < len(taken) < 20


def test_blanks_of_all_kinds(spark):
    lines = spark.createDataFrame([(1, "titulo,autor\r"), (2, "\tDune\u00a0,Herbert\r"), (3, "\r"), (4, "\u00a0,x"), (5, "a,b,c")], "line_no long, line string")
    assert [(r.line_no, r.titulo, r.autor, r.compared) for r in cat.catalog_rows(lines).orderBy("line_no").collect()] == [(2, "Dune", "Herbert", True), (4, "", "x", False), (5, "a", "b", True)]
    assert [tuple(r) for r in cat.check_lines(lines).collect()] == [(5, "expected 1 commas, got 2")]
    assert [tuple(r) for r in cat.check_lines(lines.limit(1)).collect()] == [(1, "file too short")]


def test_optouts_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t, "a", "t1", "confirm"), (t + dt.timedelta(hours=1), "a", "t2", "confirm"), (t, "b", "", "confirm"), (t, "c", "t3", "stay"), (t, "d", "t4", "confirm"), (t, None, "t5", "confirm")]
    actions = spark.createDataFrame(rows, "ts timestamp, email string, token string, action string")
    actions.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = intake.optouts(spark.readStream.schema(actions.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("optouts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    batch = sorted(r.email for r in intake.optouts_batch(actions).collect())
    assert sorted(r.email for r in spark.table("optouts").collect()) == batch == ["a", "d"]
