"""Streaming jobs (SS1, SS2) and the batch twin of the second."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators import dedup
from ..operators.requests import required_fields

#: Rows of a batch that are compared with one another at once.
HEAD = 6000
CATALOG = "line_no long, titulo string, autor string, nota string, batch_id long"


def in_turn(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The sub_id of the rows that come through when taken one by one: a row is refused if an
    earlier one that came through blocks it. blocks(sub_id, earlier). One task takes all rows, a head of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, taken = pa.Table.from_batches(batches), set()
        for sub, earlier in sorted(zip(table["sub_id"].to_pylist(), table["earlier"].to_pylist()), key=lambda x: x[0]):
            if taken.isdisjoint(earlier or ()):
                taken.add(sub)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(taken), pa.int64())], ["sub_id"])

    held = blocks.groupBy("sub_id").agg(F.collect_list("earlier").alias("earlier"))
    dealt = rows.select("sub_id").join(held, "sub_id", "left").withColumn("all", F.lit(0))
    return dealt.groupBy("all").applyInArrow(run, "sub_id long")


def unblocked(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows that no row of known(line_no, titulo, autor) blocks."""
    reports = dedup.intake_reports(rows, dedup.similar_best(rows, known)).filter("decision = 'accept'").select("sub_id")
    return rows.join(reports, "sub_id", "left_semi")


def in_heads(rows: DataFrame) -> DataFrame:
    """The rows that come through when taken one by one. Of equal rows only the first can, if it resembles itself.
    The first HEAD rows are settled among themselves; the others go on if no accepted one of these blocks
    them, and so on. Few rows are accepted in a round, as they don't resemble one another, so that pairs stay few."""
    confirm, known = F.coalesce("confirm", F.lit(False)), (F.col("titulo") != "") & (F.col("autor") != "")
    copy = F.row_number().over(Window.partitionBy("titulo", "autor", confirm).orderBy("sub_id"))
    rest = rows.withColumn("copy", copy).filter((F.col("copy") == 1) | ~F.coalesce(known, F.lit(False))).drop("copy").checkpoint()
    accepted = rest.limit(0)
    while not rest.isEmpty():
        head = rest.orderBy("sub_id").limit(HEAD).checkpoint()
        last = head.agg(F.max("sub_id")).first()[0]
        inside = dedup.similar_rows(head, head.select(F.col("sub_id").alias("line_no"), "titulo", "autor")).filter("line_no < sub_id")
        confirmed = head.select("sub_id", confirm.alias("confirm"))
        blocks = inside.join(confirmed, "sub_id").filter((F.col("tier") == "exact") | ~F.col("confirm")).select("sub_id", F.col("line_no").alias("earlier")).distinct()
        taken = head.join(in_turn(head, blocks), "sub_id", "left_semi").checkpoint()
        accepted = accepted.unionByName(taken)
        rest = rest.filter(F.col("sub_id") > last)
        if not rest.isEmpty():
            rest = unblocked(rest, taken.select(F.col("sub_id").alias("line_no"), "titulo", "autor")).checkpoint()
    return accepted


def accept_batch(spark: SparkSession, batch: DataFrame, batch_id: int, catalog_path: str) -> None:
    """One micro-batch of submissions(sub_id, titulo, autor, nota, confirm): what the catalogue and
    the earlier accepted rows of the batch, by sub_id, let pass is appended under the batch's number,
    on the lines after the catalogue's last. A batch that is run again replaces its own rows, and
    sees the catalogue without them. Needs a checkpoint folder; sub_id is unique in a batch."""
    held = spark.read.schema(CATALOG).parquet(catalog_path).filter(F.col("batch_id") != batch_id)
    clean = required_fields(batch).filter("reason is null")
    known = held.select("line_no", "titulo", "autor")
    last = held.agg(F.coalesce(F.max("line_no"), F.lit(1))).first()[0]
    new = in_heads(unblocked(clean, known))
    place = F.row_number().over(Window.orderBy("sub_id"))  # one micro-batch at most
    rows = new.select((place + last).cast("long").alias("line_no"), "titulo", "autor", "nota")
    rows.write.mode("overwrite").parquet(f"{catalog_path}/batch_id={batch_id}")


def start_intake(submissions: DataFrame, catalog_path: str, checkpoint: str) -> StreamingQuery:
    """SS1: a stream of submissions against the growing catalogue, one writer."""

    def run(batch: DataFrame, batch_id: int) -> None:
        accept_batch(batch.sparkSession, batch, batch_id, catalog_path)

    return submissions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def _confirmed(actions: DataFrame) -> DataFrame:
    return actions.filter((F.col("action") == "confirm") & (F.trim(F.coalesce("email", F.lit(""))) != "") & (F.trim(F.coalesce("token", F.lit(""))) != ""))


def optouts(actions: DataFrame, delay: str = "1 day") -> DataFrame:
    """SS2 on a stream of actions(ts, email, token, action): the confirmed ones, once for each
    email within the watermark."""
    return _confirmed(actions).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["email"])


def optouts_batch(actions: DataFrame) -> DataFrame:
    """The batch twin, which is the truth: the first confirmed action of each email."""
    return _confirmed(actions).groupBy("email").agg(F.min("ts").alias("ts"), F.min_by("token", "ts").alias("token"))
