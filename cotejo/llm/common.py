"""What the operators of this subpackage share: ids, tables, cut lineage."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside an operator: it sorts before every other id and leaves as null.
NULL_ID = -(2**63)
#: Spark deletes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_in(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID)).alias(name)


def id_out(name: str = "doc_id") -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name)).alias(name)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where df has such a column."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors share."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share, when the session is built")
    return place


_WRITES = [0, "false"]
_LOCK = threading.Lock()


@contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    """CLEANUP is on inside; writes that overlap restore the user's value together."""
    with _LOCK:
        if not _WRITES[0]:
            _WRITES[1] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _WRITES[0] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITES[0] -= 1
            if not _WRITES[0]:
                spark.conf.set(CLEANUP, _WRITES[1])


def _path(spark: SparkSession, path: str):
    """A path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame, name: str, codec: str = "zstd", dictionary: bool = True) -> DataFrame:
    """Write df as a table in the shared folder and read it again: the lineage ends there, and a
    lost executor costs no more than the tasks that read it. The shuffle files of the write go
    with it, as nothing reads them again. The table goes by drop(), or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _cleanup(spark):
        df.write.option("compression", codec).option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    place, files = _path(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and nothing will read again."""
    for table in tables:
        place, files = _path(table.sparkSession, table.cut_path)
        files.delete(place, True)
        files.cancelDeleteOnExit(place)


def crc_remainder(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))

