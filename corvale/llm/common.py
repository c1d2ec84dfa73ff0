"""Helpers that the operators of this folder share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII blanks that separate words: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of spark.checkpoint.dir. Only a local session may do without
    that setting and has a temporary folder then; on a cluster executors could not read one, so that is an error."""
    context = spark.sparkContext
    named = context._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="corvale-checkpoints-")
    context.setCheckpointDir(place)
    return context._jsc.sc().getCheckpointDir().get()


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: list[str] = []


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go as soon as the action that made them ends: its rows are in the shared folder then."""
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut at files in the shared folder, so that a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    with _tidy(df.sparkSession):
        return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """As cut(), but column-wise and compressed: for wide or many rows. It also forgets how the rows were dealt, so that a
    join with them deals both sides anew and may split hot keys while it runs."""
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.parquet(place)
    _MADE.append(place)
    return spark.read.schema(df.schema).parquet(place)


def made() -> frozenset[str]:
    """The tables that written() has made here and that are still there."""
    return frozenset(_MADE)


def forget(spark: SparkSession, keep: DataFrame, older: frozenset[str] = frozenset()) -> None:
    """Deletes the tables that written() made here, but for those that keep reads and for older ones, which other frames may still read."""
    used = keep.inputFiles()
    for place in [p for p in _MADE if p not in older and not any(f"/{p.rsplit('/', 1)[1]}/" in file for file in used)]:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _MADE.remove(place)


def each_batch(df: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str, max_bytes: int = 8 << 20) -> DataFrame:
    """mapInArrow with batches of about max_bytes of data, however Spark cuts them, so that memory is bounded by bytes, not rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            step = max(1, int(rows * min(1.0, max_bytes / max(1, batch.nbytes))))
            for at in range(0, rows, step):
                yield from work(pa.Table.from_batches([batch.slice(at, step)])).combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def held_out(modulus: int, remainder: int, id_column: str = "doc_id"):
    """crc32 of the id as text, modulo modulus, equals remainder."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus == F.lit(remainder)


def binary_column(table_: pa.Table, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in table_[name].cast(pa.binary()).to_pylist()]


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """Start of each run of the given lengths, with the total as the last entry."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
