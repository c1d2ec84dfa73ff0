"""Session defaults for local runs; a cluster brings its own session."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input for which a shuffle gets one more partition.
PIECE = 4 << 20
#: Partitions over which rows are dealt whose key is null.
NULL_SALTS = 1024
#: Rows that a Python worker holds parsed at once.
SLICE = 200


def local_session(cores: str | int = "*", app: str = "corvale") -> SparkSession:
    """A local session with the settings that the tests and the bench rely on."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.memory": os.environ.get("CORVALE_DRIVER_MEMORY", "6g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of spark.checkpoint.dir. A local session without that setting has a
    temporary folder; on a cluster executors could not read one, so that is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            place = tempfile.mkdtemp(prefix="corvale-checkpoints-")
        context.setCheckpointDir(place)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut at files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """The same rows over at least as many partitions as there are cores. Tables of one small file would else be read, and
    everything before the next shuffle done, by one task; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def deal_out(df: DataFrame) -> DataFrame:
    """The same rows in even partitions, four for each core at least. A large file of few row groups has many partitions of which few
    hold rows, so their number says nothing of the balance."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def pieces(df: DataFrame) -> int:
    """The number of partitions for a shuffle of df, so that none grows with the input: one for each PIECE that its tables hold,
    and one for each core at least. Adaptive execution would merge partitions up to its advisory size, which counts compressed
    bytes, and so millions of rows; a number that is asked for it leaves alone."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)  # rows made by the driver or an RDD have no size
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-known // PIECE))


def left_by(rows: DataFrame, index: DataFrame, keys: list[str], by: list[str], hot: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """rows left joined with index by keys. Rows with a null key match nothing and are dealt over NULL_SALTS numbers by the hash of
    the columns by, or one task would get all of them. hot (the only key, parts): rows of such a key are dealt over that many
    numbers, and the key's rows of index repeated for each; it has few rows, which are broadcast. n: the partitions to join in."""
    mixed = F.xxhash64(*by)
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    here, there = rows, index.dropna(subset=keys)
    parts = F.lit(1)
    if hot is not None:
        here, there = (x.join(F.broadcast(hot), keys, "left") for x in (here, there))
        parts = F.coalesce("parts", F.lit(1))
    here = here.withColumn("_salt", F.when(null, F.pmod(mixed, F.lit(NULL_SALTS))).otherwise(F.pmod(mixed, parts)).cast("int"))
    there = there.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    if n is not None:
        here, there = here.repartition(n, *keys, "_salt"), there.repartition(n, *keys, "_salt")
    return here.drop("parts").join(there.drop("parts"), [*keys, "_salt"], "left").drop("_salt")


def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of batches, a few at a time: what a worker makes of them goes to the JVM before the next are parsed. A batch has
    up to 10,000 rows, and a file gives many."""
    for batch in batches:
        for start in range(0, len(batch), SLICE):
            yield batch.iloc[start : start + SLICE]
