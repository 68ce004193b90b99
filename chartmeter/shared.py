"""Cluster-wide helpers: the shared folder, staged tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a side may have to be broadcast or to be ordered in a single task.
SMALL_ROWS = 100_000
#: Most bytes, written as JSON, that a broadcast side may have.
SMALL_BYTES = 64 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="chartmeter-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_scopes: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; an open ``run_scope`` will remove it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was staged inside it, also after an error.

    Results made inside read their stages until they are themselves written: write, collect
    or count them before the scope ends.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, so a lost executor re-reads files instead of recomputing, and
    gives the optimizer real sizes and prunable columns. ``rows_per_file`` splits
    what one task writes, for rows that later grow into many.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_out(df: DataFrame) -> DataFrame:
    """A table in fewer files than there are cores, dealt over all cores: for work that costs
    far more than moving the rows. A table in more files stays as it is."""
    files, cores = len(df.inputFiles()), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < files < cores else df


def is_small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes of JSON.

    Reads no more than it needs to tell, and moves only the row sizes.
    """
    width = F.octet_length(F.to_json(F.struct("*")))
    seen = df.select(width.alias("width")).limit(rows + 1)
    n, total = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum("width"), F.lit(0))).first()
    return n <= rows and total <= size


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` if it is small; a larger one is left to a shuffled join."""
    return F.broadcast(df) if is_small(df) else df
