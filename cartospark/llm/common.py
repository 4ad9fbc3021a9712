"""Shared plumbing of the corpus operators: checkpoints, paths, Arrow batch size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but blank, tab, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "\t\n\x0b\x0c\r "


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="cartospark-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder, so that a lost executor costs no recomputation of what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    For tables that are joined with themselves round after round: a checkpoint
    keeps the planner's estimate of its size, which such joins square each time
    until planning takes longer than the work; of files the size is known.
    """
    path = scratch(df.sparkSession, "rounds")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session's context."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="cartospark-code-")) / f"{package.name}.zip"
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Rows in an Arrow batch: bounds a Python worker's memory when texts are long. Also ships the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def without(c: Column, chars: str) -> Column:
    """``c`` without some characters: one replacement each, which costs a fraction of translate()."""
    for x in chars:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def n_words(c: Column) -> Column:
    """Number of words, null counting 0."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(c: Column, body) -> Column:
    """``body(c)`` with c computed once, whatever the number of places that use it."""
    return F.element_at(F.transform(F.array(c), body), 1)


#: Rows up to which a small dimension table is broadcast; beyond, the plain join splits hot keys.
BROADCAST_ROWS = 10_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """``left`` left-joined with ``right`` (one row a key): keys that hold many of the ``rows`` rows of ``left`` are not shuffled.

    A key is hot from a quarter of a task's fair share on, so there are at most
    four times as many as tasks; their rows of ``right`` are broadcast.
    """
    share = rows / (4 * partitions(left.sparkSession))
    hot = cut(left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.lit(max(share, 1.0))).select(key))
    here = left.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), key, "left")
    cold = here.where("is_hot is null").drop("is_hot").join(right, key, "left")
    few = right.join(F.broadcast(hot), key, "left_semi")
    return cold.unionByName(here.where("is_hot").drop("is_hot").join(F.broadcast(few), key, "left"))
