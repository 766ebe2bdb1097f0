"""What the operators share: the shared folder, written tables, and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch carries to Python at most; texts are long, so batches are short.
BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where neither the session nor the context names one (tests in local mode) a
    temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="ledgerlume-")
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ledgerlume/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder: its lineage ends there, so a lost executor
    costs one task and not the work before it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def short_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "0")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often a lambda inside body refers to it."""
    return F.get(F.transform(F.array(value), body), 0)


def heavy_keys(counts: DataFrame, key: str, total: int, hot: int, most: int = 10_000) -> DataFrame | None:
    """The keys of counts (one row for each key, `n` of total rows) that have more than
    max(hot, total / most) rows, as a broadcast; None if there is none. They are fewer than `most`."""
    heavy = counts.where(F.col("n") > max(hot, total // most)).select(key)
    return F.broadcast(heavy) if heavy.limit(1).count() else None


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int, hot: int) -> DataFrame:
    """left joined with right, which has one row for each key and in `n` how many of the
    `total` rows of left hold it; n is not in the result. The few heavy keys are broadcast and
    their rows stay where they are; only the other keys are shuffled."""
    heavy, right_ = heavy_keys(right, key, total, hot), right.drop("n")
    if heavy is None:
        return left.join(right_, key)
    light = left.join(heavy, key, "left_anti").join(right_.join(heavy, key, "left_anti"), key)
    return light.unionByName(left.join(F.broadcast(right_.join(heavy, key, "left_semi")), key))
