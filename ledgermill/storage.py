"""Tables stored between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SAVED: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset and Spark runs in this process alone, a folder below the warehouse; on a cluster it must be set."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"


def store(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage: a lost executor costs its own tasks only. Also the table's path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SAVED.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def save(df: DataFrame, tag: str) -> DataFrame:
    return store(df, tag)[0]


def spread(df: DataFrame, *by: str) -> DataFrame:
    """In as many parts as a shuffle has. Where a row of few bytes takes long to work on, Spark would leave all of them to a few tasks, since it goes by bytes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a stored table."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _SAVED:
        _SAVED.remove(path)


def forget_all(spark: SparkSession) -> int:
    """Delete all tables that this program has stored, once its results are written; how many there were. Results that aren't written yet need them."""
    paths = list(_SAVED)
    for path in paths:
        forget(spark, path)
    return len(paths)
