"""The folder that driver and executors share, and cutting lineage there."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset a folder beside the tables of spark.sql.warehouse.dir, which driver and executors share as well."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lodestone"


def keep(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder; later reads survive the loss of executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def keep_table(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for wide or large data: columnar, with sizes that the planner knows."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Hadoop's file systems."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def same(left: list, right: list):
    """The condition that columns are equal, nulls included."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right)])


def each_once(df: DataFrame, of: DataFrame, by: list[str]) -> DataFrame:
    """df with one of the rows that agree in the columns `by`. of: df or what it was taken from.

    What occurs twice is found by counting `by` alone, and only such rows are moved.
    """
    twice = keep(of.groupBy(*by).agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1").select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(by)]))
    if twice.isEmpty():
        return df
    again = same([F.col(c) for c in by], [F.col(f"_{k}") for k in range(len(by))])
    return df.join(twice, again, "left_anti").unionByName(df.join(twice, again, "left_semi").dropDuplicates(by))
