"""Parquet table loader for the driver tables (``<sf_dir>/<name>.parquet``)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from webloom.session import scratch_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "pages")


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared scratch folder and read again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.scratch = path
    return written


def discard(written: DataFrame) -> None:
    """Deletes the files of a ``materialized`` table that nothing reads any more."""
    spark = written.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(written.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
