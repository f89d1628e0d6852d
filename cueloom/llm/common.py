"""Shared plumbing: the folder all executors see, and materialised intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.graph import shared_dir


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cueloom/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts lineage, keeps column pruning, and survives the loss of executors. The folder's owner
    clears it when the application has ended.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(column: str, of: str = "") -> Column:
    """The column of this very name, dots and backticks in it included; of: the struct that holds it."""
    return F.col(f"{of}." * bool(of) + "`" + column.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
