"""Report sinks and sources: CSV with upper-case headers, and JSON per dataset."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """A directory of CSV parts, each with the upper-case header; null is an empty cell."""
    upper_names(df).write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_bundle(marts: Mapping[str, DataFrame], path: str) -> None:
    """All datasets under one path, one ``dataset=NAME`` folder each, a JSON object per row.

    Null columns are kept, so every row object has every key.
    """
    for name, df in marts.items():
        upper_names(df).write.mode("overwrite").option("ignoreNullFields", "false").json(
            f"{path}/dataset={name}"
        )


def read_dataset(spark: SparkSession, path: str, name: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/dataset={name}")
