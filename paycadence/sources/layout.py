"""Stored forms of landed tables that later runs read cheaper: bucketed on a key, and with variant columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def store_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """The table in the session's warehouse, hashed on ``key`` to buckets that are sorted by it; returns it.

    Two tables of one key type and bucket count join on the key without a shuffle. Rows are shuffled to
    their bucket before the write, so there is one file a bucket instead of one for each task and bucket.
    Rows with a null key are all of one bucket, and rows of one key too: a join over the stored tables can't
    split them, so take a bucket count with that much room, or store payments without an entry apart.
    """
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    hashed = df.repartition(buckets, key)
    hashed.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def is_variant(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.VariantType)


def as_variant(df: DataFrame, column: str) -> Column:
    """The column as a variant: parsed from JSON text (null if it isn't JSON), made of a struct or array, or as it is."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.VariantType):
        return F.col(column)
    if isinstance(kind, T.StringType):
        return F.try_parse_json(column)
    return F.to_variant_object(column)


def with_variants(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table with semi-structured columns as variants, parsed once instead of by every read."""
    return df.withColumns({c: as_variant(df, c) for c in columns})


def path_state(df: DataFrame, column: str, path: str) -> Column:
    """Whether a path holds a ``value``, a JSON ``null``, or is ``missing`` (as in a null column).

    A struct can't tell the last two apart: a null field of it is a JSON null.
    """
    found = F.try_variant_get(as_variant(df, column), path, "variant")
    return F.when(found.isNull(), "missing").when(F.is_variant_null(found), "null").otherwise("value")
