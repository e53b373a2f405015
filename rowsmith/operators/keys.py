"""Keys: duplicates in the sheet, rows that the target has already, and missing references.

Keys are columns of their own, compared as values; a key with a null part does not take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _whole(df: DataFrame, key: list[str]) -> DataFrame:
    return df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key))


def first_rows(df: DataFrame, key: list[str], row: str = "row_num") -> DataFrame:
    """Each key's first row, as first_row, and its count; pre-aggregated, so a frequent key is no burden."""
    return _whole(df, key).groupBy(*key).agg(F.min(row).alias("first_row"), F.count("*").alias("times"))


def duplicates(df: DataFrame, key: list[str], row: str = "row_num") -> DataFrame:
    """Rows whose key an earlier row has, with that row.

    Only keys that occur more than once are joined back, and Spark may split a frequent one.
    """
    repeated = first_rows(df, key, row).where("times > 1").drop("times")
    return _whole(df, key).join(repeated, key).where(F.col(row) > F.col("first_row"))


def existing(df: DataFrame, key: list[str], target: DataFrame, target_key: list[str], row: str = "row_num") -> DataFrame:
    """First rows of keys that the target has."""
    first = first_rows(df, key, row).select(*key, F.col("first_row").alias(row))
    return first.join(_renamed(target, target_key, key), key, "left_semi")


def missing(df: DataFrame, key: list[str], referenced: DataFrame, referenced_key: list[str]) -> DataFrame:
    """Rows whose key the referenced table does not have."""
    return _whole(df, key).join(_renamed(referenced, referenced_key, key), key, "left_anti")


def _renamed(other: DataFrame, other_key: list[str], key: list[str]) -> DataFrame:
    return other.select(*[F.col(f"`{o}`").alias(k) for o, k in zip(other_key, key, strict=True)])
