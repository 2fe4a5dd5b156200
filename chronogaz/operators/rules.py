"""Quality rules: each gives rows of one violation contract (rule_id, severity, path, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violation(df: DataFrame, rule: str, path: Column, message: Column, severity: str = "error") -> DataFrame:
    return df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), path.cast("string").alias("path"), message.alias("message"))


def missing_keys(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Rows whose key the other table lacks; null keys are no reference."""
    d = dim.select(F.col(dim_key).alias("_k")).distinct()
    return df.where(F.col(key).isNotNull()).join(d, F.col(key) == F.col("_k"), "left_anti")


def duplicates(df: DataFrame, key: Column, member: str) -> DataFrame:
    """Keys with more than one row: (key, n, members sorted)."""
    g = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), ",").alias("members"))
    return g.where("n > 1")


def report(*parts: DataFrame) -> DataFrame:
    """One failure list of all rules."""
    return reduce(DataFrame.unionByName, parts)
