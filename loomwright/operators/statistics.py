"""Statistics that inference decides on: one aggregate each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def task_type_stats(df: DataFrame, column: str) -> DataFrame:
    """integral, n_distinct, low, high, n of a target's observed values."""
    x = F.col(column).cast("double")
    return df.agg(F.bool_and(x == F.floor(x)).alias("integral"), F.count_distinct(column).alias("n_distinct"), (F.min(x) + F.lit(0.0)).alias("low"), (F.max(x) + F.lit(0.0)).alias("high"), F.count(column).alias("n"))


def block_stats(df: DataFrame, array: str) -> DataFrame:
    """low, high, mean, std (population) over all cells of an array column."""
    x = df.select(F.explode(array).alias("x")).select(F.col("x").cast("double").alias("x"))
    return x.agg((F.min("x") + F.lit(0.0)).alias("low"), (F.max("x") + F.lit(0.0)).alias("high"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


def mean_spectrum(df: DataFrame, array: str) -> DataFrame:
    """idx, mean of each position of an array column."""
    return df.select(F.posexplode(array).alias("idx", "x")).groupBy("idx").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def coverage_audit(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """n_left, n_right, n_missing (left keys that right lacks), n_extra (right keys that left lacks), n_duplicates (left keys on several rows), as text."""
    a = left.groupBy(F.col(left_key).cast("string").alias("k")).agg(F.count("*").alias("n"))
    b = right.groupBy(F.col(right_key).cast("string").alias("k")).agg(F.count("*").alias("m"))
    both = a.join(b, "k", "full_outer")
    return both.agg(F.count("n").alias("n_left"), F.count("m").alias("n_right"), F.count_if(F.col("m").isNull()).alias("n_missing"), F.count_if(F.col("n").isNull()).alias("n_extra"), F.count_if(F.col("n") > 1).alias("n_duplicates"))


def replicate_groups(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Share of names that a replicate suffix matches, and names per group without it."""
    name, base = F.col(column), F.regexp_replace(column, pattern, "")
    p = df.agg(F.count_if(name.rlike(pattern)).alias("n_matched"), F.count("*").alias("n_rows"), F.count_distinct(base).alias("n_groups"))
    return p.select("n_matched", "n_rows", "n_groups", (F.col("n_rows") / F.col("n_groups")).alias("avg_repeats"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The values of a column, each once, in order; a missing one is none of them."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
