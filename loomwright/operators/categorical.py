"""Categories: codes by first appearance, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def codebook(df: DataFrame, column: str, order: str) -> DataFrame:
    """label, code: distinct labels numbered by the position at which they first appear (few rows: labels, not data)."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.min(order).alias("__first"))
    return first.select("label", (F.row_number().over(Window.orderBy("__first", "label")) - 1).cast("double").alias("code"))


def factorize(df: DataFrame, column: str, order: str, out: str = "code") -> DataFrame:
    """df with the code of each label; a missing label has none."""
    book = codebook(df, column, order).select(F.col("label").alias("__label"), F.col("code").alias(out))
    return df.join(book, F.col(column) == F.col("__label"), "left").drop("__label")


def decode(df: DataFrame, code: str, book: DataFrame, out: str = "label") -> DataFrame:
    """df with the label of each code; a code outside the book has none."""
    return df.join(book.select(F.col("code").alias("__code"), F.col("label").alias(out)), F.col(code) == F.col("__code"), "left").drop("__code")
