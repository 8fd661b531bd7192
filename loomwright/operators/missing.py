"""Missing values: what counts as missing, and the policies for it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DataError
from .aggregate import quantiles

# Spellings of a missing cell, compared in lower case and untrimmed.
NA_TOKENS = ("", "na", "n/a", "nan", "-nan", "null", "none", "#n/a", "#n/a n/a", "#na", "<na>", "1.#ind", "-1.#ind", "1.#qnan", "-1.#qnan")


def na_to_null(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.when(~F.lower(c).isin(*NA_TOKENS), c)


def is_missing(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return (c.isNull() | F.isnan(c)) if df.schema[name].dataType.typeName() in ("double", "float") else c.isNull()


def any_missing(df: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [is_missing(df, c) for c in columns], F.lit(False))


def na_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_missing: one aggregate over one scan."""
    row = df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in columns])
    return row.unpivot([], columns, "column_name", "n_missing")


def abort(df: DataFrame, columns: list[str], pos: str) -> DataFrame:
    """df; a missing cell is an error that names the first, by row and then by column."""
    cells = [F.when(is_missing(df, c), F.struct(F.col(pos).alias("row"), F.lit(i).alias("nth"))) for i, c in enumerate(columns)]
    first = df.agg(F.min(F.least(*cells) if len(cells) > 1 else cells[0]).alias("x")).first()["x"]
    if first is not None:
        raise DataError(f"row {first['row']}: {columns[first['nth']]} is missing")
    return df


def abort_any(df: DataFrame, columns: list[str]) -> DataFrame:
    """df; a missing cell is an error, for rows that have no order."""
    row = df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in columns]).first()
    if found := [c for c in columns if row[c]]:
        raise DataError(f"{found[0]} is missing in {row[found[0]]} rows")
    return df


def na_summary(df: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """detected, n_cells, n_rows, n_columns that miss something, and which rows they are (the first 20 ids)."""
    by = {c: is_missing(df, c) for c in columns}
    any_ = any_missing(df, columns)
    cells = sum((F.count_if(x) for x in by.values()), F.lit(0))
    wide = sum((F.max(x.cast("int")) for x in by.values()), F.lit(0))
    small = df.agg(F.bool_or(any_).alias("detected"), cells.alias("n_cells"), F.count_if(any_).alias("n_rows"), wide.cast("long").alias("n_columns"))
    first = df.where(any_).select(id_col).orderBy(id_col).limit(20).agg(F.sort_array(F.collect_list(id_col)).alias("ids"))
    return small.join(first, F.lit(True))  # one row each


def remove_sample(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(~any_missing(df, columns))


def flag_for_removal(df: DataFrame, columns: list[str], flag: str) -> DataFrame:
    """df with a column of rows to remove once all joins are done."""
    return df.withColumn(flag, any_missing(df, columns))


def remove_feature(df: DataFrame, columns: list[str]) -> DataFrame:
    """df without those of the columns that miss any cell."""
    row = df.agg(*[F.coalesce(F.bool_or(is_missing(df, c)), F.lit(False)).alias(c) for c in columns]).first() if columns else {}
    return df.drop(*[c for c in columns if row[c]])


def fill_value(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.when(is_missing(df, c), F.lit(value)).otherwise(F.col(f"`{c}`")) for c in columns})


def fill_across(df: DataFrame, columns: list[str], backward: bool = False) -> DataFrame:
    """Fill a missing cell from the columns before it in its row (or after it)."""
    given = {c: F.when(~is_missing(df, c), F.col(f"`{c}`")) for c in columns}
    order = columns[::-1] if backward else columns
    return df.withColumns({c: F.coalesce(*[given[x] for x in order[: i + 1][::-1]]) for i, c in enumerate(order)})


def fill_statistic(df: DataFrame, columns: list[str], method: str, across_folds: bool = False) -> DataFrame:
    """Fill by a column's mean or median; as that lets folds see each other, it must be asked for."""
    if not across_folds:
        raise DataError(f"filling by {method} mixes folds; pass across_folds=True to do so")
    there = df.select(*[F.when(~is_missing(df, c), F.col(f"`{c}`")).alias(c) for c in columns])
    values = quantiles(there, [], columns, [0.5]) if method == "median" else there.agg(*[F.avg(f"`{c}`").alias(c) for c in columns])
    row = values.first() or dict.fromkeys(columns)
    return df.withColumns({c: F.when(is_missing(df, c), F.lit(row[c])).otherwise(F.col(f"`{c}`")) for c in columns})
