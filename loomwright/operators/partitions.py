"""Partitions, folds and the checks that nothing leaks between them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError, SpecError
from .position import with_position

PARTITION = "__partition"
#: More folds than this are a mistake: each sends every row once more.
MOST_FOLDS = 1000
ORDER = ("train", "test", "val", "predict")


def check_lists(lists: dict[str, list]) -> None:
    seen: dict[str, str] = {}
    for part, values in lists.items():
        if part not in ORDER:
            raise SpecError(f"no partition is called {part}")
        for v in values:
            if seen.setdefault(str(v).lower(), part) != part:
                raise SpecError(f"{v!r} is in {seen[str(v).lower()]} and in {part}")


def _number(value) -> float | int | None:
    """The number that a declared value is or spells; booleans are none."""
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return value
    if isinstance(value, str) and re.fullmatch(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?", value):
        return int(value) if re.fullmatch(r"-?[0-9]+", value) else float(value)
    return None


def _equals(cell: Column, kind: T.DataType, values: list) -> Column:
    if not isinstance(kind, T.NumericType):
        return F.lower(cell.cast("string")).isin(*[str(v).lower() for v in values])
    found = F.lit(False)
    for v in values:
        if (x := _number(v)) is None:
            continue
        if isinstance(kind, T.FloatType):  # the declaration is rounded once, as the cells were
            x = F.lit(float(x)).cast("float")
        same = cell == x
        if not isinstance(kind, T.IntegralType) and _number(v) == 0:
            same = same & (cell.cast("string").startswith("-") == F.lit(str(v).startswith("-")))
        found = found | same
    return F.coalesce(found, F.lit(False))


def by_column(df: DataFrame, column: str, lists: dict[str, list], unknown: str = "error", out: str = PARTITION) -> DataFrame:
    """The partition whose list has the row's value. unknown: train, test, drop or error for all others, missing values among them.

    Text is compared as lower-case text. A number equals a declared number, or a text that spells one exactly; 0.0 and
    -0.0 are two values.
    """
    check_lists(lists)
    if column not in df.columns:
        raise SpecError(f"there is no column {column!r} to part by")
    kind = df.schema[column].dataType
    part: Column = F.lit(None).cast("string")
    for name in reversed(ORDER):
        if lists.get(name):
            part = F.when(_equals(F.col(f"`{column}`"), kind, lists[name]), name).otherwise(part)
    df = df.withColumn(out, part)
    if unknown in ("train", "test"):
        return df.withColumn(out, F.coalesce(out, F.lit(unknown)))
    if unknown == "error" and (bad := df.where(F.col(out).isNull()).select(column).limit(1).collect()):
        raise DataError(f"{column} = {bad[0][0]!r} is in no partition's list")
    return df.where(F.col(out).isNotNull())


def by_index(df: DataFrame, pos: str, lists: dict[str, list[int]], out: str = PARTITION) -> DataFrame:
    """The partition whose list has the row's position; other rows go. Positions must exist once, in one list."""
    rows = [(int(i), name) for name, own in lists.items() for i in own]
    if len({i for i, _ in rows}) != len(rows):
        raise SpecError("a position is listed twice")
    listed = df.sparkSession.createDataFrame(rows, f"{pos} long, {out} string")
    n = df.count()
    if bad := [i for i, _ in rows if not 0 <= i < n]:
        raise SpecError(f"position {bad[0]} is outside 0..{n - 1}")
    return df.join(listed, pos)


def folds_by_column(train: DataFrame, column: str, id_col: str) -> DataFrame:
    """fold, side, id: for each distinct value, by its text, its rows are validated on and all others trained on.

    Every row goes into every fold, so the result has as many rows as that: folds are few, and only their numbers are sent around.
    """
    values = train.select(F.col(column).cast("string").alias("__v")).where("__v is not null").distinct()
    if values.limit(MOST_FOLDS + 1).count() > MOST_FOLDS:
        raise SpecError(f"{column} has more than {MOST_FOLDS} values, and each would be a fold")
    numbers = values.select("__v", (F.row_number().over(Window.orderBy("__v")) - 1).cast("int").alias("fold"))
    folds = numbers.agg(F.sort_array(F.collect_list(F.struct("fold", "__v"))).alias("__folds")).first()["__folds"]
    listed = F.array(*[F.struct(F.lit(f["fold"]).alias("fold"), F.lit(f["__v"]).alias("v")) for f in folds])
    each = train.select(F.col(id_col), F.col(column).cast("string").alias("__own"), F.explode(listed).alias("f"))
    return each.select(F.col("f.fold").alias("fold"), F.when(F.col("__own") == F.col("f.v"), "val").otherwise("train").alias("side"), id_col)


def folds_by_assignment(train: DataFrame, fold: Column, n_folds: int, id_col: str) -> DataFrame:
    """fold, side, id from each row's own validation fold; its other folds train on it."""
    each = train.select(F.col(id_col), fold.cast("int").alias("__own"), F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"))
    return each.select("fold", F.when(F.col("__own") == F.col("fold"), "val").otherwise("train").alias("side"), id_col)


def fold_positions(df: DataFrame, pos: str, partition: str = PARTITION) -> DataFrame:
    """Training rows with their position among the training rows."""
    return with_position(df.where(F.col(partition) == "train"), pos, out="train_pos")


def leaking_groups(df: DataFrame, group: str, partition: str = PARTITION) -> DataFrame:
    """Groups that lie in more than one partition."""
    parts = F.count_distinct(partition)
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(parts.cast("long").alias("n_partitions")).where("n_partitions > 1")


def overlapping_folds(folds: DataFrame, id_col: str) -> DataFrame:
    """Ids that a fold both trains and validates on."""
    return folds.groupBy("fold", id_col).agg(F.count_distinct("side").alias("n_sides")).where("n_sides > 1")
