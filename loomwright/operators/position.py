"""Row positions: Spark's rows have no order, so order is a column. Readers stamp it; here it is made from keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POS = "__pos"
#: Rows that are ranked together, about, the most ranges, and values looked at for each range's bound.
TOGETHER, RANGES, LOOKED_AT = 100_000, 1000, 30


def _range_of(df: DataFrame, key: Column, n: int, together: int) -> Column:
    """The number of the range of key values that a row is in; the ranges hold about as many rows each, and missing keys come first.

    The bounds are quantiles of a few sampled values, used as literals: they only balance the work, and any bounds give
    the same positions.
    """
    parts = min(RANGES, -(-n // together))
    found = sorted(r[0] for r in df.select(key.alias("k")).where("k is not null").sample(min(1.0, LOOKED_AT * parts / n), 7).limit(4 * LOOKED_AT * parts).collect())
    cuts = sorted(set(found[:: max(1, len(found) // parts)][1:]))
    if not cuts:
        return F.lit(0)
    bounds, powers = F.array(*[F.lit(c) for c in cuts]), [1 << k for k in range(len(cuts).bit_length())][::-1]
    below = F.aggregate(F.lit(powers), F.lit(0), lambda a, p: a + F.when(F.get(bounds, a + p - 1) <= key, p).otherwise(0))
    return F.when(key.isNull(), F.lit(-1)).otherwise(below)


def with_position(df: DataFrame, *order: str | Column, out: str = POS, together: int | None = None) -> DataFrame:
    """df with the rows' positions 0, 1, ... in a total order.

    Rows are ranked within ranges of the first key and each range's offset is added, so that no task orders the table.
    """
    keys = [F.col(f"`{c}`") if isinstance(c, str) else c for c in order]
    together = together or TOGETHER
    n = df.count()
    if n <= together:
        return df.withColumn(out, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))
    ranged = df.withColumn("__range", _range_of(df, keys[0], n, together))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))).select("__range", F.coalesce("__before", F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return ranged.withColumn("__nth", nth).join(F.broadcast(before), "__range").withColumn(out, (F.col("__before") + F.col("__nth") - 1).cast("long")).drop("__range", "__nth", "__before")


def stacked_positions(frames: list[DataFrame], out: str = POS) -> list[DataFrame]:
    """Frames whose positions follow each other: those of each begin after the last of the one before."""
    before, shifted = 0, []
    for df in frames:
        shifted.append(df.withColumn(out, F.col(out) + F.lit(before)))
        if df is not frames[-1]:
            last = df.agg(F.max(out)).first()[0]
            before += 0 if last is None else last + 1
    return shifted


def take_by_id(df: DataFrame, id_col: str, ids: list, unique: bool = True) -> DataFrame:
    """The rows of the given ids in the given order; an id that is not there is an error."""
    from ..errors import DataError

    if unique and len(set(ids)) != len(ids):
        raise DataError("an id is asked for twice")
    wanted = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"__at long, {id_col} {df.schema[id_col].dataType.simpleString()}")
    out = wanted.join(df, id_col)
    if len(ids) and (missing := wanted.join(df.select(id_col).distinct(), id_col, "left_anti").limit(5).collect()):
        raise DataError(f"no row has the id {', '.join(str(r[id_col]) for r in missing)}")
    return out.orderBy("__at").drop("__at")
