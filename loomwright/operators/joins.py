"""Joins as contracts: cardinality and coverage are checked before rows are joined."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import JoinError
from ..functions.numeric import exact_in_double
from .position import POS, stacked_positions

CARDINALITIES, COVERAGES = ("1:1", "m:1", "1:m"), ("complete", "warn", "drop", "error")
SHOWN = 10


@dataclass
class Audit:
    """What a join found: rows on either side, left keys without a match, warnings."""

    operation: str
    left_rows: int = 0
    right_rows: int = 0
    unmatched: int = 0
    examples: list = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def canonical_key(column: str | Column, kind: T.DataType, other: T.DataType | None = None) -> Column:
    """A key that equals another exactly when the cells do: NaN matches nothing, an integer equals an integral float, text never a number."""
    c = F.col(column) if isinstance(column, str) else column
    if other is None or kind == other:
        return F.when(~F.isnan(c), c + F.lit(0.0).cast(kind)) if isinstance(kind, (T.DoubleType, T.FloatType)) else c
    if isinstance(kind, T.IntegralType) and isinstance(other, T.IntegralType):
        return c.cast("long")
    if isinstance(kind, T.NumericType) and isinstance(other, T.NumericType):
        if isinstance(kind, T.IntegralType):
            return F.concat(F.lit("i"), c.cast("string"))
        whole = (c == F.floor(c)) & (F.abs(c) < 9.3e18)
        return F.when(F.isnan(c), None).when(whole, F.concat(F.lit("i"), c.cast("decimal(20,0)").cast("string"))).otherwise(F.concat(F.lit("f"), F.hex(c.cast("double").cast("string"))))
    return F.concat(F.lit(kind.simpleString()[:3] + ":"), c.cast("string"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number; missing keys count as equal to each other."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def unmatched_keys(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str]) -> DataFrame:
    """Distinct left keys that no right row has, a missing key among them."""
    return _keyed(left, left_on, right, right_on).join(_keyed(right, right_on, left, left_on), _names(left_on), "left_anti").select(*left_on).distinct()


def _names(on: list[str]) -> list[str]:
    return [f"__key{i}" for i in range(len(on))]


def _keyed(df: DataFrame, on: list[str], other: DataFrame, other_on: list[str]) -> DataFrame:
    return df.withColumns({n: canonical_key(a, df.schema[a].dataType, other.schema[b].dataType) for n, a, b in zip(_names(on), on, other_on, strict=True)})


def key_summary(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str]) -> DataFrame:
    """One row for each key of either side: how many rows it has there (n_left, n_right), the key as the left has it, and its first left position."""
    names = _names(left_on)
    first = F.min(POS) if POS in left.columns else F.lit(None).cast("long")
    own = F.first(F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(left_on)]))
    other = F.first(F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(right_on)]))
    a = _keyed(left, left_on, right, right_on).groupBy(*names).agg(F.count("*").alias("n_left"), first.alias("at"), own.alias("key"))
    b = _keyed(right, right_on, left, left_on).groupBy(*names).agg(F.count("*").alias("n_right"), other.alias("right_key"))
    return a.join(b, names, "full_outer")


def contract_join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str] | None = None, cardinality: str = "1:1", coverage: str = "complete", right_name: str = "right", check: bool = True) -> tuple[DataFrame, Audit]:
    """left with right's payload. The left key stays, the right one goes; a payload name that left has too becomes `name__right_name`.

    1:1 refuses repeated keys on both sides, m:1 on the right, 1:m on the left. coverage: complete and error refuse left
    keys without a match (naming ten, or the first by position), warn keeps their rows, drop drops them. All of this is
    one aggregate over the keys' summary, in which either side is grouped by key once; no side is broadcast but by
    Spark's own choice from its size.
    """
    right_on = right_on or left_on
    if cardinality not in CARDINALITIES or coverage not in COVERAGES:
        raise JoinError(f"unknown contract {cardinality} {coverage}")
    if not left_on or len(left_on) != len(right_on):
        raise JoinError(f"{len(left_on)} key columns on the left, {len(right_on)} on the right")
    for side, df, keys in (("left", left, left_on), ("right", right, right_on)):
        if absent := [k for k in keys if k not in df.columns]:
            raise JoinError(f"the {side} side has no column {absent[0]!r}")
    payload = [c for c in right.columns if c not in right_on]
    renamed = {c: f"{c}__{right_name}" for c in payload if c in left.columns}
    if clash := [n for n in renamed.values() if n in left.columns or n in payload]:
        raise JoinError(f"the name {clash[0]} is taken")
    audit = Audit(f"join {cardinality} {coverage}")
    if check:
        keys = key_summary(left, right, left_on, right_on)
        twice = lambda side, key: F.max(F.when(F.col(side) > 1, F.struct(F.col(side), F.col(key).cast("string").alias("key"))))
        gap = F.col("n_right").isNull()
        row = keys.agg(F.sum("n_left").alias("l"), F.sum("n_right").alias("r"), twice("n_left", "key").alias("l2"), twice("n_right", "right_key").alias("r2"), F.count_if(gap).alias("gaps"), F.min_by("key", F.when(gap, F.coalesce("at", F.lit(0)))).alias("first")).first()
        audit.left_rows, audit.right_rows = row["l"] or 0, row["r"] or 0
        for side, found, bad in (("left", row["l2"], ("1:1", "1:m")), ("right", row["r2"], ("1:1", "m:1"))):
            if cardinality in bad and found is not None:
                raise JoinError(f"{side} key {found['key']} is on {found[0]} rows; {cardinality} allows one")
        if row["gaps"]:
            shown = [row["first"]] if coverage == "error" else [r["key"] for r in keys.where(gap).orderBy("at").limit(SHOWN).select("key").collect()]
            audit.unmatched, audit.examples = row["gaps"], [tuple(x) for x in shown]
            if coverage in ("complete", "error"):
                raise JoinError(f"no right row for the left key {audit.examples[0]}" if coverage == "error" else f"{row['gaps']} left keys have no right row: {audit.examples}")
            if coverage == "warn":
                audit.warnings.append(f"{row['gaps']} left keys have no right row")
    side = _keyed(right, right_on, left, left_on).select(*_names(right_on), *[F.col(f"`{c}`").alias(renamed.get(c, c)) for c in payload])
    how = "inner" if coverage == "drop" else "left"
    return _keyed(left, left_on, right, right_on).join(side, _names(left_on), how).drop(*_names(left_on)), audit


def row_order_join(left: DataFrame, right: DataFrame, right_name: str = "right") -> DataFrame:
    """Rows of equal position side by side; both need positions, and as many rows. A name that left has too becomes `right_name__name`."""
    if bad := [n for n, df in (("left", left), ("right", right)) if POS not in df.columns]:
        raise JoinError(f"the {bad[0]} side's rows have no order: read them from a file, or name a key")
    if left.count() != right.count():
        raise JoinError("row order needs as many rows on both sides")
    clash = {c: f"{right_name}__{c}" for c in right.columns if c in left.columns and c != POS}
    if taken := [n for n in clash.values() if n in left.columns or n in right.columns]:
        raise JoinError(f"the name {taken[0]} is taken")
    return left.join(right.withColumnsRenamed(clash), POS)


def merge_by_key(frames: list[DataFrame], keys: list[str], names: list[str] | None = None, coverage: str = "complete") -> DataFrame:
    """One-to-one joins from left to right."""
    names = names or [f"f{i}" for i in range(len(frames))]
    return reduce(lambda a, x: contract_join(a, x[0].drop(POS), keys, cardinality="1:1", coverage=coverage, right_name=x[1])[0], zip(frames[1:], names[1:], strict=True), frames[0])


def common_types(frames: list[DataFrame]) -> list[DataFrame]:
    """Frames whose columns of equal names have one type: text if any is text, double if integers and doubles meet (exactly, or refused)."""
    kinds: dict[str, set[str]] = {}
    for df in frames:
        for name, kind in df.dtypes:
            kinds.setdefault(name, set()).add(kind)
    whole, real = {"tinyint", "smallint", "int", "bigint"}, {"float", "double"}
    to = {}
    for name, found in kinds.items():
        if len(found) > 1:
            to[name] = "bigint" if found <= whole else "double" if found <= whole | real else "string"
    out = []
    for df in frames:
        own = dict(df.dtypes)
        cast = {n: k for n, k in to.items() if n in own and own[n] != k}
        if inexact := [n for n, k in cast.items() if k == "double" and own[n] == "bigint"]:
            bad = df.agg(*[F.count_if(~exact_in_double(F.col(f"`{n}`"))).alias(n) for n in inexact]).first()
            if odd := [n for n in inexact if bad[n]]:
                raise JoinError(f"{odd[0]} has integers that no double holds, and doubles in another input")
        out.append(df.withColumns({n: F.col(f"`{n}`").cast(k) for n, k in cast.items()}) if cast else df)
    return out


def concat_samples(frames: dict[str, DataFrame], origin: str = "origin", warnings: list[str] | None = None) -> DataFrame:
    """All rows, all columns; cells of columns that a frame lacks are null; origin names the frame. Positions, if all have them, follow each other."""
    tables = common_types(list(frames.values()))
    if all(POS in df.columns for df in tables):
        tables = stacked_positions(tables)
    if warnings is not None and len({frozenset(df.columns) for df in tables}) > 1:
        warnings.append("the stacked inputs have different columns; missing ones are null")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(origin, F.lit(n)) for n, df in zip(frames, tables, strict=True)])


def concat_features(frames: list[DataFrame], names: list[str]) -> DataFrame:
    """Columns side by side by row position; a repeated name becomes `frame__name`."""
    return reduce(lambda a, x: row_order_join(a, x[0], x[1]), zip(frames[1:], names[1:], strict=True), frames[0])


def align_cohort(cohort: DataFrame, source: DataFrame, id_col: str, strict: bool = False, present: str = "present") -> DataFrame:
    """Every cohort id once, with source's columns and whether it has a row there; ids that only source has are an error, with strict absent ones too."""
    extra = source.join(cohort.select(id_col), id_col, "left_anti").select(id_col).limit(1).collect()
    if extra:
        raise JoinError(f"{extra[0][0]} is not in the cohort")
    out = cohort.join(source.withColumn(present, F.lit(True)), id_col, "left").withColumn(present, F.coalesce(present, F.lit(False)))
    if strict and (gap := out.where(~F.col(present)).select(id_col).limit(1).collect()):
        raise JoinError(f"{gap[0][0]} has no row")
    return out
