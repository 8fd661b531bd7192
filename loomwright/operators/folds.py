"""Folds that are declared: inline, or in a file. All become rows (fold, side, pos); pos is a position in the whole table.

fold int counts from 0, side is train or val. Only training rows may be in a fold; translated() checks that, and gives
each row its position among the training rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SpecError
from ..sources import readers
from .partitions import MOST_FOLDS, PARTITION
from .position import POS, with_position

SCHEMA = "fold int, side string, pos long"
#: Columns that may name the row in a file of assignments, the first that is there (fixed values).
ROW_NAMES = ("sample_id", "id", "index", "sample")


def listed(spark: SparkSession, folds: list[dict]) -> DataFrame:
    """Inline folds: objects with lists of positions under train, and under val or test."""
    rows = []
    if not isinstance(folds, list):
        raise SpecError("folds are a list of objects with train and val")
    for n, one in enumerate(folds):
        if not isinstance(one, dict):
            raise SpecError(f"fold {n} is no object with train and val")
        for side, own in (("train", one.get("train", [])), ("val", one.get("val", one.get("test", [])))):
            if not isinstance(own, list) or not all(type(i) is int for i in own):
                raise SpecError(f"fold {n}: {side} is no list of integers")
            rows += [(n, side, i) for i in own]
    return spark.createDataFrame(rows, SCHEMA)


def _integers(df: DataFrame, names: list[str]) -> DataFrame:
    if odd := [c for c, kind in df.select(*[f"`{c}`" for c in names]).dtypes if kind != "bigint" and df.where(F.col(f"`{c}`").isNotNull()).limit(1).count()]:
        raise SpecError(f"column {odd[0]} of the folds holds other things than integers")
    return df.select(*[F.col(f"`{c}`").cast("long").alias(c) for c in names])


def _in_every_fold(pos: DataFrame, numbers: list[int]) -> DataFrame:
    return pos.select("pos", F.explode(F.lit(numbers).cast("array<int>")).alias("fold"))


def from_columns(df: DataFrame) -> DataFrame:
    """Each column lists the positions one fold trains on; it validates on all that other columns list."""
    named = _integers(df, [c for c in df.columns if c != POS])
    cells = F.array(*[F.struct(F.lit(i).alias("fold"), F.col(f"`{c}`").alias("pos")) for i, c in enumerate(named.columns)])
    train = named.select(F.inline(cells)).where("pos is not null")
    every = _in_every_fold(train.select("pos").distinct(), list(range(len(named.columns))))
    val = every.join(train, ["pos", "fold"], "left_anti")
    return train.select("fold", F.lit("train").alias("side"), "pos").unionByName(val.select("fold", F.lit("val").alias("side"), "pos"))


def from_assignments(df: DataFrame) -> DataFrame:
    """Each row names the fold that validates on it (column fold); all other folds train on it. Rows without a name count from 0."""
    named = {c.lower(): c for c in df.columns if c != POS}
    at = next((named[c] for c in ROW_NAMES if c in named), None)
    if at is None:
        at = POS  # the row's place in the file
    own = _integers(df, [named["fold"], at]).toDF("label", "pos")
    found = [r[0] for r in own.select("label").distinct().limit(MOST_FOLDS + 2).collect()]
    if None in found:
        raise SpecError("a row of the folds has no fold")
    if len(found) > MOST_FOLDS:
        raise SpecError(f"there are more than {MOST_FOLDS} folds")
    labels = sorted(found)
    numbers = F.array_position(F.lit(labels).cast("array<bigint>"), F.col("label")).cast("int") - 1
    val = own.select("pos", numbers.alias("fold"))
    train = _in_every_fold(own.select("pos").distinct(), list(range(len(labels)))).join(val, ["pos", "fold"], "left_anti")
    return val.select("fold", F.lit("val").alias("side"), "pos").unionByName(train.select("fold", F.lit("train").alias("side"), "pos"))


def _alternating(lines: list[str]) -> list[dict]:
    kept = [x for x in map(str.strip, lines) if x]
    if len(kept) % 2:
        raise SpecError("a text file of folds has lines for train and val in turn")
    try:
        sides = [[int(i) for i in x.split(",") if i.strip()] for x in kept]
    except ValueError as e:
        raise SpecError(f"a text file of folds holds {e}") from None
    return [{"train": a, "val": b} for a, b in zip(sides[::2], sides[1::2], strict=True)]


def read_folds(spark: SparkSession, path: str, kind: str = "auto") -> DataFrame:
    """Folds from a file: csv of columns or of assignments, json, yaml, or txt of alternating lines."""
    kind = readers.extension(path).lstrip(".") if kind == "auto" else kind
    if kind == "csv":
        df = readers.read(spark, path, delimiter=",")
        return from_assignments(df) if "fold" in {c.lower() for c in df.columns} else from_columns(df)
    if kind not in ("json", "yaml", "yml", "txt"):
        raise SpecError(f"no folds are read from {kind}")
    text = spark.read.text(path, wholetext=True).first()
    text = text[0] if text else ""
    if kind == "txt":
        return listed(spark, _alternating(text.splitlines()))
    try:
        if kind == "json":
            return listed(spark, json.loads(text))
        import yaml

        return listed(spark, yaml.safe_load(text))
    except ImportError:
        raise SpecError("folds in YAML need the yaml package") from None
    except json.JSONDecodeError as e:
        raise SpecError(f"folds: {e}") from None


def translated(df: DataFrame, folds: DataFrame, pos: str = POS, partition: str = PARTITION) -> DataFrame:
    """fold, side, pos, train_pos. Positions must be those of training rows, once in a fold.

    The training rows are ranked by ranges of their position, so no task orders them all.
    """
    twice = folds.groupBy("fold", "pos").agg(F.count("*").alias("n"), F.count_distinct("side").alias("sides")).where("n > 1").limit(1).collect()
    if twice:
        raise SpecError(f"fold {twice[0]['fold']} has position {twice[0]['pos']} " + ("on both sides" if twice[0]["sides"] > 1 else "twice"))
    ranked = with_position(df.where(F.col(partition) == "train").select(F.col(pos).alias("pos")), "pos", out="train_pos")
    out = folds.join(ranked, "pos", "left")
    if bad := out.where("train_pos is null").limit(1).collect():
        raise SpecError(f"fold {bad[0]['fold']}: position {bad[0]['pos']} is no training row")
    return out.select("fold", "side", "pos", "train_pos")


def provenance(df: DataFrame, folds: DataFrame, id_col: str, pos: str = POS) -> DataFrame:
    """fold, side, id of every row of the folds; a row without an id is an error, as ids are named for all or for none."""
    out = folds.join(df.select(F.col(pos).alias("pos"), F.col(id_col)), "pos")
    if out.where(F.col(id_col).isNull()).limit(1).count():
        raise SpecError(f"a row of the folds has no {id_col}")
    return out.select("fold", "side", id_col)
