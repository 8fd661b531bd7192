"""The library's front: infer() guesses, load() assembles."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from .errors import SpecError
from .infer import identity
from .infer.engine import Plan, infer
from .operators.partitions import PARTITION
from .operators.position import POS
from .plans.planner import Dataset, assemble
from .sources import files, readers
from .spec.model import DatasetSpec, parse
from .spec.normalize import normalized

__all__ = ["infer", "load", "to_spec", "validate"]


def _arrays(spark: SparkSession, *parts) -> Dataset:
    df = readers.from_arrays(spark, *parts)
    roles = {"features": [c for c in df.columns if c[0] == "f" and c[1:].isdigit()], "targets": [c for c in df.columns if c[0] == "y" and c[1:].isdigit()], "weights": [], "ignore": []}
    roles["metadata"] = [c for c in df.columns if c not in (POS, PARTITION, *roles["features"], *roles["targets"])]
    return Dataset(df, roles)


def _document(spark: SparkSession, path: str) -> dict:
    text = spark.read.text(path, wholetext=True).first()
    text = text[0] if text else ""
    if path.lower().endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError:
        raise SpecError("a description in YAML needs the yaml package") from None
    return yaml.safe_load(text)


def to_spec(spark: SparkSession, what, base: str = ".", **options) -> tuple[DatasetSpec, str]:
    """The description of whatever load() takes, and the folder that its names are relative to."""
    for method in ("to_io_spec", "to_spec"):  # objects that describe themselves
        if hasattr(what, method) and not isinstance(what, (DatasetSpec, Plan)):
            what = getattr(what, method)()
    if isinstance(what, DatasetSpec):
        return what, base
    if isinstance(what, Plan):
        return what.accept(), what.base
    if isinstance(what, dict):
        config = normalized(what)
        if what.get("folder") or config.get("folder"):
            return infer(spark, config.get("folder") or what["folder"], base, **options).accept(), base
        return parse(config), base
    if isinstance(what, (str, os.PathLike)) and os.fspath(what).lower().endswith((".json", ".yaml", ".yml")):
        path = files.resolve(os.fspath(what), base, spark)[0]
        return parse(normalized(_document(spark, path))), path.rsplit("/", 1)[0] if "/" in path else base
    return infer(spark, what, base, **options).accept(), base


def load(spark: SparkSession, what, base: str = ".", frames: dict[str, DataFrame] | None = None, **options) -> Dataset:
    """A dataset from a description (dict, file or object), a plan, files, a folder, frames, or arrays: X, (X, y), (X, y, split), or a dict of them."""
    if isinstance(what, tuple) and 1 <= len(what) <= 3:
        return _arrays(spark, *what)
    if isinstance(what, dict) and {str(k).lower() for k in what} <= {"x", "y", "metadata", "split"} and hasattr(next(iter(what.values())), "__len__") and not any(isinstance(v, str) for v in what.values()):
        return _arrays(spark, what)
    if hasattr(what, "shape") and not isinstance(what, DataFrame):
        return _arrays(spark, what)
    guessed = not isinstance(what, (dict, DatasetSpec))
    spec, base = to_spec(spark, what, base, **options)
    if guessed and spec.sample_index.by == "id":  # what was guessed must hold
        for s in spec.sources:
            for path in [s.input] if isinstance(s.input, str) else []:
                p = s.params
                df = readers.read(spark, files.resolve(path, base, spark)[0], delimiter=p.delimiter or ";", decimal=p.decimal or ".", header=p.header is not False)
                for k in spec.sample_index.key:
                    if k in df.columns:
                        identity.check_generated(df, k, p.decimal)
    return assemble(spark, spec, base, frames)


def validate(what: dict) -> list[str]:
    """What is wrong with a description; nothing, if it can be read."""
    try:
        parse(normalized(what))
    except SpecError as e:
        return str(e).split("; ")
    return []
