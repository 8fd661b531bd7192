"""Named processings: other values of a source's features, row by row, kept beside them as <name>__<feature>."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from .position import POS


def matched(features: list[str], names: list[str]) -> dict[str, str]:
    """Which column of a variation holds which feature: by name if all are there, by position if none is and the widths are equal."""
    there = set(features) & set(names)
    if len(there) == len(features):
        return {f: f for f in features}
    if there:
        raise SpecError(f"a variation has {len(there)} of {len(features)} features by name: all or none must be")
    if len(names) != len(features):
        raise SpecError(f"a variation has {len(names)} columns for {len(features)} features")
    return dict(zip(features, names, strict=True))


def with_variation(df: DataFrame, other: DataFrame, name: str, features: list[str], pos: str = POS) -> DataFrame:
    """df with the variation's columns; both have positions, which must be the same ones."""
    if not features:
        raise SpecError(f"variation {name} has no features to vary")
    if taken := [f for f in features if f"{name}__{f}" in df.columns]:
        raise SpecError(f"{name}__{taken[0]} is there already")
    named = matched(features, [c for c in other.columns if c != pos])
    kinds, own = dict(df.dtypes), dict(other.dtypes)
    numbers = ("double", "bigint", "float", "int")
    if odd := [f for f, c in named.items() if kinds[f] != own[c] and not (kinds[f] in numbers and own[c] in numbers)]:
        raise SpecError(f"variation {name} has {own[named[odd[0]]]} where {odd[0]} is {kinds[odd[0]]}")
    right = other.select(F.col(pos), *[F.col(f"`{c}`").cast(kinds[f]).alias(f"{name}__{f}") for f, c in named.items()])
    n, m = df.count(), right.count()
    if n != m:
        raise SpecError(f"variation {name} has {m} rows, and its source {n}")
    return df.join(right, pos)
