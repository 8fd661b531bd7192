"""Column selectors and the split of columns into roles: names are resolved on the driver, from the schema alone."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import SpecError

ROLES = ("features", "targets", "metadata", "weights", "ignore")


@dataclass(frozen=True)
class Header:
    name: str
    dtype: str  # numeric, string, datetime or bool


def dtype_of(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "numeric"
    return "datetime" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "string"


def headers(df: DataFrame) -> list[Header]:
    return [Header(f.name, dtype_of(f.dataType)) for f in df.schema.fields]


def resolve(selector, columns: list[Header], taken: frozenset[str] | set[str] = frozenset()) -> list[str]:
    """The names that a selector stands for, in its own order.

    A number or list of numbers: positions, negative ones from the end; "a:b[:c]": a slice; a name or names; name_range:
    two names and what lies between; regex: found anywhere in the name; dtype; rest: what is not taken; auto: what a role
    takes by itself.
    """
    names = [c.name for c in columns]
    if isinstance(selector, bool) or selector is None:
        raise SpecError(f"{selector!r} selects nothing")
    if isinstance(selector, int):
        selector = [selector]
    if isinstance(selector, str):
        if selector == "rest":
            return [n for n in names if n not in taken]
        if selector in names:
            return [selector]
        if re.fullmatch(r"\s*-?\d*\s*:\s*-?\d*\s*(:\s*-?\d*\s*)?", selector):
            return names[slice(*[int(x) if x.strip() else None for x in selector.split(":")])]
        raise SpecError(f"there is no column {selector!r}")
    if isinstance(selector, (list, tuple)):
        out = []
        for x in selector:
            if isinstance(x, int) and not isinstance(x, bool):
                if not -len(names) <= x < len(names):
                    raise SpecError(f"position {x} is outside {len(names)} columns")
                out.append(names[x])
            elif x in names:
                out.append(x)
            else:
                raise SpecError(f"there is no column {x!r}")
        return out
    if not isinstance(selector, dict) or len(selector) != 1:
        raise SpecError(f"{selector!r} is no selector")
    (kind, value), = selector.items()
    match kind:
        case "index" | "indices" | "names" | "name" | "slice":
            return resolve(value, columns, taken)
        case "name_range":
            ends = [names.index(resolve(x, columns)[0]) for x in value]
            return names[min(ends) : max(ends) + 1]
        case "regex":
            return [n for n in names if re.search(value, n)]
        case "dtype":
            return [c.name for c in columns if c.dtype == value]
        case "rest":
            return [n for n in names if n not in taken]
        case "auto":
            return automatic(value, columns, taken)
    raise SpecError(f"there is no selector {kind!r}")


def automatic(role: str, columns: list[Header], taken: frozenset[str] | set[str] = frozenset(), candidates: tuple[str, ...] = ()) -> list[str]:
    """The first present candidate, or: features take all free numbers, targets the last, metadata all other free columns, ignore all."""
    free = [c for c in columns if c.name not in taken]
    if found := [n for n in candidates if n in {c.name for c in free}]:
        return found[:1]
    numbers = [c.name for c in free if c.dtype == "numeric"]
    if role == "weights":
        raise SpecError("weights need candidates")
    return {"features": numbers, "targets": numbers[-1:], "metadata": [c.name for c in free if c.dtype != "numeric"], "ignore": [c.name for c in free]}[role]


def split_roles(columns: list[Header], selectors: list[tuple[str, object]], exempt: tuple[str, ...] = (), strict: bool = True, identity: tuple[str, ...] = (), spare: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Columns by role. Selectors work in order, rest last; a column in two roles is an error unless not strict (the first keeps it).

    What is left is an error without a rest; exempt columns (keys) need no role and rest leaves them out, spare ones (that
    other sources join by, or that mark partitions) need none but rest takes them. Identity columns become metadata
    whatever their role.
    """
    out: dict[str, list[str]] = {r: [] for r in ROLES}
    owner: dict[str, str] = {}
    is_rest = lambda s: s == "rest" or isinstance(s, dict) and "rest" in s
    if sum(is_rest(s) for _, s in selectors) > 1:
        raise SpecError("only one selector can take the rest")
    for role, selector in sorted(selectors, key=lambda x: is_rest(x[1])):
        if role not in ROLES:
            raise SpecError(f"there is no role {role!r}")
        taken = set(owner) | set(exempt)
        if isinstance(selector, dict) and isinstance(selector.get("auto"), (list, tuple)):
            found = automatic(role, columns, taken, tuple(selector["auto"]))
        else:
            found = resolve(selector, columns, taken)
        for name in found:
            if name in owner:
                if strict and owner[name] != role:
                    raise SpecError(f"{name} is {owner[name]} and {role}")
                continue
            owner[name] = role
    if left := [c.name for c in columns if c.name not in owner and c.name not in (*exempt, *spare, *identity)]:
        raise SpecError(f"{left[0]} has no role")
    for c in columns:
        if c.name in identity:
            owner[c.name] = "metadata"
        if c.name in owner:
            out[owner[c.name]].append(c.name)
    if len(out["weights"]) > 1:
        raise SpecError("one column of weights at most")
    return out
