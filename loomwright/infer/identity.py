"""Which columns identify samples, and how tables of one dataset belong together: single aggregates over each table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataError
from ..operators.position import POS
from .detectors import is_id_name, sample_id_score

#: Endings that mark replicates (fixed values); a number alone is none.
SUFFIXES = {"rep": r"(?i)[_\-. ](rep|replicate)[_\-. ]?\d+$", "r": r"(?i)[_\-. ]r\d+$", "scan": r"(?i)[_\-. ]scan[_\-. ]?\d+$", "dup": r"(?i)[_\-. ](dup|duplicate)[_\-. ]?\d*$", "brackets": r"[_\-. ]?\(\d+\)$", "letter": r"[_\-. ][A-Za-z]$"}


@dataclass(frozen=True)
class Profile:
    name: str
    dtype: str
    n_rows: int
    n_unique: int

    @property
    def uniqueness(self) -> float:
        return self.n_unique / self.n_rows if self.n_rows else 0.0


def profiles(df: DataFrame, columns: list[str] | None = None) -> list[Profile]:
    """Rows and distinct values (a missing one is a value) of columns: one aggregate for each, as several distinct counts in one would multiply the rows."""
    out = []
    for name, kind in df.dtypes:
        if name == POS or columns is not None and name not in columns:
            continue
        c = F.col(f"`{name}`")
        r = df.groupBy(c.alias("v")).agg(F.count("*").alias("n")).agg(F.count("*").alias("u"), F.sum("n").alias("n")).first()
        out.append(Profile(name, "string" if kind == "string" else "double" if kind in ("double", "float") else "other", r["n"] or 0, r["u"]))
    return out


def sample_id(df: DataFrame) -> tuple[str, float] | None:
    """The column most likely to identify samples, if its score is 0.5 or more; the first of equals. Only columns that can reach that are counted."""
    may = [n for n, k in df.dtypes if n != POS and (is_id_name(n) or sample_id_score(n, 1.0, "string" if k == "string" else "double" if k in ("double", "float") else "other") >= 0.5)]
    scored = [(p.name, sample_id_score(p.name, p.uniqueness, p.dtype)) for p in profiles(df, may)]
    best = max(scored, key=lambda x: x[1], default=None)
    return best if best and best[1] >= 0.5 else None


def audit(left: DataFrame, right: DataFrame, left_key: str, right_key: str, shown: int = 20) -> dict:
    """Counts and the first keys, as text, that the right table lacks, that only it has, and that the left has twice."""
    a = left.groupBy(F.col(f"`{left_key}`").cast("string").alias("k")).agg(F.count("*").alias("n"))
    b = right.groupBy(F.col(f"`{right_key}`").cast("string").alias("k")).agg(F.count("*").alias("m"))
    both = a.join(b, "k", "full_outer")
    tests = {"missing": "m is null", "extra": "n is null", "duplicates": "n > 1"}
    row = both.agg(F.count("n").alias("n_left"), F.count("m").alias("n_right"), *[F.count_if(F.expr(t)).alias(f"n_{k}") for k, t in tests.items()]).first()
    return row.asDict() | {k: [r[0] for r in both.where(t).orderBy("k").limit(shown).select("k").collect()] if row[f"n_{k}"] else [] for k, t in tests.items()}


def replicate_suffix(df: DataFrame, column: str) -> tuple[str, str, float] | None:
    """Kind, pattern and share of the replicate ending that most names have: half of them at least, and 1.5 names a sample or more without it."""
    name = F.col(f"`{column}`").cast("string")
    best = None
    for kind, pattern in SUFFIXES.items():
        base = df.groupBy(F.regexp_replace(name, pattern, "").alias("b")).agg(F.count("*").alias("n"), F.count_if(name.rlike(pattern)).alias("m"))
        r = base.agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count("*").alias("g")).first()
        if not r["n"] or r["m"] / r["n"] < 0.5 or r["n"] / r["g"] < 1.5:
            continue
        if best is None or r["m"] / r["n"] > best[2]:
            best = (kind, pattern, r["m"] / r["n"])
    return best


def relation(main: DataFrame, other: DataFrame, key: str) -> str | None:
    """How a table of metadata belongs to the main one by a key: 1:1 if it is unique there and has half the rows or more, m:1 if unique and has fewer."""
    if key not in main.columns or key not in other.columns:
        return None
    (there,) = profiles(other, [key])
    rows = main.count()
    if there.n_rows != there.n_unique or not there.n_rows:
        return None
    (here,) = profiles(main, [key])
    if here.n_unique == here.n_rows and there.n_rows >= rows / 2:
        return "1:1"
    return "m:1" if there.n_rows < rows else None


def generated_keys(anchor: DataFrame, others: dict[str, DataFrame]) -> dict[str, dict]:
    """Keys for joining a partition's tables to its features: a sample id that the features and the other table have.

    1:1 where it is unique on both sides and nothing is missing, m:1 where the features repeat it and the other does
    not. No key where neither holds, so that a join by it would lose rows.
    """
    found = sample_id(anchor)
    out = {}
    for name, df in others.items():
        if found is None or found[0] not in df.columns:
            continue
        a = audit(anchor, df, found[0], found[0])
        (there,) = profiles(df, [found[0]])
        if a["n_missing"] or there.n_unique != there.n_rows:
            continue
        out[name] = {"on": found[0], "how": "m:1" if a["n_duplicates"] else "1:1", "score": round(found[1], 3)}
    return out


def check_generated(df: DataFrame, key: str, decimal: str | None) -> None:
    """Refuse a key that was guessed when it misses cells, or when commas make it unclear what a cell of it is."""
    c = F.col(f"`{key}`")
    row = df.agg(F.count_if(c.isNull()).alias("gaps"), F.count_if(c.cast("string").rlike(r"^\d+,\d+$")).alias("pairs")).first()
    if row["gaps"]:
        raise DataError(f"the guessed key {key} misses {row['gaps']} cells: name a key")
    if row["pairs"] and decimal == ",":
        raise DataError(f"cells of the guessed key {key} have commas, which are decimal marks here: name a key")
