"""What a text file's first records say about it: delimiter, decimal mark, header and the unit of its headers."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..sources import readers
from .detectors import is_id_name, wavelength_header

#: Shapes of headers by unit (fixed values); the first unit of which a shape fits counts, in this order.
UNIT_SHAPES = {
    "nm": (r"\d{3,4}(\.\d+)?(nm)?",),
    "cm-1": (r"\d{4,5}(\.\d+)?(cm-1|wavenumber)?",),
    "text": (r"[a-z].*", r"x_?\d+"),
    "index": (r"\d{1,3}",),
}


@dataclass
class Description:
    delimiter: str = ";"
    delimiter_candidates: list[str] = field(default_factory=list)
    decimal: str = "."
    has_header: bool = True
    header_unit: str = "text"
    wavelengths: tuple[str, float] | None = None
    names: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)


def is_number(cell: str, decimal: str = ".") -> bool:
    cell = cell.strip()
    return bool(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", cell.replace(",", ".") if decimal == "," else cell, re.I))


def decimal_mark(rows: list[list[str]], skip: int | None = None) -> tuple[str, float]:
    """Point or comma, by which of them stands alone in more cells that spell numbers; commas that only part thousands are no decimal marks. skip: a column not to look at."""
    cells = [c.strip() for r in rows[1:] for i, c in enumerate(r) if i != skip]
    alone = {m: [c for c in cells if m in c and o not in c] for m, o in ((".", ","), (",", "."))}
    good = {m: [c for c in own if is_number(c, m)] for m, own in alone.items()}
    best = "," if len(good[","]) > len(good["."]) else "."
    score = min((len(good[best]) + 1) / (max(len(alone[best]), 1) + len(alone["." if best == "," else ","]) + 1), 1.0)
    if best == "," and all(re.fullmatch(r"[+-]?\d{1,3}(,\d{3})+", c) for c in good[","]):
        best = "."
    return best, score


def header(rows: list[list[str]], decimal: str = ".") -> tuple[bool, float]:
    """Whether the first record is a header: it has fewer numbers than the next nine, or is a wavelength axis."""
    if len(rows) < 2:
        return True, 0.5
    share = lambda r: sum(is_number(c, decimal) for c in r) / len(r)
    after = [share(r) for r in rows[1:10] if r]
    if not rows[0] or not after:
        return True, 0.5
    first, mean = share(rows[0]), sum(after) / len(after)
    if first < mean - 0.3:
        return True, min(2 * (mean - first), 1.0)
    numbers = [c.strip().replace(decimal, ".") for c in rows[0] if is_number(c, decimal)]
    if first > 0.9 and (found := wavelength_header(numbers)):
        return True, found[1]
    named = [c for c in rows[0] if not is_number(c, decimal)]
    if named and (any(is_id_name(c) for c in named) or all(is_number(r[i], decimal) for i, c in enumerate(rows[0]) if c in named for r in rows[1:10] if i < len(r) and r[i].strip())):
        return True, 0.6
    return (False, 0.7) if abs(first - mean) < 0.1 else (True, 0.5)


def header_unit(names: list[str]) -> tuple[str, float]:
    """The unit that most headers look like; numbers are confirmed by their range."""
    names = [n.strip() for n in names if n.strip()]
    votes = dict.fromkeys(UNIT_SHAPES, 0)
    for n in names:
        if unit := next((u for u, shapes in UNIT_SHAPES.items() if any(re.fullmatch(s, n, re.I) for s in shapes)), None):
            votes[unit] += 1
    if not sum(votes.values()):
        return "text", 0.5
    best = max(votes, key=votes.get)
    if best in ("nm", "cm-1") and all(is_number(n) for n in names):
        low, high = min(map(float, names)), max(map(float, names))
        if low >= 350 and high <= 2500:
            return "nm", 0.8
        if low > 2500 and high <= 12500:
            return "cm-1", 0.8
    return best, votes[best] / sum(votes.values())


def describe_records(records: list[str], delimiter: str | None = None, decimal: str | None = None) -> Description:
    out = Description()
    found = readers.delimiter_scores(records)
    if delimiter:
        out.delimiter, out.scores["delimiter"] = delimiter, 1.0
    elif found:
        best = max(found.values())
        equal = [d for d, s in found.items() if s == best]
        out.delimiter, out.scores["delimiter"] = (";" if ";" in equal else equal[0]), best / 10
        if len(equal) > 1 and ";" not in equal:
            out.delimiter_candidates = equal
    rows = list(csv.reader([r for r in records if r], delimiter=out.delimiter))
    if not rows:
        return out
    out.decimal, out.scores["decimal"] = (decimal, 1.0) if decimal else decimal_mark(rows)
    out.has_header, out.scores["header"] = header(rows, out.decimal)
    if out.has_header:
        out.names = readers.mangled([c.strip() for c in rows[0]])
        out.header_unit, out.scores["unit"] = header_unit(out.names)
        numbers = [n for n in out.names if is_number(n)]
        out.wavelengths = wavelength_header(numbers) if numbers else None
    else:
        out.names = [str(i) for i in range(len(rows[0]))]
    return out


def describe(spark: SparkSession, path: str, delimiter: str | None = None, decimal: str | None = None) -> Description:
    records = readers.sample(spark, path)
    if records:
        records[0] = records[0].removeprefix("﻿")
    return describe_records(records, delimiter, decimal)
