"""The axis of a block of features, from its headers alone, and the order of columns across partitions."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from ..errors import SpecError

#: What the axis of a unit is called (fixed values).
NAMES = {"nm": "wavelength", "cm-1": "wavenumber", "index": "index", "text": "feature", "none": "feature"}


@dataclass(frozen=True)
class Axis:
    name: str
    unit: str | None
    coordinates: tuple[Decimal, ...] | None


def axis_of(headers: list[str], unit: str | None = None) -> Axis:
    """Coordinates are the headers as exact decimal numbers; if any header is none, there are none."""
    try:
        found = tuple(Decimal(h.strip()) for h in headers)
    except (InvalidOperation, AttributeError):
        found = ()
    if not found or not all(x.is_finite() for x in found):
        return Axis(NAMES.get(unit or "text", "feature"), unit, None)
    return Axis(NAMES.get(unit or "index", "feature"), unit, found)


def permutation(reference: list[str], other: list[str]) -> list[int]:
    """Where each column of the reference is among the other ones: by coordinate if all have one, else by header. It must be one to one."""
    a, b = axis_of(reference).coordinates, axis_of(other).coordinates
    left, right = (list(a), list(b)) if a and b else (list(reference), list(other))
    if len(left) != len(right) or len(set(left)) != len(left) or set(left) != set(right):
        raise SpecError("the columns of two partitions are not the same ones")
    return [right.index(x) for x in left]
