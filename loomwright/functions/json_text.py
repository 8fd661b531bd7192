"""JSON in one spelling, and read without guesses."""

from __future__ import annotations

import hashlib
import json
import math
import re
from decimal import Decimal

from ..errors import DataError

LOW, HIGH = -(2**63), 2**64 - 1


def canonical_json(value) -> str:
    """Keys sorted, two spaces of indent, the shortest spelling of each float; NaN and infinities are refused."""

    def check(x):
        if isinstance(x, float) and not math.isfinite(x):
            raise DataError(f"{x} has no JSON")
        if isinstance(x, dict):
            for k, v in x.items():
                if not isinstance(k, str):
                    raise DataError(f"the key {k!r} is no text")
                check(v)
        elif isinstance(x, (list, tuple)):
            for v in x:
                check(v)

    check(value)
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def checked_number(text: str) -> int | float:
    """The number that a JSON text spells: integers from -2**63 to 2**64 - 1; no double may overflow, nor become zero by underflow."""
    if re.fullmatch(r"-?\d+", text):
        n = int(text)
        if not LOW <= n <= HIGH:
            raise DataError(f"the integer {text} is out of range")
        return n
    x = float(text)
    if math.isinf(x) or x == 0 and Decimal(text) != 0:
        raise DataError(f"no double holds {text}")
    return x


def strict_json(text: str):
    """JSON without NaN and infinities, without numbers out of range, and without repeated keys."""

    def refuse(word):
        raise DataError(f"{word} is no JSON number")

    def pairs(items):
        keys = [k for k, _ in items]
        if len(set(keys)) != len(keys):
            raise DataError("a key is there twice")
        return dict(items)

    try:
        return json.loads(text, parse_int=checked_number, parse_float=checked_number, parse_constant=refuse, object_pairs_hook=pairs)
    except json.JSONDecodeError as e:
        raise DataError(str(e)) from None


def metadata_decimal(value) -> Decimal:
    """A finite number, or a text that spells one, as an exact decimal."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise DataError(f"{value!r} is no number")
    text = repr(value) if isinstance(value, float) else str(value).strip()
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        raise DataError(f"{value!r} is no finite number")
    return Decimal(text)


def rounded(x: float, digits: int = 6) -> float:
    """Half to even, without a negative zero."""
    return round(x, digits) + 0.0 if math.isfinite(x) else x


def identity_text(value) -> str:
    """An identity as text: texts as they are, integers in decimal, floats in their shortest spelling; of 1 to 128 letters, digits, _, . and -."""
    text = value if isinstance(value, str) else str(value) if isinstance(value, (bool, int)) else repr(float(value))
    if not re.fullmatch(r"[A-Za-z0-9_.\-]{1,128}", text):
        raise DataError(f"{value!r} is no identity")
    return text
