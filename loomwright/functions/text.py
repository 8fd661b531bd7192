"""Small text functions of the specification's operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def filename_stem(path: Column) -> Column:
    """The last part of a path without its extension, a compound one as a whole."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(F.regexp_replace(name, r"(\.[A-Za-z0-9]+)\.(gz|zip)$", ""), r"\.[A-Za-z0-9]+$", "")


def strip_suffix(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def identity_text(value: Column) -> Column:
    """An identity as text, null where it is not of letters, digits, _, . and -, 1 to 128 of them."""
    t = value.cast("string")
    return F.when(t.rlike(r"^[A-Za-z0-9_.-]{1,128}$"), t)
