"""Word shingles as DataFrame expressions, for the operators that stay inside the JVM.

Words are maximal runs of letters and digits of the lower-cased text; a shingle is the hash of `width` words in a row.
A text of fewer words, but at least one, has one shingle of all its words; a text without a word has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 5
#: Shingle hashes are kept to 63 bits, so that they sort as they are.
BITS = 63
APART = r"[^\p{L}\p{N}]+"


def word_hashes(text: str | Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), APART), ""), lambda w: F.xxhash64(w))


def shingled(df: DataFrame, text: str, out: str, width: int = WIDTH) -> DataFrame:
    """df with the array `out` of the 63-bit shingle hashes of `text`, in order and with repeats.

    The word hashes are a column of their own in a projection below, so that a shingle reads them and never makes them
    again; at a fixed cost for each word, whatever the text's length.
    """
    w = f"__words_{out}"
    low = lambda c: c.bitwiseAND(F.lit((1 << BITS) - 1))
    part = lambda i, k: F.get(F.col(w), i + F.lit(k))
    many = F.transform(F.slice(F.col(w), F.lit(1), F.greatest(F.size(w) - F.lit(width - 1), F.lit(0))), lambda h, i: low(F.xxhash64(h, *[part(i, k) for k in range(1, width)])))
    few = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array(low(F.xxhash64(F.col(w)))))
    return df.withColumn(w, word_hashes(text)).withColumn(out, F.when(F.size(w) >= width, many).otherwise(few)).drop(w)


def exploded(df: DataFrame, hashes: Column, *keep: str) -> DataFrame:
    """A row for each hash. The outer form keeps the optimiser from putting a filter on the array below, into which it
    would inline the word hashes: they would then be made again for every single shingle."""
    return df.select(*keep, F.explode_outer(hashes).alias("hash")).where("hash is not null")
