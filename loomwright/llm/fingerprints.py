"""Document fingerprints: a threshold-scaled sketch of word shingles, with DataFrame functions only.

A fingerprint holds every distinct shingle hash below a fixed fraction of the hash range (the least hash where none is
below), in order. So it grows with the text, and the share of one sketch found in another estimates containment however
unequal the documents are. merged() makes of two sketches exactly the sketch of both sets of shingles: a least hash that
stands in for an empty sketch goes as soon as the other one has a hash below the fraction.

Equal texts have equal fingerprints. A null or empty text, or one without a word, has the empty fingerprint; two empty
ones have likeness 1, an empty and another one 0. Rows with equal ids are ordered by their texts, rows without an id come
last; repeated rows are fingerprinted each. Ids can be any 64-bit integers. An empty table gives an empty result; columns
other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts
from .native import BITS, WIDTH, shingled

#: One shingle in so many is kept.
SCALE = 4
#: Documents that are put in order together, about, and the most ranges of them.
TOGETHER, RANGES = 1024, 4096


def sketched(df: DataFrame, text: str, out: str, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """df with the array `out` of the sketch of `text`."""
    all_, low = f"__all_{out}", f"__low_{out}"
    df = shingled(df, text, all_, width)
    df = df.withColumn(low, F.filter(all_, lambda h: h < F.lit((1 << BITS) // scale)))
    kept = F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low))).otherwise(F.slice(F.array_sort(F.array(F.array_min(all_))), 1, F.least(F.size(all_), F.lit(1))))
    return df.withColumn(out, kept).drop(all_, low)


def spelled(sketch: str | Column) -> Column:
    """A sketch as text: 16 hex digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b holds too."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: str | Column, b: str | Column, scale: int = SCALE) -> Column:
    """The sketch of the shingles of both sketches' texts."""
    both = F.array_sort(F.array_distinct(F.concat(a, b)))
    low = F.filter(both, lambda h: h < F.lit((1 << BITS) // scale))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, F.lit(1), F.least(F.size(both), F.lit(1))))


def merge_sketches(df: DataFrame, by: list[str], sketch: str = "sketch", scale: int = SCALE) -> DataFrame:
    """One merged sketch for each key; hashes are made distinct before they are gathered, so that a group costs what its sketch holds."""
    keys = df.select(*by).distinct()
    each = df.select(*by, F.explode(sketch).alias("h")).distinct()
    whole = each.groupBy(*by).agg(F.collect_list("h").alias("__all"))
    out = keys.alias("k").join(whole.alias("w"), [F.col(f"k.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by], "left")
    none = F.array().cast("array<bigint>")
    return out.select(*[F.col(f"k.{c}") for c in by], merged(F.coalesce("__all", none), none, scale).alias(sketch))


def with_next(rows: DataFrame, prepare, values: list[str], ids: str = "doc_id", ties: str = "text", prefix: str = "next_", together: int = TOGETHER, most: int = RANGES) -> DataFrame:
    """prepare(rows), each row with the `values` (never null) of the row after it in descending order of ids (then of `ties`); the last has the first's.

    Rows are put in order within ranges of ids that hold about as many rows each (about `together`, in at most `most`
    ranges), whatever the ids; their bounds are quantiles. Only the first row of a range travels to the range before it.
    """
    n = rows.count()
    parts = max(1, min(most, n // together))
    cuts = rows.agg(F.percentile_approx(ids, [k / parts for k in range(1, parts)], max(10_000, 20 * parts)).alias("x")).first()["x"] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    # binary search by falling powers of two: the number of bounds at or below an id
    bounds, powers = F.lit(cuts) if cuts else F.array().cast("array<bigint>"), [1 << k for k in range(len(cuts).bit_length())][::-1]
    range_of = F.lit(0)
    if cuts:
        range_of = F.aggregate(F.lit(powers), F.lit(0), lambda a, p: a + F.when(F.get(bounds, a + p - 1) <= F.col(ids), p).otherwise(0))
    rows = rows.withColumn("__range", F.when(F.col(ids).isNull(), F.lit(-1)).otherwise(range_of))

    first = rows.groupBy("__range").agg(F.max(ids).alias("__id"))
    order = Window.orderBy(F.col("__range").desc())  # of at most `most` + 1 rows
    after = first.select("__range", F.coalesce(F.lead("__range").over(order), F.max("__range").over(Window.partitionBy())).alias("__after"))
    heads = rows.join(F.broadcast(first.select(F.col("__range").alias("__of"), "__id")), (F.col("__range") == F.col("__of")) & F.col(ids).eqNullSafe(F.col("__id")))
    heads = prepare(heads).groupBy(F.col("__range").alias("__after")).agg(F.min_by(F.struct(*values), F.col(ties)).alias("__head"))
    heads = after.join(heads, "__after").select("__range", "__head")

    # dealt by range first and prepared then: what is prepared need not be shuffled, nor any text twice
    order = Window.partitionBy("__range").orderBy(F.col(ids).desc_nulls_last(), F.col(ties))
    rows = prepare(rows.repartition("__range")).withColumns({f"__{v}": F.lead(v).over(order) for v in values})
    rows = rows.join(heads, "__range").withColumns({prefix + v: F.coalesce(f"__{v}", F.col("__head")[v]) for v in values})
    return rows.drop("__range", "__head", *[f"__{v}" for v in values])


def edited_text(text: str, following: Column) -> Column:
    """text with its last floor(n/2) code points replaced by as many first ones, or all, of the following text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, sketch of every text."""
    rows = sketched(texts(docs, id_col=id_col, text_col=text_col), "text", "sketch", scale)
    return rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "sketch")


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """Every text's sketch beside those of its edited text and of the next document: doc_id, n_chars, edited_sha256, sketch, edited, next_sketch."""
    rows = with_next(texts(docs, id_col=id_col, text_col=text_col), lambda df: sketched(df, "text", "sketch", scale), ["text", "sketch"])
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "sketch", edited_text("text", F.col("next_text")).alias("edited_text"), "next_sketch")
    return sketched(rows, "edited_text", "edited", scale).select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "sketch", "edited", "next_sketch")
