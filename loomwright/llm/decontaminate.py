"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only.

Documents are partitioned by size: class c holds those of up to 2**c distinct shingles. In class c the hash range is
cut into 2**(c+1) bins and a document's signature is its least shingle hash in each bin (one-permutation MinHash), so
that a bin holds half a shingle on average and a long document keeps as large a share of its shingles as a short one.
An item has one signature for each class. A shared bin minimum makes a candidate: an item of q shingles of which a
share s is in the document goes unseen with a probability of up to about 0.21**(q*s).

That is too much for items of few shingles, so items of which a document may hold fewer than SURE shingles are joined
exactly beside it: a document that lacks at most k of an item's shingles holds one of any k + 1 of them, so the k + 1
least are looked up among all shingles of all documents. Candidates are verified exactly: the share of the item's
distinct shingles that the document holds must reach the threshold.

Nulls, empty texts and texts without a word match nothing. An item of one to four words has one shingle of all its
words and matches documents of just these words. Rows with equal ids are one document (or item) with all their shingles,
rows without an id likewise; without_contaminated() goes by the text alone, so that ids may repeat or be null there.
Empty tables give an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, texts
from .native import BITS, WIDTH, exploded, shingled

THRESHOLD = 0.8
#: With so many shingles in common a signature misses with a probability below 0.21**24 = 6e-17.
SURE = 24
#: Bytes of a small side (items, candidates) up to which it is sent to all executors.
BROADCAST_BYTES = 48 << 20


def size_class(size: Column) -> Column:
    """The least c with size <= 2**c."""
    return F.ceil(F.log2(F.greatest(size, F.lit(1)))).cast("int")


def minima(ordered: str, size_class: str) -> Column:
    """The least hash of each bin, of hashes in order: those whose bin is not that of the hash before; each hashed with the class.

    The class is no join key of its own: the filter that a join puts on its keys would be pushed below the projections
    that make the shingles, and inline them.
    """
    bin_of = f"shiftright({{}}, {BITS - 1} - {size_class})"
    least = f"filter({ordered}, (h, i) -> i = 0 or {bin_of.format('h')} <> {bin_of.format(f'get({ordered}, i - 1)')})"
    return F.expr(f"transform({least}, h -> xxhash64({size_class}, h))")


def _small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def find_contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment: every pair in which a document holds that share of an item."""
    sets = lambda df: df.withColumn("hashes", F.sort_array(F.array_distinct("shingles"))).drop("shingles", "text")
    wanted = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    wanted = exploded(shingled(wanted, "text", "shingles", width), F.col("shingles"), "item_id").distinct()
    wanted = stored(wanted.join(wanted.groupBy("item_id").agg(F.count("*").alias("item_shingles")), "item_id"), "items")
    item_rows = wanted.count()

    found = sets(shingled(texts(docs, id_col=id_col, text_col=text_col), "text", "shingles", width))
    found = found.withColumn("class", size_class(F.size("hashes")))
    # an item's shingles that a document must hold, and as many of them as cannot all be missing
    needed = F.ceil(F.lit(threshold) * F.size("hashes") - 1e-9)
    short = F.slice("hashes", F.lit(1), (F.size("hashes") - F.greatest(needed, F.lit(1)) + 1).cast("int"))
    # no text has more shingles than words, nor a word less than a byte and a gap
    longest = docs.agg(F.max(F.octet_length(text_col))).first()[0] or 0
    classes = F.sequence(F.lit(0), F.lit((longest // 2 + 1).bit_length()))
    per_item = wanted.groupBy("item_id").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))
    least = stored(exploded(per_item.where(needed < SURE), short, "item_id"), "short-items")
    # without short items no document's shingles are sent along
    looked_up = F.concat(minima("hashes", "class"), "hashes") if least.limit(1).count() else minima("hashes", "class")
    signed = exploded(found, looked_up, "doc_id")
    per_item = per_item.select("item_id", "hashes", F.explode(classes).alias("class"))
    per_item = exploded(per_item, minima("hashes", "class"), "item_id").unionByName(least)
    hits = signed.join(_small(per_item, item_rows * BITS, 24), "hash").select("doc_id", "item_id").distinct()
    hits = stored(hits, "candidates")

    n = hits.count()
    again = texts(docs, id_col=id_col, text_col=text_col).join(_small(hits.select("doc_id").distinct(), n, 16), "doc_id", "left_semi")
    held = exploded(shingled(again, "text", "shingles", width), F.array_distinct("shingles"), "doc_id")
    both = held.join(_small(wanted, item_rows, 32), "hash").distinct()
    both = both.join(_small(hits, n, 24), ["doc_id", "item_id"], "left_semi")
    both = both.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"), F.max("item_shingles").alias("item_shingles"))
    return both.withColumn("containment", F.col("shared") / F.col("item_shingles")).where(F.col("containment") >= threshold)


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", **columns: str) -> DataFrame:
    """The documents that hold no item; rows with equal texts, whatever their ids, stay or go together."""
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    hits = find_contained(docs.select(key.alias("__key"), F.col(text_col).alias("__text")), items, threshold, "__key", "__text", **columns)
    gone = stored(hits.select(F.col("doc_id").alias("__gone")).distinct(), "contaminated")
    # the input may have columns of these names
    kept = docs.select(F.struct("*").alias("__row"), key.alias("__key"))
    return kept.join(_small(gone, gone.count(), 16), F.col("__key") == F.col("__gone"), "left_anti").select("__row.*")
