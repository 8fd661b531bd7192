"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

1. Equal texts are one: only the row with the least id of each goes on, the others take its class.
2. Shingles (five words of the lower-cased text, split at all but letters, digits and bytes over 127; a shorter text
   has one shingle of all its words) get their document frequency over the different texts by the blob exchange, so
   that a shingle weighs its count in the text times idf = ln(1 + N/df) / ln(1 + min(N, 1000)), held to [LEAST_IDF, 1]:
   the members of a large group of copies make their own shingles frequent, and unbounded weights would let the few
   edited ones outweigh all others. With 0.8 a pair in a group of any size is linked from a plain similarity of 0.834 on
   (of 0.889 with 1/2).
3. A text can only reach the threshold if shingles of other texts too make up that share of its weight; the rest,
   which is most of a corpus, ends here. This loses nothing.
4. BANDS x ROWS consistent weighted samples of each text left; a pair at 0.8 meets in no band with probability 0.0006.
5. Within a band's bucket each text is compared with the bucket's most central one only (the one whose shingles the most
   texts have: of a text and its edited copies the text itself, whatever its id), by exact weighted Jaccard similarity;
   links make components. Where a bucket still holds several components, a further round compares one text of each with
   one of another. So a hot bucket gives as many pairs as it has rows, never all pairs, and no bucket is gathered in
   one task.
6. The texts of buckets that hold several components even then are joined exactly: two texts at the threshold share a
   shingle of their prefixes (their rarest shingles, up to where the others weigh less than the threshold's share), so
   texts of different components that share one are compared, unless the weights from that shingle on rule them out.
   No link between two texts of a bucket is lost, and texts of one component are not compared again.

Nulls are empty texts. Texts without a word only match equal texts. Rows with equal ids and different texts take the
class of the least. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ANSWER, SENT, U64, Received, answered, chunk_of, dealt, flat, grouped, lean, mix, packed, packed_sorted, parts_for, sent, stored, text_bytes, texts, unpacked, unpacked_docs, unpacked_sorted, words

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 14, 4
ROUNDS = 2
LEAST_IDF = 0.8
#: Bytes of text of a chunk.
CHUNK_BYTES = 6 << 20
_APART = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])
_SETS = pa.schema([("doc_id", pa.int64()), ("bands", pa.list_(pa.int64())), ("n", pa.int32()), ("set", pa.binary()), ("total", pa.float64()), ("centre", pa.float64()), ("prefix", pa.list_(pa.int64())), ("rest", pa.list_(pa.float64()))])
_SETS_DDL = "doc_id long, bands array<long>, n int, set binary, total double, centre double, prefix array<long>, rest array<double>"


def _gamma_table(n: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution: the x with 1 - (1 + x) exp(-x) = p, by bisection."""
    p, low, high = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return low.astype(np.float32)


_GAMMA = _gamma_table(1 << 16)


def shingles(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each distinct shingle of each text, by row and then by hash."""
    row, h = words(*flat(pc.utf8_lower(column)), _APART)
    size = np.bincount(row, minlength=len(column))
    total = h.copy()
    for k in range(1, min(WIDTH, len(h))):
        total[: len(h) - k] = mix(total[: len(h) - k] * U64(0x9E3779B97F4A7C15) + h[k:])
    nth = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    whole = nth + WIDTH <= size[row]
    short = np.flatnonzero((size > 0) & (size < WIDTH))
    first = (np.cumsum(size) - size)[short]
    own = np.zeros(len(short), U64)
    for k in range(WIDTH - 1):
        own = np.where(size[short] > k, mix(own * U64(0x9E3779B97F4A7C15) + h[np.minimum(first + k, len(h) - 1)] + U64(k + 1)), own)
    rows, hashes = np.concatenate([row[whole], short]), np.concatenate([total[whole], own])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))


def idf(df: np.ndarray, n: float) -> np.ndarray:
    return np.clip(np.log1p(n / np.maximum(df, 1)) / np.log1p(min(max(n, 2), 1000)), LEAST_IDF, 1)


def consistent_samples(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples of each set: sets lie one after the other, each begins at one of starts."""
    sizes = np.diff(np.append(starts, len(hashes)))
    of = np.repeat(np.arange(len(starts)), sizes)
    logs = np.log(weights).astype(np.float32)
    out = np.empty((len(starts), n), U64)
    for k in range(n):
        u = mix(hashes + U64((k + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        r, c = _GAMMA[u & U64(0xFFFF)], _GAMMA[(u >> U64(16)) & U64(0xFFFF)]
        beta = (u >> U64(32)).astype(np.float32) * np.float32(2.0**-32)
        t = np.floor(logs / r + beta)
        a = np.log(c) - r * (t - beta + 1)
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == least[of])
        at = at[np.flatnonzero(np.diff(of[at], prepend=-1))]
        out[:, k] = mix(hashes[at] + t[at].astype(np.int64).astype(U64))
    return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(samples), bands), U64)
    for b in range(bands):
        k = np.full(len(samples), U64(b + 1))
        for r in range(rows):
            k = mix(k * U64(0x9E3779B97F4A7C15) + samples[:, b * rows + r])
        keys[:, b] = k
    return keys.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of sorted hashes and their weights."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    low = np.minimum(a[1][both], b[1][at[both]]).sum(dtype=np.float64)
    return float(low / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - low))


def prefixes(hashes: np.ndarray, weights: np.ndarray, df: np.ndarray, starts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each set: its weight; and, for every shingle of its prefix that other texts have, set, hash and the weight from it on.

    Shingles go by document frequency and hash, the same order for all sets. Those left out weigh less than the
    threshold's share of the set, so that two sets at the threshold have a prefix shingle in common.
    """
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(hashes))))
    order = np.lexsort((hashes, df, of))
    w = weights[order].astype(np.float64)
    total = np.add.reduceat(w, starts)
    before = np.cumsum(w) - w
    rest = total[of] - (before - before[starts][of])
    at = np.flatnonzero((rest >= threshold * total[of] * (1 - 1e-6)) & (df[order] > 1))
    return total, of[at], hashes[order][at], rest[at]


def _own(docs: pa.Table, right: pa.Table) -> pa.Table:
    """The chunk's documents that stand for their text, by id."""
    keep = pc.unique(right.filter(pc.is_valid(right["rep"]))["rep"])
    docs = unpacked_docs(docs)
    docs = docs.filter(pc.is_in(docs["doc_id"], keep)).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    ids = docs["doc_id"].to_numpy()
    return docs.filter(pa.array(np.append(True, ids[1:] != ids[:-1]))) if len(ids) else docs


def _chunk(docs: pa.Table, right: pa.Table) -> int:
    return (docs if docs.num_rows else right)["chunk"][0].as_py()


def text_sets(docs: DataFrame, reps: DataFrame, n_texts: int, threshold: float) -> DataFrame:
    """doc_id, bands, n, set: of the texts that may have a near-duplicate, their band keys, weighted shingles and prefix."""
    chunks = parts_for(text_bytes(docs), CHUNK_BYTES, 48)
    of_chunk = dealt(docs, chunks).groupBy("chunk")
    rep = reps.select(chunk_of(chunks), F.col("doc_id").alias("rep"))

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _own(left, right)
        h = shingles(own["text"])[1]
        found, where, _ = grouped(h)
        return sent(found, [np.bincount(where, minlength=len(found)).astype(np.uint32)], _chunk(left, right), chunks)

    def merge(table: pa.Table) -> pa.Table:
        got = Received(table, np.uint32)
        return got.answers(0, table["bucket"][0].as_py(), [got.sums(0).astype(np.uint32)])

    def sign(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _own(left, right)
        row, h, tf = shingles(own["text"])
        found, where, _ = grouped(h)
        df = answered(right.filter(pc.is_valid(right["kind"])), 0, np.uint32)[0][where]
        w = tf * idf(df, n_texts)
        all_, common = np.bincount(row, w, own.num_rows), np.bincount(row, w * (df > 1), own.num_rows)
        may = (common >= threshold * all_ - 1e-9) & (all_ > 0)
        keep = may[row]
        row, h, w, df = row[keep], h[keep], w[keep].astype(np.float32), df[keep]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        if not len(starts):
            return _SETS.empty_table()
        keys = band_keys(consistent_samples(h, w, starts, BANDS * ROWS), BANDS, ROWS)
        ends = np.append(starts[1:], len(h))
        sets = [packed_sorted(h[a:b]) + packed(w[a:b]) for a, b in zip(starts, ends, strict=True)]
        ids = own["doc_id"].combine_chunks().take(pa.array(row[starts]))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
        total, of, prefix, rest = prefixes(h, w, df, starts, threshold)
        centre = np.add.reduceat(w * np.log(df.astype(np.float64)), starts) / total
        edges = pa.array(np.searchsorted(of, np.arange(len(starts) + 1)), pa.int32())
        prefix, rest = (pa.ListArray.from_arrays(edges, pa.array(x)) for x in (prefix.view(np.int64), rest))
        return pa.table([ids, lists, pa.array(ends - starts, pa.int32()), pa.array(sets, pa.binary()), pa.array(total), pa.array(centre), prefix, rest], schema=_SETS)

    asked = of_chunk.cogroup(rep.groupBy("chunk")).applyInArrow(lean(send), SENT)
    answers = stored(asked.groupBy("bucket").applyInArrow(lean(merge), ANSWER), "frequencies")
    right = rep.unionByName(answers, allowMissingColumns=True)
    sets = of_chunk.cogroup(right.groupBy("chunk")).applyInArrow(lean(sign), _SETS_DDL)
    return stored(sets, "sets")


def _compared(batches):
    for batch in batches:
        read = lambda n, s: (unpacked_sorted(s, n), unpacked(s, np.float32, n, 8 * n))
        c = {k: batch.column(k).to_pylist() for k in ("n_a", "set_a", "n_b", "set_b")}
        s = [similarity(read(na, sa), read(nb, sb)) for na, sa, nb, sb in zip(c["n_a"], c["set_a"], c["n_b"], c["set_b"], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s, pa.float64())], names=["a", "b", "similarity"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) that reach the threshold."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("set").alias(f"set_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "set_a", "n_b", "set_b")
    return both.mapInArrow(_compared, "a long, b long, similarity double").where(F.col("similarity") >= threshold)


def components(links: DataFrame) -> DataFrame:
    """doc_id, root (the least id of the component) of every id in links (a, b), by large-star and small-star steps."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    last = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            roots = edges.select(F.col("v").alias("doc_id"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("root")).union(roots)
        last = now


def across_components(placed: DataFrame, roots: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of texts of different components that may reach the threshold, from buckets (key, doc_id) that hold several."""
    whole = placed.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    several = whole.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = stored(whole.join(several, "key").select("doc_id", "root").distinct(), "unresolved")
    at = sets.join(left, "doc_id").select("doc_id", "root", "total", F.explode(F.arrays_zip("prefix", "rest")).alias("p"))
    at = stored(at.select("doc_id", "root", "total", F.col("p.prefix").alias("h"), F.col("p.rest").alias("rest")), "prefixes")
    # a shingle's largest component need not be compared with itself: the others' texts are compared with all
    sizes = at.groupBy("h", "root").agg(F.count("*").alias("n"))
    top = sizes.groupBy("h").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1").select("h", "top")
    at = stored(at.join(top, "h"), "prefixes")
    x, y = at.where("root <> top").alias("x"), at.alias("y")
    least = (F.col("x.total") + F.col("y.total")) * (threshold / (1 + threshold) * (1 - 1e-6))
    both = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.root") != F.col("y.root")) & (F.least("x.rest", "y.rest") >= least))
    return both.select(F.greatest("x.doc_id", "y.doc_id").alias("a"), F.least("x.doc_id", "y.doc_id").alias("b")).distinct()


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least id of its class), text_id (the least id of an equal text) of every row with an id."""
    rows = texts(docs, id_col=id_col, text_col=text_col).where("doc_id is not null")
    digest = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    keyed = stored(rows.select("doc_id", *digest), "digests")
    first = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("text_id"))
    members = stored(keyed.join(first, ["h1", "h2"]).groupBy("doc_id").agg(F.min("text_id").alias("text_id")), "texts")
    reps = members.where("doc_id = text_id").select("doc_id")
    sets = text_sets(rows, reps, reps.count(), threshold)

    placed = stored(sets.select("doc_id", "centre", F.explode("bands").alias("key")), "bands")
    keys = placed.groupBy("key").agg(F.min_by("doc_id", F.struct(-F.col("centre"), "doc_id")).alias("b"), F.count("*").alias("size")).where("size > 1")
    placed = stored(placed.join(keys.select("key"), "key").select("doc_id", "key"), "bands")
    pairs = stored(placed.join(keys.select("key", "b"), "key").select(F.greatest("doc_id", "b").alias("a"), F.least("doc_id", "b").alias("b")).where("a <> b").distinct(), "pairs")
    links, tried = stored(verified(pairs, sets, threshold), "links"), pairs
    roots = components(links)
    for nth in range(1, ROUNDS):
        # one text of each component in each bucket, then the bucket's components in a line by a hash of this round
        whole = placed.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        salt = F.xxhash64("doc_id", F.lit(nth))
        one = whole.groupBy("key", "root").agg(F.min_by("doc_id", salt).alias("doc_id"))
        heads = one.groupBy("key").agg(F.min_by("doc_id", F.xxhash64("root", F.lit(-nth))).alias("head"), F.count("*").alias("size")).where("size > 1")
        fresh = one.join(heads, "key").where("doc_id <> head").select(F.greatest("doc_id", "head").alias("a"), F.least("doc_id", "head").alias("b")).distinct()
        fresh = stored(fresh.join(tried, ["a", "b"], "left_anti"), "pairs")
        if fresh.isEmpty():
            break
        more = stored(verified(fresh, sets, threshold), "links")
        tried = tried.union(fresh)
        if not more.isEmpty():
            links = links.union(more)
            roots = components(links)
    more = stored(verified(stored(across_components(placed, roots, sets, threshold), "pairs"), sets, threshold), "links")
    if not more.isEmpty():
        roots = components(links.union(more))
    out = members.join(roots.withColumnRenamed("doc_id", "text_id"), "text_id", "left")
    return out.select("doc_id", F.coalesce("root", "text_id").alias("class_id"), "text_id")
