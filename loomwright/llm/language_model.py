"""Language-model scores by a hierarchical Pitman-Yor model of words after words.

Each word is a restaurant for the words that follow it; all have the restaurant without a context as their parent, whose
base is uniform over the known words and one unknown. A dish's customers are its occurrences in training texts; each of
its tables sends one customer to the parent.

Texts are read once. A chunk (texts that a task reads one after the other) keeps, packed, which word each token is, and
sends its distinct words with their training counts to buckets of words, which number them: often used words have low
numbers. With these the chunk sends its distinct pairs to buckets of contexts, so that a whole restaurant lies in one
bucket. Then SWEEPS times: the buckets of words reseat the parent, given the tables of all contexts, and send back what
each word weighs; the buckets of contexts reseat, given the parent, and send up their words' tables. Dishes of one
customer have one table always, so these exchanges carry the others only. Of the sweeps after BURN_IN the predictive
probabilities are averaged, and go back to the chunks as one number for each pair. Nothing that grows with the corpus
passes the driver.

Seating is sampled by Gibbs in blocks: a block is the seating of one dish, drawn whole from its conditional given the
parent and the restaurant's other tables, (theta' | d)_t P**t S_d(c, t), where S_d are generalised Stirling numbers and
theta' is theta + d * the other tables. Up to EXACT customers the draw is from that distribution itself; a dish with
more takes a normal draw with its mean and spread by a saddle point, which are within a few thousandths there. Random
numbers are hashes of the words' numbers and the sweep, so that the same rows have the same scores however the table is
cut into files and tasks. Departures from a sequential
sampler: the dishes of a sweep are drawn side by side, each given the others as the sweep before left them.

Texts: A-Z lower-cased, words are runs of bytes other than 0x20 and 0x09-0x0D, then one end. Null and empty texts are an
end alone; rows with equal ids are scored each, and equal texts have equal scores; ids may be null; further columns are
not read. With no training text every word is unknown: base and model are uniform over one word. An empty table gives an
empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, bucket_edges, bundle, climbed, flat, gathered, grouped, lean, mix, parts_for, steps, stored, text_bytes, texts, unbundle, words

BURN_IN, KEPT_SWEEPS = 1, 2
SWEEPS = BURN_IN + KEPT_SWEEPS
#: Customers up to which a dish's tables are drawn from their exact distribution.
EXACT = 1024
STRENGTH, ROOT_STRENGTH = 0.5, 1.0
#: Bytes of text of a chunk.
CHUNK_BYTES = 8 << 20
_END, _START = U64(0x0123456789ABCDEF), U64(0xFEDCBA9876543210)
_APART = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = U64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])
#: Kinds of the rows that go between chunks, buckets of contexts and buckets of words.
WORDS, KEPT, COUNTS, PAIRS, STATE, WHERE, ACTIVE, ASKED, UP, BASE, ROOT, WEIGHTS, SEATS, ANSWER = range(14)
ROW = "kind int, bucket long, chunk long, blob binary, stats array<double>"
_ROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary()), ("stats", pa.list_(pa.float64()))])


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROW)], schema=_ROW)


# ---------------------------------------------------------------- seating


def discount(once: float, twice: float) -> float:
    """From the numbers of dishes seen once and twice."""
    return float(np.clip(once / max(once + 2 * twice, 1), 0.05, 0.95))


@lru_cache(maxsize=2)
def stirling_logs(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S_d(c, t), by their recurrence."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        out[c + 1, 1 : c + 1] = out[c, 1 : c + 1] + np.log(c - d * np.arange(1, c + 1))
        out[c + 1, 2 : c + 2] = np.logaddexp(out[c + 1, 2 : c + 2], out[c, 1 : c + 1])
    return out


def spread_of_tables(customers: np.ndarray, opening: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the tables of many customers of one dish under weights opening**t S_d(c, t).

    The tables are a Poisson number of groups with the total conditioned to be c: the generating function is
    exp(opening / d * (1 - (1 - x)**d)); at its saddle point opening * x * (1 - x)**(d - 1) = c the mean is the exponent,
    besides the table that there always is, and the variance is the exponent less what the condition takes.
    """
    low, high = np.full(len(customers), -700.0), np.zeros(len(customers))  # of log(1 - x)
    for _ in range(60):
        mid = (low + high) / 2
        above = np.log(opening) + np.log1p(-np.exp(np.minimum(mid, -1e-12))) + (d - 1) * mid > np.log(customers)
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    groups = opening / d * -np.expm1(d * low)
    odds = np.expm1(np.minimum(-low, 600))  # x / (1 - x)
    return np.minimum(1 + groups, customers), np.sqrt(np.maximum(groups - customers / (1 + (1 - d) * odds), 0))


def uniforms(h: np.ndarray, nth: int) -> np.ndarray:
    """A number in (0, 1) for each hash, another one for each nth."""
    return ((mix(h + U64((nth + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def drawn_tables(customers: np.ndarray, strength: np.ndarray, p: np.ndarray, d: float, now: np.ndarray, h: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish, drawn given the parent's probability p of it and the strength theta' that the restaurant's other tables leave."""
    c, u = customers.astype(np.int64), uniforms(h, 2 * sweep)
    out = np.minimum(c, 1)
    logs = stirling_logs(d)
    order = np.flatnonzero((c > 1) & (c <= EXACT))
    order = order[np.argsort(c[order], kind="stable")]
    sizes, at = c[order], 0
    while at < len(order):
        to = int(np.searchsorted(sizes, sizes[at] + sizes[at] // 4, side="right"))
        to = min(to, at + max(1, (1 << 20) // int(sizes[at])))
        pick, width = order[at:to], int(sizes[to - 1])
        w = strength[pick, None] + d * np.arange(width)
        w *= p[pick, None]
        np.cumsum(np.log(w, out=w), axis=1, out=w)
        w += logs[c[pick], 1 : width + 1]
        w -= w.max(axis=1, keepdims=True)
        np.cumsum(np.exp(w, out=w), axis=1, out=w)
        out[pick] = 1 + (w < (u[pick] * w[:, -1])[:, None]).sum(axis=1)
        at = to
    many = np.flatnonzero(c > EXACT)
    if len(many):
        mean, spread = spread_of_tables(c[many].astype(np.float64), (strength[many] + d * now[many]) * p[many], d)
        normal = np.sqrt(-2 * np.log(u[many])) * np.cos(2 * np.pi * uniforms(h[many], 2 * sweep + 1))
        out[many] = np.clip(np.rint(mean + spread * normal), 1, c[many]).astype(np.int64)
    return out


# ---------------------------------------------------------------- chunks


def tokens_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token of all texts, ends included, and the number of each text's tokens."""
    body, offsets = flat(column)
    row, h = words(_LOWER[body], offsets, _APART)
    sizes = np.bincount(row, minlength=len(column)) + 1
    token = np.full(int(sizes.sum()), _END, U64)
    inside = np.ones(len(token), bool)
    inside[np.cumsum(sizes) - 1] = False
    token[inside] = h
    return token, sizes


def _ranges(edges: np.ndarray) -> list[tuple[int, int, int]]:
    """Number, begin and end of each range that is not empty."""
    return [(b, lo, hi) for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if hi > lo]


def _bundles(table: pa.Table, kind: int, *kinds: type, by: str = "bucket") -> list[tuple]:
    """Bucket, chunk and arrays of each row of a kind, in order."""
    rows = [r for r in table.select(["kind", "bucket", "chunk", "blob"]).to_pylist() if r["kind"] == kind]
    return [(r["bucket"], r["chunk"], *unbundle(r["blob"], *kinds)) for r in sorted(rows, key=lambda r: r[by])]


def chunk_rows(docs: pa.Table, chunk: int, buckets: int) -> pa.Table:
    """What a chunk sends: its distinct words with their training counts, by bucket; and what it keeps: each token's word, often used ones first."""
    token, sizes = tokens_of(docs["text"])
    out = docs["out"].to_numpy()
    distinct, word, _ = grouped(token)
    known = np.bincount(word[np.repeat(~out, sizes)], minlength=len(distinct))
    rows = [(WORDS, b, chunk, bundle(steps(distinct[lo:hi]), known[lo:hi]), None) for b, lo, hi in _ranges(bucket_edges(distinct, buckets))]
    order = np.argsort(-np.bincount(word, minlength=len(distinct)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    ids, none = docs["doc_id"].fill_null(0).to_numpy(), docs["doc_id"].is_null().to_numpy()
    rows.append((KEPT, chunk, chunk, bundle(ids, none.astype(np.uint8), out.astype(np.uint8), sizes, rank[word], order.astype(np.int32)), None))
    return _rows(rows)


def _chunks(most: int, buckets: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        for nth, docs in enumerate(gathered(batches, most)):
            yield from chunk_rows(docs, part << 24 | nth, buckets).to_batches()

    return run


class Chunk:
    """A chunk's texts as numbers of words, from what it kept and what the buckets of words answered."""

    def __init__(self, kept: pa.Table, answers: pa.Table, buckets: int):
        self.ids, self.none, out, self.sizes, code, order = unbundle(kept["blob"][0].as_py(), np.int64, np.uint8, np.uint8, np.int64, np.int32, np.int32)
        self.out = out.astype(bool)
        got = _bundles(answers, COUNTS, np.int64, np.int64)
        self.number, self.count = (np.concatenate([x[k] for x in got])[order] for k in (2, 3))  # of each word, by its code
        self.word, n = code, len(self.number)
        context = np.full(len(code), n, np.int64)
        context[1:] = code[:-1]
        context[np.cumsum(self.sizes) - self.sizes] = n  # a text's beginning
        # contexts by bucket and rank (the beginning has rank 0 of bucket 0), words by number
        bucket, rank = np.append(self.number % buckets, 0), np.append(self.number // buckets + 1, 0)
        by_context, by_number = np.lexsort((rank, bucket)), np.argsort(self.number)
        place = [np.empty(len(x), np.int64) for x in (by_context, by_number)]
        place[0][by_context], place[1][by_number] = np.arange(n + 1), np.arange(n)
        self.codes, self.pair = np.unique(place[0][context] * max(n, 1) + place[1][code], return_inverse=True)
        left, right = self.codes // max(n, 1), self.codes % max(n, 1)
        self.bucket, self.rank, self.right = bucket[by_context][left], rank[by_context][left], self.number[by_number][right]

    def rows(self, chunk: int, buckets: int) -> pa.Table:
        count = np.bincount(self.pair[np.repeat(~self.out, self.sizes)], minlength=len(self.codes))
        rows = []
        for b, lo, hi in _ranges(np.searchsorted(self.bucket, np.arange(buckets + 1))):
            rows.append((PAIRS, b, chunk, bundle(*_coded(self.rank[lo:hi], self.right[lo:hi]), count[lo:hi]), None))
        return _rows(rows)

    def scores(self, answers: pa.Table, n_train: float, n_words: float) -> pa.Table:
        logs = np.concatenate([x[2] for x in _bundles(answers, ANSWER, np.float32)]).astype(np.float64)
        first, n = np.cumsum(self.sizes) - self.sizes, len(self.sizes)
        base = np.log10((self.count + 1) / (n_train + n_words + 1))
        score = np.add.reduceat(logs[self.pair], first)
        known = np.add.reduceat((self.count > 0).astype(np.int64)[self.word], first)
        columns = [pa.array(self.ids, mask=self.none.astype(bool)), self.out, self.sizes, known, np.full(n, int(n_train)), np.add.reduceat(base[self.word], first), score, 10 ** np.minimum(-score / self.sizes, 300)]
        return pa.table([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _coded(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of numbers, ascending, as arrays that compress well."""
    distinct, sizes = np.unique(left, return_counts=True)
    wide = int(right.max()) + 1
    return steps(distinct), sizes.astype(np.int32), np.array([wide]), steps(np.repeat(np.arange(len(sizes)), sizes) * wide + right)


def _decoded(distinct: np.ndarray, sizes: np.ndarray, wide: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(climbed(distinct), sizes), climbed(both) % wide[0]


_PAIR_KINDS = (np.int64, np.int32, np.int64, np.int64)


# ---------------------------------------------------------------- buckets


def number_words(table: pa.Table, buckets: int) -> pa.Table:
    """Numbers and training counts of a bucket's words, back to the chunks that sent them; frequent words have low numbers."""
    got = _bundles(table, WORDS, U64, np.int64, by="chunk")
    distinct, where, _ = grouped(np.concatenate([climbed(h) for _, _, h, _ in got]))
    c = np.bincount(where, np.concatenate([n for *_, n in got]), len(distinct)).astype(np.int64)
    bucket, rows, at = got[0][0], [], 0
    number = np.empty(len(c), np.int64)
    number[np.lexsort((distinct, -c))] = np.arange(len(c)) * buckets + bucket
    for _, chunk, h, _ in got:
        own = where[at : at + len(h)]
        rows.append((COUNTS, bucket, chunk, bundle(number[own], c[own]), None))
        at += len(h)
    return _rows([*rows, (COUNTS, bucket, -1, b"", [float(c.sum()), float((c > 0).sum()), float((c == 1).sum()), float((c == 2).sum())])])


class Asking:
    """A bucket's distinct words in the order in which the buckets of words answer, and their ranks there."""

    def __init__(self, numbers: np.ndarray, buckets: int):
        bucket, rank = numbers % buckets, numbers // buckets
        order = np.lexsort((rank, bucket))
        distinct = np.ones(len(order), bool)
        distinct[1:] = numbers[order][1:] != numbers[order][:-1]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(distinct) - 1
        at = order[distinct]
        self.rank, self.numbers = rank[at], numbers[at]
        self.ranges = _ranges(np.searchsorted(bucket[at], np.arange(buckets + 1)))

    def rows(self, kind: int, bucket: int, tables: np.ndarray) -> list[tuple]:
        """To each bucket of words the ranks of these words and their tables here."""
        up = np.bincount(self.place, tables, len(self.rank)).astype(np.int64)
        return [(kind, b, bucket, bundle(steps(self.rank[lo:hi]), up[lo:hi]), None) for b, lo, hi in self.ranges]


def merge_pairs(table: pa.Table, buckets: int) -> pa.Table:
    """A bucket's restaurants from all chunks' pairs (all, and the active part: dishes of several customers), which of them each chunk's pairs are, and the tables sent up at first."""
    got = _bundles(table, PAIRS, *_PAIR_KINDS, np.int64, by="chunk")
    both = [_decoded(*x[2:6]) for x in got]
    left, right = (np.concatenate([x[k] for x in both]) for k in (0, 1))
    wide = int(right.max()) + 1
    codes, where = np.unique(left * wide + right, return_inverse=True)
    left, right = codes // wide, codes % wide
    count = np.bincount(where, np.concatenate([x[-1] for x in got]), len(codes)).astype(np.int64)
    bucket, at, places = got[0][0], 0, []
    for x in got:
        places.append(steps(where[at : at + len(x[-1])]))
        at += len(x[-1])
    rows = [(STATE, bucket, bucket, bundle(*_coded(left, right), count), [float((count == 1).sum()), float((count == 2).sum())])]
    rows.append((WHERE, bucket, bucket, bundle(np.array([x[1] for x in got], np.int64), np.array([len(p) for p in places], np.int64), np.concatenate(places)), None))
    rows += Asking(right, buckets).rows(ASKED, bucket, count == 1)
    active = count > 1
    if active.any():
        contexts, nth = np.unique(left[active], return_inverse=True)
        single = np.bincount(np.searchsorted(contexts, left[(count == 1) & np.isin(left, contexts)]), minlength=len(contexts))
        rows.append((ACTIVE, bucket, bucket, bundle(*_coded(left[active], right[active]), count[active], single), None))
        rows += Asking(right[active], buckets).rows(UP, bucket, np.ones(int(active.sum())))
    return _rows(rows)


def _asked(table: pa.Table, kind: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Chunk, ranks and tables of what buckets of contexts sent."""
    return [(chunk, climbed(rank), n) for _, chunk, rank, n in _bundles(table, kind, np.int64, np.int64, by="chunk")]


def sum_base(table: pa.Table) -> pa.Table:
    """Tables of a bucket's words in all contexts that have one customer for them."""
    got = _asked(table, ASKED)
    total = np.bincount(np.concatenate([r for _, r, _ in got]), np.concatenate([n for *_, n in got])).astype(np.int64)
    bucket = table["bucket"][0].as_py()
    return _rows([(BASE, bucket, -1, bundle(total), None)])


def seat_root(table: pa.Table, buckets: int, d0: float, n_words: float, root_tables: float, sweep: int) -> pa.Table:
    """The parent's dishes of a bucket, reseated: what they weigh beside the base, to the buckets of contexts that reseat next, and all of it to be kept."""
    ((bucket, _, base),) = _bundles(table, BASE, np.int64)
    got, customers = _asked(table, UP), base.copy()
    for _, rank, n in got:
        customers[rank] += n
    number = np.arange(len(customers)) * buckets + bucket
    p, now = np.full(len(customers), 1 / (n_words + 1)), np.minimum(customers, 1)
    t = drawn_tables(customers, np.full(len(customers), ROOT_STRENGTH + d0 * root_tables), p, d0, now, mix(number.astype(U64)), 1000 + sweep)
    weight = np.maximum(customers - d0 * t, 0).astype(np.float32)
    rows = [(ROOT, bucket, chunk, bundle(weight[rank]), None) for chunk, rank, _ in got]
    return _rows([*rows, (WEIGHTS, bucket, sweep, bundle(weight), [float(customers.sum()), float(t.sum())])])


def answer_weights(table: pa.Table) -> pa.Table:
    """To each bucket of contexts what all its words weigh in each kept sweep."""
    weights = [x[2] for x in _bundles(table, WEIGHTS, np.float32, by="chunk")]
    bucket = table["bucket"][0].as_py()
    return _rows([(ROOT, bucket, chunk, bundle(np.concatenate([w[rank] for w in weights])), None) for chunk, rank, _ in _asked(table, ASKED)])


class Active:
    """The dishes of several customers of a bucket: contexts, words, customers and tables."""

    def __init__(self, table: pa.Table, buckets: int):
        ((self.bucket, _, *coded, self.count, self.single),) = _bundles(table, ACTIVE, *_PAIR_KINDS, np.int64, np.int64)
        self.left, self.right = _decoded(*coded)
        self.context = np.repeat(np.arange(len(coded[1])), coded[1])
        self.asking = Asking(self.right, buckets)
        seats = _bundles(table, SEATS, np.int64)
        self.tables = seats[0][2] if seats else np.ones(len(self.count), np.int64)

    def reseat(self, root: pa.Table, parent, d: float, buckets: int, sweep: int) -> pa.Table:
        p = parent(np.concatenate([x[2] for x in _bundles(root, ROOT, np.float32)]).astype(np.float64))[self.asking.place]
        others = (self.single + np.bincount(self.context, self.tables, len(self.single)))[self.context] - self.tables
        h = mix((self.left * buckets + self.bucket).astype(U64) * _P + self.right.astype(U64))
        self.tables = drawn_tables(self.count, STRENGTH + d * others, p, d, self.tables, h, sweep)
        return _rows([(SEATS, self.bucket, sweep + 1, bundle(self.tables), None), *self.asking.rows(UP, self.bucket, self.tables)])


def answer_pairs(table: pa.Table, root: pa.Table, parents: list, d: float, buckets: int) -> pa.Table:
    """Predictive probability of each pair's word after its context, averaged over the kept sweeps, to the chunks that have the pair."""
    ((bucket, _, *coded, count),) = _bundles(table, STATE, *_PAIR_KINDS, np.int64)
    left, right = _decoded(*coded)
    context = np.repeat(np.arange(len(coded[1])), coded[1])
    customers = STRENGTH + np.bincount(context, count, len(coded[1]))
    asking = Asking(right, buckets)
    weights = [x[2].reshape(len(parents), -1) for x in _bundles(root, ROOT, np.float32)]
    weights = np.concatenate(weights, axis=1).astype(np.float64)
    seats, total = _bundles(table, SEATS, np.int64, by="chunk"), np.zeros(len(count))
    for k, parent in enumerate(parents):
        tables = np.minimum(count, 1)
        if seats:
            tables[count > 1] = seats[k][2]
        back = STRENGTH + d * np.bincount(context, tables, len(customers))
        total += np.maximum(count - d * tables, 0) + back[context] * parent(weights[k])[asking.place]
    logs = np.log10(total / len(parents) / customers[context]).astype(np.float32)
    ((_, _, chunks, sizes, places),) = _bundles(table, WHERE, np.int64, np.int64, np.int64)
    ends = np.cumsum(sizes)
    return _rows([(ANSWER, bucket, c, bundle(logs[climbed(places[e - n : e])]), None) for c, n, e in zip(chunks.tolist(), sizes.tolist(), ends.tolist(), strict=True)])


# ---------------------------------------------------------------- the model


def _stats(rows: DataFrame, n: int) -> list[float]:
    """Sums over all buckets of their statistics: n numbers, whatever the input."""
    row = rows.where("stats is not null").agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(n)]).first()
    return [x or 0.0 for x in row]


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS, burn_in: int = BURN_IN, chunk_bytes: int = CHUNK_BYTES, least: int = 24) -> DataFrame:
    """Scores of all texts by the model of those that are not held out; perplexity is that of the text's tokens."""
    rows = texts(docs, held_out.alias("out"), id_col=id_col, text_col=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("out", F.lit(False)).alias("out"))
    size = text_bytes(rows)
    buckets = parts_for(size, chunk_bytes, least)
    of = lambda df, *kinds: df.where(F.col("kind").isin(*kinds))
    by = lambda df, key: df.withColumn("to", F.col(key)).groupBy("to")
    two = lambda f: lean(lambda left, right: f(left.drop_columns("to"), right.drop_columns("to")))

    sent = stored(rows.mapInArrow(_chunks(max(chunk_bytes, size // buckets), buckets), ROW), "chunks", "kind")
    counts = stored(of(sent, WORDS).groupBy("bucket").applyInArrow(lean(lambda t: number_words(t, buckets)), ROW), "words")
    n_train, n_words, once, twice = _stats(counts, 4)
    kept, numbers = of(sent, KEPT), counts.where("chunk >= 0")

    def pairs_of(left: pa.Table, right: pa.Table) -> pa.Table:
        return Chunk(left, right, buckets).rows(left["chunk"][0].as_py(), buckets)

    pairs = by(kept, "chunk").cogroup(by(numbers, "chunk")).applyInArrow(two(pairs_of), ROW)
    merged = stored(pairs.groupBy("bucket").applyInArrow(lean(lambda t: merge_pairs(t, buckets)), ROW), "restaurants", "kind")
    d1, d0 = discount(*_stats(of(merged, STATE), 2)), discount(once, twice)
    base = stored(of(merged, ASKED).groupBy("bucket").applyInArrow(lean(sum_base), ROW), "base")
    active, up, root_tables = of(merged, ACTIVE), of(merged, UP), n_words
    seats, parents, weights = [], [], []

    for sweep in range(sweeps + 1):
        seat = lambda t, n=root_tables, k=sweep: seat_root(t, buckets, d0, n_words, n, k)
        root = stored(up.unionByName(base).groupBy("bucket").applyInArrow(lean(seat), ROW), "root", "kind")
        root_customers, root_tables = _stats(of(root, WEIGHTS), 2)

        def parent(weight: np.ndarray, customers: float = root_customers, tables: float = root_tables) -> np.ndarray:
            return (weight + (ROOT_STRENGTH + d0 * tables) / (n_words + 1)) / (ROOT_STRENGTH + customers)

        if sweep > burn_in or sweep == sweeps:
            parents.append(parent), weights.append(of(root, WEIGHTS))
        if sweep < sweeps:
            whole = active.unionByName(seats[-1]) if seats else active
            reseat = lambda left, right, parent=parent, k=sweep: Active(left, buckets).reseat(right, parent, d1, buckets, k)
            now = stored(by(whole, "bucket").cogroup(by(of(root, ROOT), "chunk")).applyInArrow(two(reseat), ROW), "seats", "kind")
            seats.append(of(now, SEATS))
            up = of(now, UP)
    asked = of(merged, ASKED)
    for own in weights:
        asked = asked.unionByName(own)
    root = asked.groupBy("bucket").applyInArrow(lean(answer_weights), ROW)
    whole = of(merged, STATE, WHERE)
    for own in seats[len(seats) - len(parents) :]:
        whole = whole.unionByName(own)
    answers = by(whole, "bucket").cogroup(by(root, "chunk")).applyInArrow(two(lambda left, right: answer_pairs(left, right, parents, d1, buckets)), ROW)
    scores = lambda left, right: Chunk(left, right, buckets).scores(right, n_train, n_words) if left.num_rows else _ARROW.empty_table()
    return by(kept, "chunk").cogroup(by(numbers.unionByName(answers), "chunk")).applyInArrow(two(scores), SCHEMA)


def perplexity(scores: DataFrame) -> float:
    """Perplexity over all tokens of scored texts."""
    row = scores.agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    return 10 ** (-row["s"] / row["n"]) if row["n"] else float("nan")
