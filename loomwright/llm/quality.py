"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of width 8 at every second byte pass over overlapping chunks that cover the whole
document. Beside them, one channel measures how far the bytes repeat at some lag (a bilinear filter). Each channel is
max-pooled in its chunk; the chunks' maxima and means over the document go into one logistic unit.

Fitting uses a bounded sample of labelled rows (about SAMPLE), and of a long text among them FIT_CHUNKS chunks at even
distances; scoring reads every byte. Null and empty texts have no chunk: their score is that of a document whose channels
are all zero. Without labels of both kinds the score is the share of label 1, or 1 where there is none. Of labels that
contradict each other the highest counts. Equal texts have equal scores; rows with equal or null ids are scored each; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat, low_hash, short_batches, slices, texts

#: Labelled rows that are fitted to, about, and the chunks of each that are.
SAMPLE, FIT_CHUNKS = 1600, 12
CHUNK, OVERLAP, WIDTH, STRIDE = 1024, 64, 8, 2
EMBED, FILTERS = 6, 16
#: Lags at which repetition is looked for, and the bytes over which it is averaged.
LAGS, SPAN = range(3, 25), 48
SCHEMA = "doc_id long, score double, predicted int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def chunks_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of the chunks that cover every row; each begins OVERLAP bytes before the last one's end."""
    lengths, step = np.diff(offsets), CHUNK - OVERLAP
    count = np.where(lengths > 0, np.maximum(1, -(-(lengths - OVERLAP) // step)), 0)
    row = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[row] + nth * step
    return begin, np.minimum(begin + CHUNK, offsets[row + 1]), row


def windows(body: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes of each chunk, one chunk a line, 0 after its end."""
    at = begin[:, None] + np.arange(CHUNK)
    return np.where(at < end[:, None], body[np.minimum(at, len(body) - 1)], 0).astype(np.uint8)


def repeats(lines: np.ndarray) -> np.ndarray:
    """For each chunk the largest share of bytes in a span that equal the byte some lag before."""
    best = np.zeros(len(lines), np.float32)
    for lag in LAGS:
        same = (lines[:, lag:] == lines[:, :-lag]) & (lines[:, lag:] > 0)
        sums = np.zeros((len(lines), same.shape[1] + 1), np.int16)
        np.cumsum(same, axis=1, dtype=np.int16, out=sums[:, 1:])
        best = np.maximum(best, (sums[:, SPAN:] - sums[:, :-SPAN]).max(axis=1) / np.float32(SPAN))
    return best


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.filters = rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * (FILTERS + 1)).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.constant: float | None = None

    def convolved(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled filters of each chunk and where each maximum is."""
        x = self.embed[lines].reshape(len(lines), CHUNK * EMBED)
        view = np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        z = (np.ascontiguousarray(view).reshape(-1, WIDTH * EMBED) @ self.filters).reshape(*view.shape[:2], FILTERS)
        where = z.argmax(axis=1)
        return np.maximum(np.take_along_axis(z, where[:, None], 1)[:, 0] + self.bias, 0), where

    def channels(self, body: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int = 256) -> np.ndarray:
        out = np.zeros((len(begin), FILTERS + 1), np.float32)
        for k in range(0, len(begin), most):
            lines = windows(body, begin[k : k + most], end[k : k + most])
            out[k : k + most, :FILTERS] = self.convolved(lines)[0]
            out[k : k + most, FILTERS] = repeats(lines)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        body, offsets = flat(column)
        begin, end, row = chunks_of(offsets)
        pooled = np.zeros((len(column), 2, FILTERS + 1), np.float32)
        if len(row):
            c = self.channels(body, begin, end)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            pooled[row[first], 0] = np.maximum.reduceat(c, first)
            pooled[row[first], 1] = np.add.reduceat(c, first) / np.diff(np.append(first, len(row)))[:, None]
        logit = pooled.reshape(len(column), -1) @ self.out + self.base
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -40, 40)))

    def gradients(self, lines: np.ndarray, periodic: np.ndarray, own: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss, for embed, filters, bias, out and base; the gradient of a max-pooled filter goes to the window of its maximum only."""
        h, where = self.convolved(lines)
        c = np.concatenate([h, periodic[:, None]], axis=1)
        start = np.flatnonzero(np.diff(own, prepend=-1))
        size = np.diff(np.append(start, len(own)))
        top, mean = np.maximum.reduceat(c, start), np.add.reduceat(c, start) / size[:, None]
        f = np.concatenate([top, mean], axis=1)
        p = 1 / (1 + np.exp(-(f @ self.out + self.base)))
        d = ((p - label) / len(label)).astype(np.float32)
        df = d[:, None] * self.out
        best = c == top[own]  # chunks overlap, so that several can hold the same maximum
        dc = df[own, FILTERS + 1 :] / size[own, None] + df[own, : FILTERS + 1] * best / np.add.reduceat(best, start)[own]
        dz = dc[:, :FILTERS] * (h > 0)
        at = where[:, :, None] * STRIDE + np.arange(WIDTH)
        seen = lines[np.arange(len(lines))[:, None, None], at]  # chunk, filter, width
        x = self.embed[seen].reshape(len(lines), FILTERS, -1)
        d_filters = np.einsum("cf,cfk->kf", dz, x, optimize=True)
        d_x = (dz[:, :, None] * self.filters.T[None]).reshape(*seen.shape, EMBED)
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, seen.ravel(), d_x.reshape(-1, EMBED))
        d_embed[0] = 0
        return [d_embed, d_filters, dz.sum(0), f.T @ d + 1e-4 * self.out, d.sum(keepdims=True)]

    def fit(self, every: np.ndarray, edges: np.ndarray, label: np.ndarray, epochs: int = 12, group: int = 24, rate: float = 0.01) -> Network:
        """Adam on the log loss for texts whose chunks are rows of `every`, text i those from edges[i] to edges[i + 1]."""
        if len(label) == 0 or label.min() == label.max():
            self.constant = float(label[0]) if len(label) else 1.0
            return self
        rng = np.random.default_rng(11)
        self.base[0] = np.log(label.mean() / (1 - label.mean()))
        params = [self.embed, self.filters, self.bias, self.out, self.base]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        periodic = np.concatenate([repeats(every[k : k + 256]) for k in range(0, len(every), 256)] or [np.zeros(0, np.float32)])
        for epoch in range(epochs):
            order = rng.permutation(len(label))
            for k in range(0, len(order), group):
                rows = order[k : k + group]
                rows = rows[edges[rows + 1] > edges[rows]]
                if not len(rows):
                    continue
                pick = np.concatenate([np.arange(edges[r], edges[r + 1]) for r in rows])
                own = np.repeat(np.arange(len(rows)), edges[rows + 1] - edges[rows])
                grads = self.gradients(every[pick], periodic[pick], own, label[rows])
                step += 1
                lr = rate * (1 - epoch / epochs)
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    q -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        return self


def _even(batches):
    """Of each text the chunks that are fitted to, as one run of bytes, and its label."""
    for batch in batches:
        for part in slices(batch):
            body, offsets = flat(part.column("text"))
            begin, end, row = chunks_of(offsets)
            edges = np.searchsorted(row, np.arange(part.num_rows + 1))
            chosen = [np.unique(np.linspace(a, b - 1, min(b - a, FIT_CHUNKS)).round().astype(np.int64)) if b > a else np.zeros(0, np.int64) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            blobs = [windows(body, begin[c], end[c]).tobytes() if len(c) else b"" for c in chosen]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), part.column("label")], names=["chunks", "label"])


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Network:
    """A network fitted to about `sample` labelled rows, half of each label where there are as many, with the lowest hashes of their ids."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    if train is not None:
        known = known.where(train)
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Network().fit(np.zeros((0, CHUNK), np.uint8), np.zeros(1, np.int64), np.zeros(0))
    picked = known.where(low_hash(F.xxhash64("doc_id", F.lit(5)), F.col("label"), {k: sample / 2 / n for k, n in sizes.items()}))
    rows = texts(docs, id_col=id_col, text_col=text_col).join(F.broadcast(picked), "doc_id")  # about `sample` rows
    found = sorted((bytes(r["chunks"]), min(1, max(0, r["label"]))) for r in rows.mapInArrow(_even, "chunks binary, label int").toLocalIterator())
    edges = np.concatenate([[0], np.cumsum([len(x) // CHUNK for x, _ in found])]).astype(np.int64)
    return Network().fit(np.frombuffer(b"".join(x for x, _ in found), np.uint8).reshape(-1, CHUNK), edges, np.array([y for _, y in found], np.float32))


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (likelihood of label 1), predicted of every text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                s = network.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema=_ARROW)

    return texts(docs, id_col=id_col, text_col=text_col).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, network: Network, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns as they are, whose score reaches the threshold; filtered in place, without a join."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col, most=1 << 20):
                text = part.column(text_col)
                yield part.filter(pa.array(network.scores(text.fill_null("")) >= threshold))

    short_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
