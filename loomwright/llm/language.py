"""Language identification by known words first, then by ever shorter character n-grams.

A word is a run of letters and the marks on them. A word that the training texts hold is scored by its log frequency in
each language. Any other word falls back to its character n-grams (with marks at its ends), from the longest to single
characters, at the first length of which any is known. A text's score is the posterior of its best language over the sum
of its words.

A null or empty text, or one without a letter, is `und` with score 0. Ties go to the language first in alphabetical
order. Where nothing can be learned every text is `und`. Null languages teach nothing. Equal texts have equal
predictions; rows with equal or null ids are predicted each; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grouped, low_hash, mix, ragged, short_batches, slices

#: Training texts for each language, about; a bounded sample by a hash of the id.
TRAIN_TEXTS = 800
LONGEST = 5
#: Characters of the distinct words whose scores a worker keeps.
KEPT = 4 << 20
SCHEMA = "doc_id long, lang_pred string, score double"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
_ARROW = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


_P = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and hash of every character n-gram; for n over 1 words have marks at their ends."""
    marked = [f"<{w}>" for w in words] if n > 1 else words
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in marked], np.int64)
    starts, count = np.cumsum(lengths) - lengths, np.maximum(lengths - n + 1, 0)
    at = ragged(starts, count)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = mix(h * _P + points[at + k] + np.uint64(1))
    return np.repeat(np.arange(len(words)), count), h


class Model:
    def __init__(self, counts: dict[str, Counter]):
        """counts: for each language the counts of its words."""
        self.langs = sorted(counts)
        total = sum(c.total() for c in counts.values())
        self.prior = np.log([(counts[k].total() + 1) / (total + len(counts)) for k in self.langs]) if counts else np.zeros(0)
        every = sorted(set().union(*counts.values())) if counts else []
        times = np.array([[counts[k][w] for k in self.langs] for w in every], np.float64).reshape(len(every), len(self.langs))
        self.words, self.scores = dict(zip(every, range(len(every)), strict=True)), self._logs(times)
        self.levels = {}
        for n in range(1, LONGEST + 1):
            word, h = grams(every, n)
            known, where, _ = grouped(h)
            own = np.stack([np.bincount(where, times[word, k], len(known)) for k in range(len(self.langs))], axis=1) if self.langs else np.zeros((0, 0))
            self.levels[n] = np.append(known, ~np.uint64(0)), self._logs(own)
        self._forget()

    def _logs(self, counts: np.ndarray) -> np.ndarray:
        logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (len(counts) + 1)))
        return logs.astype(np.float32)

    def _forget(self) -> None:
        self.cached, self.size, self.pool = {}, 0, np.zeros((0, len(self.langs)), np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word in each language, less that in its best one; 0 for words of unknown characters."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        known = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        out[known >= 0] = self.scores[known[known >= 0]]
        left = np.flatnonzero(known < 0)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            word, h = grams([words[i] for i in left.tolist()], n)
            table, logs = self.levels[n]
            at = np.searchsorted(table, h)
            hit = (table[at] == h) & (at < len(logs))
            word, at = word[hit], at[hit]
            size = np.bincount(word, minlength=len(left))
            mean = np.stack([np.bincount(word, logs[at, k], len(left)) for k in range(len(self.langs))], axis=1) / np.maximum(size, 1)[:, None]
            out[left[size > 0]] = mean[size > 0]
            left = left[size == 0]
        return out - out.max(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        if self.size > KEPT:
            self._forget()
        get, put, old = self.cached.get, self.cached.setdefault, len(self.cached)
        where = []
        for text in texts:
            found = _WORD.findall(text.lower()) if text else []
            at = np.fromiter(map(get, found, repeat(-1)), np.int64, len(found))
            for i in np.flatnonzero(at < 0).tolist():
                at[i] = put(found[i], len(self.cached))
            where.append(at)
        new = list(islice(self.cached, old, None))
        if new:
            self.size += sum(map(len, new))
            self.pool = np.concatenate([self.pool, self.word_scores(new)])
        sizes = np.array([len(x) for x in where], np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        each = self.pool[np.concatenate(where)] if len(doc) else self.pool[:0]
        total = self.prior + np.stack([np.bincount(doc, each[:, k], len(texts)) for k in range(len(self.langs))], axis=1)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if n else "und" for b, n in zip(best, sizes, strict=True)], [float(x) if n else 0.0 for x, n in zip(score, sizes, strict=True)]


def _counted(batches):
    for batch in batches:
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts[lang].update(_WORD.findall(text.lower()))
        rows = [(k, w, c) for k, own in counts.items() for w, c in own.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["lang", "word", "n"])


def fit(docs: DataFrame, train: Column | None = None, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_lang: int = TRAIN_TEXTS) -> Model:
    """Learn from about per_lang texts of each language: those with the lowest hashes of their ids."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (F.lit(True) if train is None else train).alias("train"))
    rows = rows.where("train and lang is not null and text is not null").drop("train")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model({})
    picked = rows.where(low_hash(F.xxhash64("doc_id"), F.col("lang"), {k: per_lang / n for k, n in sizes.items()}))
    found = picked.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {k: Counter() for k in sizes}
    for r in found.toLocalIterator():
        counts[r["lang"]][r["word"]] = r["n"]
    return Model(counts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every text."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch):
                lang, score = own.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema=_ARROW)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
