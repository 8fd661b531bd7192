"""Token counts without token ids of any text: each distinct pre-token is counted once, joined to each text's pre-token frequencies and summed.

1. Texts are read once, in chunks. A chunk keeps each text's frequencies of the chunk's distinct pre-tokens, packed, and
   sends these pre-tokens to buckets by their hash.
2. A bucket tells its pre-tokens apart by their whole strings, and the model counts the pieces of each one, once.
3. The counts go back to the chunks that sent the pre-token, which sum them by frequency. That is a join on the
   pre-token, of packed columns: one that most texts hold is one entry for each chunk, not one for each text.

For a byte-pair model with byte fallback, whose pieces hold a space only at their start, no merge reaches over the
beginning of a run of spaces or over a line break; a text is the sum of such pre-tokens. load() checks that.

Nulls and empty texts have 0 tokens. Equal texts have equal counts; rows with equal or null ids are counted each. An
empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_edges, bundle, flat, gathered, lean, parts_for, ragged, stored, text_bytes, texts, unbundle, words

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
_PRETOKEN = re.compile(r" *[^ \n]+|\n| +")
#: Bytes of text of a chunk.
CHUNK_BYTES = 16 << 20
KEPT, SENT, ANSWER = range(3)
ROW = "kind int, bucket long, chunk long, blob binary"
_ROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary())])
_WHOLE = np.zeros(256, bool)  # no byte separates words


@lru_cache(maxsize=2)
def load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if "▁" in piece.lstrip("▁") or ("\n" in piece and piece != "\n"):
            raise ValueError(f"piece {piece!r} reaches over a pre-token's end")
    return model


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, with the space that the model puts before it."""
    return _PRETOKEN.findall(" " + text.replace("▁", " ")) if text else []


def count_pieces(words: list[str], path: str) -> np.ndarray:
    """Number of pieces of each pre-token."""
    # A line break before a pre-token keeps the model's own leading space away from it: two pieces more.
    return np.array([len(ids) - 2 for ids in load(path).encode(["\n" + w for w in words], num_threads=1)], np.int32) if words else np.zeros(0, np.int32)


def frequencies(column: pa.ChunkedArray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of all texts; and for each text and pre-token that it has: text, pre-token, frequency."""
    known: dict[str, int] = {}
    get, put, where, sizes = known.get, known.setdefault, [], []
    for text in column.to_pylist():
        cut = pretokens(text)
        at = np.fromiter(map(get, cut, repeat(-1)), np.int64, len(cut))
        for i in np.flatnonzero(at < 0).tolist():
            at[i] = put(cut[i], len(known))
        where.append(at), sizes.append(len(cut))
    row = np.repeat(np.arange(len(sizes)), sizes)
    codes, n = np.unique(row * max(len(known), 1) + (np.concatenate(where) if where else 0), return_counts=True) if len(row) else (row, row)
    return list(known), codes // max(len(known), 1), codes % max(len(known), 1), n


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROW)], schema=_ROW)


def _chunks(most: int, buckets: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        for nth, docs in enumerate(gathered(batches, most)):
            distinct, row, word, n = frequencies(docs["text"])
            chunk, (body, offsets) = part << 24 | nth, flat(pa.array(distinct, pa.large_string()))
            order = np.argsort(hashes := words(body, offsets, _WHOLE)[1], kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            ids, none = docs["doc_id"].fill_null(0).to_numpy(), docs["doc_id"].is_null().to_numpy()
            size = pc.binary_length(docs["text"]).to_numpy().astype(np.int64)
            rows = [(KEPT, chunk, chunk, bundle(ids, none.astype(np.uint8), size, np.bincount(row, minlength=len(ids)), place[word], n.astype(np.int32)))]
            edges = bucket_edges(hashes[order], buckets)
            for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                if hi > lo:
                    own = order[lo:hi]
                    length = offsets[own + 1] - offsets[own]
                    rows.append((SENT, b, chunk, bundle(length.astype(np.int32), body[ragged(offsets[own], length)])))
            yield from _rows(rows).to_batches()

    return run


def _counted(path: str):
    def run(table: pa.Table) -> pa.Table:
        got = [(r["chunk"], *unbundle(r["blob"], np.int32, np.uint8)) for r in table.select(["chunk", "blob"]).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n, _ in got]), dtype=np.int64)])
        body = np.concatenate([x for *_, x in got])
        every = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        n = count_pieces(every.dictionary.to_pylist(), path)[every.indices.to_numpy()]
        bucket, rows, at = table["bucket"][0].as_py(), [], 0
        for chunk, length, _ in got:
            rows.append((ANSWER, bucket, chunk, bundle(n[at : at + len(length)])))
            at += len(length)
        return _rows(rows)

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, least: int = 24) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text for the sentencepiece model at path."""

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, none, size, own, word, times = unbundle(left["blob"][0].as_py(), np.int64, np.uint8, np.int64, np.int64, np.int32, np.int32)
        got = sorted(right.select(["bucket", "blob"]).to_pylist(), key=lambda r: r["bucket"])
        n = np.concatenate([np.zeros(0, np.int32), *(unbundle(r["blob"], np.int32)[0] for r in got)])
        ends = np.cumsum(own)
        sums = np.concatenate([[0], np.cumsum(n[word].astype(np.int64) * times)])
        total = sums[ends] - sums[ends - own]
        return pa.table([pa.array(ids, mask=none.astype(bool)), pa.array(size), pa.array(total, pa.int64()), pa.array(total > limit)], schema=_ARROW)

    rows = texts(docs, id_col=id_col, text_col=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = text_bytes(rows)
    buckets = parts_for(size, chunk_bytes, least)
    sent = stored(rows.mapInArrow(_chunks(max(chunk_bytes, size // buckets), buckets), ROW), "pretokens", "kind")
    answers = sent.where(F.col("kind") == SENT).groupBy("bucket").applyInArrow(lean(_counted(path)), ROW)
    return sent.where(F.col("kind") == KEPT).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lean(summed), SCHEMA)
