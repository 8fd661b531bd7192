"""What several operators share: the shared folder, vectorised word splitting, and the blob exchange.

The blob exchange counts things that occur in texts (words, word pairs, shingles) without a Spark row for each.
Documents are dealt into chunks by a hash of their id; a chunk sends one packed blob of sorted 64-bit hashes to each
hash bucket; a bucket merges its blobs and sends each chunk an answer for each hash, in the order in which they came.
A chunk sends a hash once however often it holds it, so a hot word weighs no more in a bucket than a rare one.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that are looked at together by the vectorised code.
BLOCK_BYTES = 1 << 20


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on a single machine that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", named := f"file://{tempfile.mkdtemp(prefix='shared-')}")
    return named


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives the loss of executors. by: a column whose values get folders of their own, so that a filter on it reads only theirs."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def text_bytes(rows: DataFrame) -> int:
    """Bytes of all texts, counted."""
    return rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts_for(size: int, each: int, least: int = 24, pivot: int = 256) -> int:
    """Parts to cut `size` bytes into: of about `each` bytes up to `pivot` parts, and beyond that as many more as they grow larger.

    Every part of one side sends a blob to every part of the other, so that blobs grow in proportion to the input.
    """
    n = max(1, -(-size // each))
    return max(least, n if n <= pivot else int(np.ceil((n * pivot) ** 0.5)))


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of fewer rows than Spark's 10,000, unless the session names a number: texts can be long, and a batch is held twice."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def texts(docs: DataFrame, *more: str | Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), with the further columns asked for."""
    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def low_hash(h: Column, of: Column, share: dict) -> Column:
    """Whether a 64-bit hash is among the share of lowest ones that the group `of` names; a share of 1 or more is all."""
    limit = F.create_map(*[F.lit(x) for k, s in share.items() for x in (k, min(int(s * 2.0**64) - (1 << 63), (1 << 63) - 1))])
    return h <= limit[of]


# ---------------------------------------------------------------- arrow


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about so many bytes of text each (a longer text is a part of its own)."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def gathered(batches, most: int, column: str = "text") -> Iterator[pa.Table]:
    """The rows of all batches as tables with about so many bytes of text each."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, column, most):
            own = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + own > most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, all in one array, and the offsets of its rows (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8, offsets[-1]) if data is not None and len(column) else np.zeros(0, np.uint8)
    return body[offsets[0] :], offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def _trim() -> None:
    """Give freed memory back: an executor's Python workers share little, and wait for their next task with what they hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(function):
    """function, whose freed memory goes back to the system after each call."""

    def run(*args):
        try:
            return function(*args)
        finally:
            _trim()

    one = function.__code__.co_argcount - len(function.__defaults__ or ()) == 1  # Spark counts the arguments
    return (lambda table: run(table)) if one else (lambda left, right: run(left, right))


# ---------------------------------------------------------------- words and their hashes

_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15)
_P_INVERSE = U64(pow(int(_P), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1024)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, p, U64)])) for p in (_P, _P_INVERSE)]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def words(body: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every word, in order. apart: for each byte value, whether it separates words."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    gap = apart[body]
    begin = ~gap
    begin[1:] &= gap[:-1]
    first = offsets[:-1][offsets[:-1] < len(body)]
    begin[first] = ~gap[first]
    starts = np.flatnonzero(begin)
    stop = gap.copy()
    stop[first] = True
    # a word ends at the next separator or at the next row
    stops = np.flatnonzero(stop)
    at = np.searchsorted(stops, starts, side="right")
    ends = np.append(stops, len(body))[at]
    hashes = np.empty(len(starts), U64)
    done = 0
    while done < len(starts):
        low = int(starts[done])
        to = max(done + 1, int(np.searchsorted(ends, low + BLOCK_BYTES, side="right")))
        high = int(ends[to - 1])
        power, inverse = _powers(high - low + 1)
        sums = np.zeros(high - low + 1, U64)
        np.cumsum(_BYTE[body[low:high]] * power[: high - low], out=sums[1:])
        s, e = starts[done:to] - low, ends[done:to] - low
        hashes[done:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64))
        done = to
    return np.searchsorted(offsets, starts, side="right") - 1, hashes


# ---------------------------------------------------------------- blobs


def packed(values: np.ndarray) -> bytes:
    """Bytes of an integer array by significance, so that the shuffle's compression finds the zeros."""
    return values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def unpacked(blob: bytes, dtype: type, n: int, at: int = 0) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def packed_sorted(hashes: np.ndarray) -> bytes:
    return packed(np.diff(hashes, prepend=U64(0)))


def unpacked_sorted(blob: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.cumsum(unpacked(blob, U64, n, at), dtype=U64)


def bundle(*arrays: np.ndarray) -> bytes:
    """Integer or float arrays as one compressed blob."""
    raw = np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(packed(np.ascontiguousarray(a)) for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unbundle(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds)).tolist(), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(unpacked(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of ascending values, the first from 0; climbed() takes them back."""
    return np.diff(values, prepend=values.dtype.type(0))


def climbed(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=differences.dtype)


def bucket_edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes; buckets are equal ranges of the hash."""
    limits = np.array([((b << 64) + buckets - 1) // buckets for b in range(1, buckets)], dtype=U64)
    return np.concatenate([[0], np.searchsorted(hashes, limits), [len(hashes)]]).astype(np.int64)


def grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, the position of each input among them, and where each begins in sorted order."""
    if not len(hashes):
        return hashes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.empty(len(ranked), bool)
    new[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    group = np.cumsum(new) - 1
    where = np.empty(len(ranked), np.int64)
    where[order] = group
    return ranked[new], where, np.flatnonzero(new)


def chunk_of(chunks: int, id_col: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(chunks)).cast("int").alias("chunk")


def _pack(batches):
    """Rows (chunk, doc_id, text, flag) as a compressed blob for each chunk of a batch."""
    for batch in (part for whole in batches for part in slices(whole, most=8 << 20)):
        order = np.argsort(batch.column("chunk").to_numpy(), kind="stable")
        batch = batch.take(pa.array(order))
        chunk = batch.column("chunk").to_numpy()
        edges = np.append(np.flatnonzero(np.diff(chunk, prepend=-1)), len(chunk))
        body, offsets = flat(batch.column("text"))
        ids, none = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        flag = batch.column("flag").to_numpy(zero_copy_only=False)
        blobs = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            raw = ids[a:b].astype(np.int64).tobytes() + none[a:b].tobytes() + flag[a:b].tobytes() + np.diff(offsets[a : b + 1]).tobytes() + body[offsets[a] : offsets[b]].tobytes()
            blobs.append((b - a, len(raw), pa.compress(raw, codec="zstd", asbytes=True)))
        yield pa.RecordBatch.from_arrays([pa.array(chunk[edges[:-1]], pa.int32()), pa.array([n for n, _, _ in blobs], pa.int32()), pa.array([n for _, n, _ in blobs], pa.int64()), pa.array([b for _, _, b in blobs], pa.binary())], names=["chunk", "rows", "size", "docs"])


def dealt(docs: DataFrame, chunks: int, flag: Column | None = None) -> DataFrame:
    """doc_id and text (and a boolean) of docs as compressed rows of chunks, which take half the room of plain rows in a shuffle."""
    rows = docs.select(chunk_of(chunks), "doc_id", "text", (F.lit(False) if flag is None else flag).alias("flag"))
    return rows.mapInArrow(_pack, "chunk int, rows int, size long, docs binary")


def unpacked_docs(table: pa.Table) -> pa.Table:
    """The documents of a chunk: doc_id, text, flag, in the order of ids."""
    parts = [[], [], []]
    for n, size, blob in zip(table["rows"].to_pylist(), table["size"].to_pylist(), table["docs"].to_pylist(), strict=True):
        raw = pa.decompress(blob, size, codec="zstd", asbytes=True)
        none = np.frombuffer(raw, bool, n, 8 * n)
        lengths = np.frombuffer(raw, np.int64, n, 10 * n)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw[18 * n :])])
        for x, own in zip(parts, (pa.array(np.frombuffer(raw, np.int64, n), mask=none), text, pa.array(np.frombuffer(raw, bool, n, 9 * n))), strict=True):
            x.append(own)
    kinds = (pa.int64(), pa.large_string(), pa.bool_())
    out = pa.table([pa.chunked_array(x, k) for x, k in zip(parts, kinds, strict=True)], names=["doc_id", "text", "flag"])
    return out.sort_by([("doc_id", "ascending")]).combine_chunks()


# ---------------------------------------------------------------- the exchange

def _small(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _whole(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


SENT = "bucket int, chunk int, n int, blob binary"
ANSWER = "chunk int, kind int, bucket int, n int, blob binary"
_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])


def sent(hashes: np.ndarray, values: list[np.ndarray], chunk: int, buckets: int, kind: int = 0) -> pa.Table:
    """What a chunk sends: sorted distinct hashes, each with its values, cut into the buckets of its kind."""
    edges = bucket_edges(hashes, buckets)
    rows = [(kind * buckets + b, chunk, hi - lo, _small(packed_sorted(hashes[lo:hi]) + b"".join(packed(np.ascontiguousarray(v[lo:hi])) for v in values))) for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if hi > lo]
    return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT) if rows else _SENT.empty_table()


class Received:
    """All blobs of a bucket: for each entry its hash's place among the distinct hashes, and its values."""

    def __init__(self, table: pa.Table, *kinds: type):
        self.chunks, self.sizes = table["chunk"].to_pylist(), table["n"].to_pylist()
        hashes, values = [], [[] for _ in kinds]
        for n, blob in zip(self.sizes, map(_whole, table["blob"].to_pylist()), strict=True):
            hashes.append(unpacked_sorted(blob, n))
            at = 8 * n
            for v, kind in zip(values, kinds, strict=True):
                v.append(unpacked(blob, kind, n, at))
                at += np.dtype(kind).itemsize * n
        self.hashes, self.where, _ = grouped(np.concatenate(hashes))
        self.values = [np.concatenate(v) for v in values]

    def sums(self, k: int) -> np.ndarray:
        return np.bincount(self.where, self.values[k], len(self.hashes))

    def answers(self, kind: int, bucket: int, values: list[np.ndarray]) -> pa.Table:
        """To each chunk the values of the hashes that it sent, in its order."""
        rows, at = [], 0
        for chunk, n in zip(self.chunks, self.sizes, strict=True):
            own = self.where[at : at + n]
            rows.append((chunk, kind, bucket, n, _small(b"".join(packed(np.ascontiguousarray(v[own])) for v in values))))
            at += n
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ANSWER, strict=True)], schema=_ANSWER)


def answered(table: pa.Table, kind: int, *kinds: type) -> list[np.ndarray]:
    """The answers of one kind, in the order of the hashes that were sent: buckets are ranges, so by bucket."""
    rows = [(b, n, blob) for b, n, blob, k in zip(table["bucket"].to_pylist(), table["n"].to_pylist(), table["blob"].to_pylist(), table["kind"].to_pylist(), strict=True) if k == kind]
    values = [[np.zeros(0, kind_)] for kind_ in kinds]
    for _, n, blob in sorted(rows, key=lambda r: r[0]):
        at, blob = 0, _whole(blob)
        for v, kind_ in zip(values, kinds, strict=True):
            v.append(unpacked(blob, kind_, n, at))
            at += np.dtype(kind_).itemsize * n
    return [np.concatenate(v) for v in values]
