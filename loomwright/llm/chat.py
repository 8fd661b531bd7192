"""Chat formatting by columnar byte assembly.

A turn becomes ``<|turn|>ROLE\\nTEXT<|end|>\\n``. Inside ROLE and TEXT a backslash is put before each backslash and
after the first character of each control string, so that no control string is left in them; taking each backslash
away and keeping what follows gives the original back. A line break in a role gets a backslash before it.

Nulls: a null role or text is empty, null conversation ids are one conversation, null turns come first. Equal turns are
ordered by role and text, and repeated rows are turns each. A turn's text is in one segment, however long. An empty table
gives an empty result. Columns other than the four named ones are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, ragged, short_batches, slices

HEAD, END = b"<|turn|>", b"<|end|>\n"
#: Strings that are never left as they are inside a text: those of this template and of common other ones.
CONTROL = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
SEGMENTS = "conv_id long, segment int, last boolean, n_turns int, formatted string, loss array<struct<start:int,stop:int>>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("last", pa.bool_()), ("n_turns", pa.int32()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])


def _occurrences(body: np.ndarray, offsets: np.ndarray, what: bytes) -> np.ndarray:
    """Where a byte string begins within the rows of a flat column."""
    at = np.flatnonzero(body == what[0])
    for k in range(1, len(what)):
        at = at[at + k < len(body)]
        at = at[body[at + k] == what[k]]
    row = np.searchsorted(offsets, at, side="right")
    return at[at + len(what) <= offsets[row]] if len(at) else at


def escaped(body: np.ndarray, offsets: np.ndarray, breaks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A flat column with its control strings escaped; breaks: line breaks too."""
    added = [np.flatnonzero(body == ord("\\"))] + [_occurrences(body, offsets, c.encode()) + 1 for c in CONTROL]
    if breaks:
        added.append(np.flatnonzero(body == ord("\n")))
    before = np.sort(np.concatenate(added))  # a backslash goes before each of these bytes
    if not len(before):
        return body, offsets
    out = np.full(len(body) + len(before), ord("\\"), np.uint8)
    out[np.arange(len(body)) + np.searchsorted(before, np.arange(len(body)), side="right")] = body
    return out, offsets + np.searchsorted(before, offsets, side="left")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def assembled(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns' bytes in one buffer, each turn's offset in it, and where each turn's text begins and ends."""
    n = len(text)
    parts = [(np.frombuffer(HEAD, np.uint8), None), escaped(*flat(role), breaks=True), (np.frombuffer(b"\n", np.uint8), None), escaped(*flat(text)), (np.frombuffer(END, np.uint8), None)]
    lengths = np.stack([np.full(n, len(b)) if o is None else np.diff(o) for b, o in parts], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(n, len(parts)) if n else np.zeros((0, len(parts)), np.int64)
    buffer = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, (b, o) in enumerate(parts):
        to = ragged(ends[:, k] - lengths[:, k], lengths[:, k])
        buffer[to] = np.tile(b, n) if o is None else b
    offsets = np.concatenate([[0], ends[:, -1]]).astype(np.int64)
    return buffer, offsets, ends[:, 3] - lengths[:, 3], ends[:, 3]


def _segments(batches):
    """One row for each conversation of each slice; a conversation that goes on in the next slice is not `last`.

    A slice's text column is the assembled buffer itself, with offsets where conversations begin; likewise the spans.
    """
    held, number = None, 0  # the last row waits until the next slice shows whether its conversation goes on
    text_kind, loss_kind = _ARROW.field("formatted").type, _ARROW.field("loss").type

    def row(of: pa.RecordBatch, last: bool) -> pa.RecordBatch:
        return of.set_column(2, "last", pa.array([last], pa.bool_()))

    for batch in batches:
        for part in slices(batch):
            conv = part.column("conv_id")
            buffer, offsets, start, stop = assembled(part.column("role"), part.column("text"))
            chars = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])
            loss = pc.fill_null(pc.equal(part.column("role"), "assistant"), False).to_numpy(zero_copy_only=False)
            ids, none = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (none[1:] != none[:-1]), [True]]))
            same = held is not None and held.column("conv_id")[0].as_py() == conv[0].as_py()
            if held is not None:
                yield row(held, not same)
            segment = np.zeros(len(cut) - 1, np.int32)
            segment[0] = number + 1 if same else 0
            number = int(segment[-1])
            spans = np.flatnonzero(loss)
            low = np.repeat(chars[offsets[cut[:-1]]], np.diff(cut))[spans]
            span = pa.StructArray.from_arrays([pa.array(chars[x[spans]] - low, pa.int32()) for x in (start, stop)], fields=list(loss_kind.value_type))
            formatted = pa.Array.from_buffers(text_kind, len(cut) - 1, [None, pa.py_buffer(offsets[cut].astype(np.int32)), pa.py_buffer(buffer)])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(spans, cut), pa.int32()), span, type=loss_kind)
            whole = pa.RecordBatch.from_arrays([conv.take(pa.array(cut[:-1])), pa.array(segment), pa.array(np.ones(len(segment), bool)), pa.array(np.diff(cut), pa.int32()), formatted, lists], schema=_ARROW)
            if len(segment) > 1:
                yield whole.slice(0, len(segment) - 1)
            held = whole.slice(len(segment) - 1)
    if held is not None:
        yield row(held, True)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formatted conversations in turn order: conv_id, segment, last, n_turns, formatted, loss (character spans of assistant texts).

    A conversation is dealt to one task and streamed through it in sorted order: its digest or its text is one sequence,
    so that a hot conversation costs its task time but never memory. Its text comes in segments of about 4 MB.
    """
    short_batches(turns.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_segments, SEGMENTS)


_TURN = re.compile(re.escape(HEAD.decode()) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(END.decode()), re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn begins at character {at}")
        turns.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return turns


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches):
    state = None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if state is None:
                state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(r["formatted"]):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in r["loss"]:
                text = unescaped(r["formatted"][span["start"] : span["stop"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(r["formatted"])
            if r["last"]:
                out.append((r["conv_id"], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                state = None
        if out:
            names = [c.split()[0] for c in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if isinstance(next((x for x in c if x is not None), 0), int) else pa.string()) for c in zip(*out, strict=True)], names=names)


def read_back(segments: DataFrame) -> DataFrame:
    """What the formatted conversations hold, parsed from their text alone; segments must be in format_conversations' order."""
    return segments.mapInArrow(_digests, DIGESTS)
