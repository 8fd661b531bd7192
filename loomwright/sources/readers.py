"""Readers by file extension. Text is read as lines with their place in the file, so that nothing is guessed by a reader,
no line is lost, and a row's position is its place in the file and not one that sorting would give it."""

from __future__ import annotations

import csv
import io
import json
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError, SpecError
from ..functions import numeric
from ..operators.missing import na_to_null
from ..operators.position import POS
from .files import resolve  # noqa: F401

READERS: dict[str, Callable[..., DataFrame]] = {}
CANDIDATES, SAMPLE_RECORDS, SAMPLE_BYTES = (",", ";", "\t", "|", " "), 50, 8 << 20


def reader(*extensions: str):
    def add(f):
        READERS.update(dict.fromkeys(extensions, f))
        return f

    return add


def extension(path: str) -> str:
    name = os.path.basename(path).lower()
    return next((e for e in sorted(READERS, key=len, reverse=True) if name.endswith(e)), os.path.splitext(name)[1])


TEXT = (".csv", ".csv.gz", ".csv.zip", ".tsv", ".txt")


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """A file by its extension; an unknown one is tried as delimited text. Options that only text has are dropped for others."""
    kind = extension(path)
    if kind in READERS:
        known = {"delimiter", "decimal", "header", "encoding", "deferred"} if kind not in TEXT else set()
        return READERS[kind](spark, path, **{k: v for k, v in options.items() if k not in known})
    try:
        return read_text(spark, path, **options)
    except (DataError, SpecError) as e:
        raise SpecError(f"no reader for {path}, and it is no delimited text: {e}") from None


def mangled(names: list[str]) -> list[str]:
    """Headers made distinct: a, a.1, a.2; a number that another header has already is left out."""
    taken, seen, out = set(names), {}, []
    for n in names:
        k = seen.get(n, 0)
        name = n
        while k and (name := f"{n}.{k}") in taken:
            k += 1
        taken.add(name)
        out.append(name)
        seen[n] = k + 1
    return out


# ---------------------------------------------------------------- lines

_QUOTES = "(length(value) - length(replace(value, '\"', ''))) % 2 = 1"


def _decoded(raw: bytes, encoding: str | None) -> str:
    try:
        return raw.decode(encoding or "utf-8")
    except UnicodeDecodeError:
        if encoding:
            raise DataError(f"the file is not {encoding}") from None
        return raw.decode("latin-1")


def _whole_records(spark: SparkSession, path: str, encoding: str | None) -> DataFrame:
    """value, __pos of the records of a file that one task must read: an archive, or one with line breaks inside quotes."""
    import zipfile

    import pyarrow as pa

    def records(raw: bytes):
        if path.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                members = [m for m in z.infolist() if not m.is_dir()]
                if len(members) != 1:
                    raise DataError(f"an archive must have one member; this one has {len(members)}")
                raw = z.read(members[0])
        elif path.lower().endswith(".gz"):
            import gzip

            raw = gzip.decompress(raw)
        held: list[str] = []
        for line in io.StringIO(_decoded(raw, encoding)):
            held.append(line.rstrip("\r\n"))
            if sum(x.count('"') for x in held) % 2 == 0:
                yield "\n".join(held)
                held = []
        if held:
            yield "\n".join(held)

    def decode(batches):
        for b in batches:
            for raw in b.column("content").to_pylist():
                nth, out = 0, []
                for record in records(raw):
                    out.append(record)
                    if len(out) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(range(nth, nth + len(out)), pa.int64())], names=["value", POS])
                        nth, out = nth + len(out), []
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(range(nth, nth + len(out)), pa.int64())], names=["value", POS])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, f"value string, {POS} long")


def lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """value, __pos: the records of a text file, numbered from 0 in the file's order. UTF-8, or else Latin-1, unless an encoding is named.

    Each split of the file numbers its own lines; one aggregate, a row for each split, gives what lies before it. No
    line is sorted or sent anywhere. Only a file with line breaks inside quotes, or an archive, is read by one task.
    """
    if path.lower().endswith(".zip"):
        return _whole_records(spark, path, encoding)
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__nth"))
    splits = raw.groupBy("__file", "__block").agg(F.count("*").alias("n"), F.min("__nth").alias("first"), F.count_if(~F.is_valid_utf8("value")).alias("odd"), F.count_if(F.expr(_QUOTES)).alias("open")).orderBy("__file", "__block").collect()
    if any(r["open"] for r in splits):
        if len({r["__file"] for r in splits}) > 1:
            raise DataError("line breaks inside quotes, in a folder of several files: stack the files one by one")
        return _whole_records(spark, path, encoding)
    before, shifts = 0, []
    for r in splits:
        shifts.append((r["__file"], r["__block"], before - r["first"]))
        before += r["n"]
    text = F.col("value")
    if encoding and encoding.lower().replace("-", "") != "utf8":
        text = F.decode(text.cast("binary"), encoding)
    elif any(r["odd"] for r in splits):
        if encoding:
            raise DataError(f"the file is not {encoding}")
        text = F.decode(text.cast("binary"), "ISO-8859-1")
    if len(shifts) <= 1:
        return raw.select(text.alias("value"), (F.col("__nth") + F.lit(shifts[0][2] if shifts else 0)).alias(POS))
    shift = F.broadcast(spark.createDataFrame(shifts, "__file string, __block long, __shift long"))  # a row for each split
    return raw.join(shift, ["__file", "__block"]).select(text.alias("value"), (F.col("__nth") + F.col("__shift")).alias(POS))


def sample(spark: SparkSession, path: str, encoding: str | None = None, n: int = SAMPLE_RECORDS) -> list[str]:
    """The first records of a file."""
    return [r["value"] for r in lines(spark, path, encoding).where(F.col(POS) < n).orderBy(POS).collect()]


def detect_delimiter(records: list[str]) -> tuple[str, float]:
    """The candidate with the most consistent width, and its score; the semicolon among equals."""
    found = delimiter_scores(records)
    best = max(found.values(), default=0.0)
    equal = [d for d, score in found.items() if score == best]
    return (";", 0.0) if not found else (";" if ";" in equal else equal[0], best)


def delimiter_scores(records: list[str]) -> dict[str, float]:
    """Score of each candidate that cuts most records into as many cells, two at least."""
    out = {}
    for d in CANDIDATES:
        widths = [len(r) for r in csv.reader(io.StringIO("\n".join(x for x in records if x)), delimiter=d)]
        if widths and (common := max(set(widths), key=widths.count)) > 1:
            out[d] = 5 * widths.count(common) / len(widths) + min(common / 10, 5)
    return out


def guard_delimiter(records: list[str], delimiter: str, decimal: str | None = ".") -> None:
    """Refuse a file without the declared delimiter that another one cuts into columns throughout, or whose commas may be decimal ones."""
    kept = [x for x in records if x]
    if not kept or any(delimiter in x for x in kept):
        return
    if delimiter != "," and decimal != "," and all(re.fullmatch(r'\s*"?[+-]?\d+,\d+"?\s*', x) for x in kept[1:]) and len(kept) > 1:
        raise DataError(f"the delimiter {delimiter!r} never occurs, and commas may part cells or be decimal marks: declare which")
    other, score = detect_delimiter(kept)
    if score > 5 and other != delimiter and not (other == "," and decimal == ","):
        raise DataError(f"the delimiter {delimiter!r} never occurs; {other!r} fits")


def _cells(record: str, delimiter: str) -> list[str]:
    return next(csv.reader([record], delimiter=delimiter), [])


@reader(*TEXT)
def read_text(spark: SparkSession, path: str, delimiter: str = ";", decimal: str = ".", header: bool = True, typed: bool = True, encoding: str | None = None, deferred: str | None = None) -> DataFrame:
    """A delimited file with __pos, the place of each row. A blank line is a row of missing cells, so is what a short
    record lacks; a record wider than the first is an error. Columns of numbers throughout become numbers. deferred: a
    column to put a cell's refusal into, instead of raising it."""
    whole = lines(spark, path, encoding)
    first = [r["value"] for r in whole.where(F.col(POS) < SAMPLE_RECORDS).orderBy(POS).collect()]
    if first:
        first[0] = first[0].removeprefix("\ufeff")
    guard_delimiter(first, delimiter, decimal)
    head = _cells(first[0], delimiter) if first else []
    names = mangled(head) if header else [str(i) for i in range(len(head))]
    if not names:
        return spark.createDataFrame([], f"value string, {POS} long")
    if POS in names:
        raise SpecError(f"a column may not be called {POS}")
    body = whole.where(f"{POS} > 0").withColumn(POS, F.col(POS) - 1) if header else whole.withColumn("value", F.when(F.col(POS) == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")))
    unquoted = F.regexp_replace("value", '"[^"]*"', "")
    width = F.char_length(unquoted) - F.char_length(F.replace(unquoted, F.lit(delimiter), F.lit(""))) + 1
    wide = body.where(width > len(names)).agg(F.min(F.struct(POS, width.alias("n"))).alias("x")).first()["x"]
    if wide is not None:
        raise DataError(f"row {wide[0]} has {wide['n']} cells, the first record {len(names)}")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxColumns": str(len(names) + 1), "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "multiLine": "true"}
    cells = body.select(POS, F.from_csv("value", F.lit(schema), options).alias("x"))
    df = cells.select(*[F.col(f"x.c{i}").alias(n) for i, n in enumerate(names)], POS)
    return cast_text(df, decimal, deferred) if typed else df


def cast_text(df: DataFrame, decimal: str = ".", deferred: str | None = None) -> DataFrame:
    """Missing cells to null; a column whose other cells all spell numbers becomes long or double: one aggregate decides for all.

    A number that no double holds is refused, or, deferred, named in a column, so that a row that goes does no harm.
    """
    names = [c for c in df.columns if c != POS]
    cells = {c: na_to_null(F.col(f"`{c}`")) for c in names}
    plain = {c: F.translate(x, ",", ".") if decimal == "," else x for c, x in cells.items()}
    bad = lambda test, c: F.count_if(cells[c].isNotNull() & ~F.coalesce(test(plain[c]), F.lit(False)))
    row = df.agg(*[F.struct(bad(numeric.is_integer, c).alias("not_integer"), bad(numeric.is_number, c).alias("not_number"), F.count_if(numeric.misfit(plain[c])).alias("misfits"), F.count_if(numeric.is_integer(plain[c]) & plain[c].try_cast("long").isNull()).alias("beyond")).alias(f"c{i}") for i, c in enumerate(names)]).first()
    out, refused = [], []
    for i, c in enumerate(names):
        r = row[f"c{i}"]
        if r["not_number"]:
            out.append(cells[c].alias(c))
            continue
        if r["misfits"]:
            if not deferred:
                raise DataError(f"{c} has {r['misfits']} numbers that no double holds")
            refused.append(F.when(numeric.misfit(plain[c]), F.lit(f"{c} is a number that no double holds")))
        whole = plain[c].try_cast("long") if not r["not_integer"] and not r["beyond"] else F.when(~numeric.misfit(plain[c]), plain[c].try_cast("double"))
        out.append(whole.alias(c))
    more = [F.coalesce(*refused, F.lit(None).cast("string")).alias(deferred)] if deferred else []
    return df.select(*out, *([POS] if POS in df.columns else []), *more)


def preview(spark: SparkSession, path: str, delimiter: str = ";", decimal: str = ".", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """The first records of a text file as text, and typed."""
    raw = read_text(spark, path, delimiter, decimal, header, typed=False).where(f"{POS} < {SAMPLE_RECORDS - bool(header)}")
    return raw, cast_text(raw, decimal)


# ---------------------------------------------------------------- other formats


@reader(".parquet")
def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Columns in the order asked for; a row's place is that in its file, files in the order of their paths."""
    df = spark.read.parquet(path)
    names = columns or df.columns
    if missing := [c for c in names if c not in df.columns]:
        raise SpecError(f"there is no column {missing[0]!r} in {path}")
    if POS in df.columns:
        return df.select(*names)
    meta = df.select(*[F.col(f"`{c}`") for c in names], F.col("_metadata.row_index").alias("__row"), F.col("_metadata.file_path").alias("__file"))
    files = meta.groupBy("__file").agg(F.count("*").alias("n")).orderBy("__file").collect()  # a row for each file
    before, shifts = 0, []
    for r in files:
        shifts.append((r["__file"], before))
        before += r["n"]
    if len(shifts) <= 1:
        return meta.withColumn(POS, F.col("__row")).drop("__row", "__file")
    shift = F.broadcast(spark.createDataFrame(shifts, "__file string, __shift long"))
    return meta.join(shift, "__file").withColumn(POS, F.col("__row") + F.col("__shift")).drop("__row", "__file", "__shift")


@reader(".npy", ".npz")
def read_npy(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Rows of an array of up to 2 GB, columns 0..n-1, N-D flattened to 2-D; the file is decoded on an executor. An npz archive's array is named, unless it is the only one."""
    import numpy as np
    import pyarrow as pa

    def decode(batches):
        for b in batches:
            for raw in b.column("content").to_pylist():
                a = np.load(io.BytesIO(raw), allow_pickle=False)
                if hasattr(a, "files"):
                    if key is None and len(a.files) != 1 or key is not None and key not in a.files:
                        raise DataError(f"the archive holds {', '.join(a.files)}: name one of them")
                    a = a[key or a.files[0]]
                a = a.reshape(len(a), -1).astype(np.float64)
                for k in range(0, len(a), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, min(len(a), k + 4096))), pa.array(list(a[k : k + 4096]), pa.list_(pa.float64()))], names=[POS, "x"])

    df = spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, f"{POS} long, x array<double>")
    width = df.select(F.size("x")).first()
    return df.select(POS, *[F.get("x", F.lit(i)).alias(str(i)) for i in range(width[0] if width else 0)])


@reader(".xlsx", ".xls")
def read_excel(spark: SparkSession, path: str, sheet: str | int = 0, skip_rows: int = 0, columns: list | None = None) -> DataFrame:
    """A sheet by its name or number, read on the driver; needs pandas with the engine for the format."""
    import pandas as pd

    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    try:
        sheet_rows = pd.read_excel(io.BytesIO(bytes(content)), sheet_name=sheet, skiprows=skip_rows, usecols=columns)
    except ImportError as e:
        raise SpecError(f"sheets need another package: {e}") from None
    sheet_rows.columns = mangled([str(c) for c in sheet_rows.columns])
    sheet_rows[POS] = range(len(sheet_rows))
    return spark.createDataFrame(sheet_rows)


def decoder(*extensions: str):
    """Register a function that makes rows (dicts of scalars) of a file's bytes, for formats that only its maker's decoder reads.

    Columns whose names begin with x_ or whose cells are numbers are the decoder's features; see decoder_features.
    """

    def add(f):
        def run(spark: SparkSession, path: str) -> DataFrame:
            import pyarrow as pa

            def decode(batches):
                for b in batches:
                    for raw in b.column("content").to_pylist():
                        rows = [json.dumps(r) for r in f(raw)]
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(range(len(rows)), pa.int64())], names=["value", POS])

            df = spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, f"value string, {POS} long")
            # each row's own kinds, then for each name the widest of them
            keys = df.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
            found = keys.groupBy("k").agg(F.bool_and(F.col("v").try_cast("double").isNotNull() | F.col("v").isNull()).alias("number")).orderBy("k").collect()
            kinds = ", ".join(f"`{r['k']}` {'double' if r['number'] else 'string'}" for r in found)
            return df.select(POS, F.from_json("value", kinds).alias("x")).select(POS, "x.*")

        READERS.update(dict.fromkeys(extensions, run))
        return f

    return add


def decoder_features(df: DataFrame) -> list[str]:
    """Of what a decoder gives: columns named x_... and columns of numbers."""
    return [c for c, kind in df.dtypes if c != POS and (c.startswith("x_") or kind in ("double", "float", "bigint", "int"))]


# ---------------------------------------------------------------- values at hand


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Scalar objects as rows, with their places; columns in the order in which they are first seen."""
    if bad := next((k for r in rows for k, v in r.items() if isinstance(v, (dict, list, tuple, set))), None):
        raise SpecError(f"{bad} holds more than one value")
    names = list(dict.fromkeys(k for r in rows for k in r))
    if not rows:
        return spark.createDataFrame([], f"value string, {POS} long")
    kinds = []
    for n in names:
        found = {type(r[n]) for r in rows if r.get(n) is not None}
        kinds.append("boolean" if found == {bool} else "bigint" if found == {int} else "double" if found and found <= {int, float} else "string")
    cast = {"double": float, "string": str}
    cells = [tuple(None if r.get(n) is None else cast.get(k, lambda v: v)(r[n]) for n, k in zip(names, kinds, strict=True)) + (i,) for i, r in enumerate(rows)]
    return spark.createDataFrame(cells, ", ".join([f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)] + [f"{POS} long"]))


def from_records(spark: SparkSession, records: list[dict]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Decoded records: each has signals (values by axis labels), targets and metadata. One row each, and which column has which role."""
    rows, roles = [], {"features": [], "targets": [], "metadata": []}
    for nth, record in enumerate(records):
        row: dict = {}
        for signal in record.get("signals", []):
            axis = [str(a) for a in signal["axis"]]
            if len(axis) != len(signal["values"]) or len(set(axis)) != len(axis):
                raise DataError(f"record {nth}: a signal has {len(signal['values'])} values for {len(set(axis))} distinct labels")
            named = axis if not signal.get("name") or len(record["signals"]) == 1 else [f"{signal['name']}__{a}" for a in axis]
            row.update(zip(named, map(float, signal["values"]), strict=True))
            roles["features"] += [n for n in named if n not in roles["features"]]
        for role in ("targets", "metadata"):
            for k, v in (record.get(role) or {}).items():
                if k in row:
                    raise DataError(f"record {nth}: {k} is there twice")
                row[k] = v
                roles[role] += [k] if k not in roles[role] else []
        rows.append(row)
    return from_rows(spark, rows), roles


def from_arrays(spark: SparkSession, x, y=None, split: list[str] | None = None, metadata: dict | None = None) -> DataFrame:
    """Features f0.. with targets y0.., metadata by name and a partition: X alone is for prediction, X and y for training. x may be a dict of X, y, metadata and split."""
    if isinstance(x, dict):
        named = {str(k).lower(): v for k, v in x.items()}
        if unknown := set(named) - {"x", "y", "metadata", "split"} or ("x" not in named and {"x"}):
            raise SpecError(f"arrays are named X, y, metadata and split, not {sorted(unknown)[0]!r}")
        x, y, split, metadata = named["x"], named.get("y", y), named.get("split", split), named.get("metadata", metadata)
    n_rows = len(x)
    for what, own in (("y", y), ("split", split), *(metadata or {}).items()):
        if own is not None and len(own) != n_rows:
            raise DataError(f"{what} has {len(own)} rows, X {n_rows}")
    rows = []
    for i, own in enumerate(x):
        target = [] if y is None else list(y[i]) if hasattr(y[i], "__len__") and not isinstance(y[i], str) else [y[i]]
        more = [None if v[i] is None else str(v[i]) for v in (metadata or {}).values()]
        rows.append((i, *map(float, own), *map(float, target), *more, split[i] if split is not None else ("predict" if y is None else "train")))
    n = len(x[0]) if n_rows else 0
    m = len(rows[0]) - n - 2 - len(metadata or {}) if rows else 0
    schema = ", ".join([f"{POS} long", *[f"f{i} double" for i in range(n)], *[f"y{i} double" for i in range(m)], *[f"`{k}` string" for k in metadata or {}], "__partition string"])
    return spark.createDataFrame(rows, schema)


def read_positions(spark: SparkSession, path: str) -> list[int]:
    """Positions from a file: a JSON array, or numbers between commas or line ends."""
    text = ((spark.read.text(path, wholetext=True).first() or [""])[0] or "").strip()
    try:
        found = json.loads(text) if text.startswith("[") else [int(x) for x in text.replace(",", "\n").split("\n") if x.strip()]
    except ValueError as e:
        raise SpecError(f"{path}: {e}") from None
    if not all(type(i) is int for i in found):
        raise SpecError(f"{path} holds other things than integers")
    return found
