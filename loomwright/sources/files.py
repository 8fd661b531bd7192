"""Where inputs lie: paths and patterns through Hadoop's file systems, so that local, HDFS and object stores are alike."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SpecError

#: Files that belong to another one of the same stem and are no input of their own (fixed values).
SIDECARS = (".hdr",)
#: Archives that are never matched (fixed values).
REFUSED = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _plain(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def joined(base: str, ref: str) -> str:
    return ref if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:/", ref) or os.path.isabs(ref) or base in ("", ".") else f"{base.rstrip('/')}/{ref}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def listed(spark: SparkSession, folder: str, recursive: bool = False) -> list[str]:
    """Files of a folder, sorted by path; hidden ones are left out."""
    fs, where = _file_system(spark, folder)
    out = []
    for status in fs.listStatus(where):
        path = _plain(status.getPath().toString())
        name = os.path.basename(path)
        if name[:1] in "._":
            continue
        if status.isDirectory() and not name.endswith(".parquet"):
            out += listed(spark, path, True) if recursive else []
        else:
            out.append(path)
    return sorted(out)


def resolve(ref: str, base: str = ".", spark: SparkSession | None = None) -> list[str]:
    """Paths that a reference stands for, sorted: an existing name before a pattern, the base folder first."""
    spark = spark or SparkSession.active()
    for root in dict.fromkeys((base, "")):
        path = joined(root, ref)
        if exists(spark, path):
            return [path]
        if re.search(r"[*?\[{]", ref):
            fs, where = _file_system(spark, path)
            if found := fs.globStatus(where):
                return sorted(_plain(s.getPath().toString()) for s in found)
    raise SpecError(f"{ref} is not there")


@dataclass
class Item:
    """One input: its name for conventions, where it lies (or the value itself), and the files that go with it."""

    name: str
    path: str | None
    kind: str = "file"
    value: object = None
    sidecars: list[str] = field(default_factory=list)


def items(spark: SparkSession, what, base: str = ".") -> list[Item]:
    """The inputs that a folder, a file, a pattern, a list of these, frames or arrays stand for, in a fixed order."""
    if isinstance(what, DataFrame):
        return [Item("frame", None, "frame", what)]
    if isinstance(what, (list, tuple)) and what and all(isinstance(x, (str, os.PathLike, DataFrame)) for x in what):
        out = [i for x in what for i in items(spark, x, base)]
        seen: dict[str, int] = {}
        for i in out:  # frames are told apart by their place
            seen[i.name] = seen.get(i.name, 0) + 1
            if i.kind == "frame" and seen[i.name] > 1:
                i.name += str(seen[i.name] - 1)
        return out
    if isinstance(what, (str, os.PathLike)):
        paths = resolve(os.fspath(what), base, spark)
        if len(paths) == 1 and is_folder(spark, paths[0]) and not paths[0].endswith(".parquet"):
            paths = listed(spark, paths[0])
        own = {p for p in paths if p.lower().endswith(SIDECARS) and any(q != p and stem_of(q) == stem_of(p) for q in paths)}
        kept = [p for p in paths if p not in own and not p.lower().endswith(REFUSED)]
        return [Item(os.path.basename(p), p, "file", None, sorted(s for s in own if stem_of(s) == stem_of(p))) for p in kept]
    if isinstance(what, list) and all(isinstance(x, dict) for x in what):
        return [Item("rows", None, "rows", what)]
    return [Item("arrays", None, "arrays", what)]


def stem_of(path: str) -> str:
    """A file's name without its extension, a compound one as a whole."""
    name = os.path.basename(path)
    return re.sub(r"(?i)(\.csv\.(gz|zip)|(?<=.)\.[^.]*)$", "", name)


def reference_table(found: list[Item], refs: list[str]) -> dict[str, Item]:
    """The one input that each reference means; none or several is an error."""
    out = {}
    for ref in refs:
        same = [i for i in found if ref in (i.name, i.path)]
        if len(same) != 1:
            raise SpecError(f"{ref} stands for {len(same)} inputs")
        out[ref] = same[0]
    return out


def content_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, n_bytes, sha256 of each file (of up to 2 GB)."""
    df = spark.read.format("binaryFile").load(paths)
    return df.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
