"""Samples with several sources: matrices, long series, tables; aligned by identity, with presence, and checked for leaks.

A cohort is a DataFrame with one row for each sample: its id, and if declared its partition, fold, group, origin, unit
and repetition. A source is a DataFrame with the id; long sources have several rows for each sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import DataError, SpecError
from .functions.json_text import digest
from .operators import joins, missing
from .operators.partitions import PARTITION
from .operators.position import POS, with_position
from .plans.planner import Dataset
from .sources import files, readers

KINDS = ("matrix", "series", "table", "image")
#: The order of the closed replay form (fixed values).
REPLAY = ("nir", "image", "series", "metadata")


@dataclass
class Part:
    """One source of a cohort: columns are its values; a series has a time column, and several rows for each sample."""

    df: DataFrame
    kind: str = "matrix"
    columns: list[str] = field(default_factory=list)
    time: str | None = None
    axis: list[float] | None = None


class Cohort:
    def __init__(self, rows: DataFrame, id_col: str, parts: dict[str, Part] | None = None, partition: str | None = None, fold: str | None = None, group: str | None = None, origin: str | None = None, unit: str | None = None, repetition: str | None = None, strict: bool = False):
        self.rows, self.id, self.parts, self.strict = rows, id_col, dict(parts or {}), strict
        self.partition, self.fold, self.group, self.origin, self.unit, self.repetition = partition, fold, group, origin, unit, repetition
        self._check()

    # ------------------------------------------------------------ checks

    def _none(self, df: DataFrame, message: str) -> None:
        if found := df.limit(1).collect():
            raise DataError(message.format(found[0][0]))

    def _check(self) -> None:
        r, key = self.rows, F.col(f"`{self.id}`")
        self._none(r.where(key.isNull() | (F.length(key.cast("string")) == 0)).select(key), "a sample has no id")
        self._none(r.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "the id {} is there twice")
        if self.partition:
            self._none(r.where(F.col(self.partition).isNotNull() & ~F.col(self.partition).isin("train", "test", "predict")).select(self.partition), "no partition is called {}")
            for who in filter(None, (self.group, self.unit)):
                self._none(r.where(F.col(who).isNotNull()).groupBy(who).agg(F.count_distinct(self.partition).alias("n")).where("n > 1"), "{} lies in several partitions")
        if self.fold and self.partition:
            self._none(r.where(F.col(self.fold).isNotNull() & (F.coalesce(F.col(self.partition), F.lit("")) != "train")).select(self.id), "{} has a fold and is no training sample")
        if self.origin:
            where = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in filter(None, (self.partition, self.fold))])
            self._none(r.where(F.col(self.origin).isNotNull()).groupBy(self.origin).agg(F.count_distinct(where).alias("n")).where("n > 1"), "samples of the origin {} lie in several partitions or folds")
        if self.unit:
            by = [self.unit, *([self.repetition] if self.repetition else [])]
            self._none(r.where(F.col(self.unit).isNotNull()).groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), "the unit {} repeats without a repetition of its own")
        for name, p in self.parts.items():
            self._check_part(name, p)

    def _check_part(self, name: str, p: Part) -> None:
        if p.kind not in KINDS:
            raise SpecError(f"{name}: no source is a {p.kind}")
        if absent := [c for c in (self.id, *p.columns, *([p.time] if p.time else [])) if c not in p.df.columns]:
            raise SpecError(f"{name} has no column {absent[0]!r}")
        if p.axis is not None:
            if len(set(p.axis)) != len(p.axis) or len(p.axis) != len(p.columns) or any(x != x or abs(x) == float("inf") for x in p.axis):
                raise DataError(f"{name}: an axis has one finite coordinate of its own for each column")
            if not (all(a < b for a, b in zip(p.axis, p.axis[1:], strict=False)) or all(a > b for a, b in zip(p.axis, p.axis[1:], strict=False))):
                raise DataError(f"{name}: an axis only rises or only falls")
        extra = p.df.join(self.rows, self.id, "left_anti").select(self.id)
        self._none(extra, f"{name}: {{}} is no sample of the cohort")
        if self.strict:
            self._none(self.rows.join(p.df, self.id, "left_anti").select(self.id), f"{name}: {{}} has no row")
        if p.kind == "series":
            if not p.time:
                raise SpecError(f"{name}: a series has a time column")
            self._none(p.df.groupBy(self.id, p.time).agg(F.count("*").alias("n")).where(F.col(p.time).isNull() | (F.col("n") > 1)), f"{name}: a time of {{}} is missing or there twice")
            if p.columns:
                finite = [F.coalesce(~F.isnan(F.col(f"`{c}`").cast("double")), F.lit(False)).cast("int") for c in p.columns]
                self._none(p.df.groupBy(self.id).agg(F.max(F.greatest(*finite) if len(finite) > 1 else finite[0]).alias("any")).where("any = 0"), f"{name}: {{}} is present and has no finite value")
        else:
            self._none(p.df.groupBy(self.id).agg(F.count("*").alias("n")).where("n > 1"), f"{name}: {{}} has several rows")

    # ------------------------------------------------------------ views

    def aligned(self, name: str) -> DataFrame:
        """A source with every sample once: its columns (a series as an array of points in the order of time) and `present`."""
        p = self.parts[name]
        df = p.df.select(self.id, *[f"`{c}`" for c in p.columns])
        if p.kind == "series":
            points = F.sort_array(F.collect_list(F.struct(p.time, *[f"`{c}`" for c in p.columns])))
            df = p.df.groupBy(self.id).agg(points.alias("points"))
        return joins.align_cohort(self.rows.select(self.id), df, self.id, self.strict)

    def masks(self, name: str) -> DataFrame:
        """id, present, and whether each value of a source is observed; what is not is never a value."""
        df = self.aligned(name)
        return df.select(self.id, "present", *[(F.col("present") & ~missing.is_missing(df, c)).alias(f"observed__{c}") for c in self.parts[name].columns if c in df.columns])

    def source_values(self, names: list[str], ids: list) -> DataFrame:
        """__at and the sources' columns, for the samples asked for, in that order; a sample may be asked for twice. Columns of a name that two sources have get the source's name before them."""
        if unknown := [n for n in names if n not in self.parts]:
            raise SpecError(f"there is no source {unknown[0]!r}")
        if len(set(names)) != len(names):
            raise SpecError("a source is asked for twice")
        kind = dict(self.rows.dtypes)[self.id]
        spark = self.rows.sparkSession
        wanted = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"__at long, `{self.id}` {kind}")
        self._none(wanted.join(self.rows, self.id, "left_anti").select(self.id), "{} is no sample of the cohort")
        seen: set[str] = set()
        out = wanted
        for n in names:
            df = self.aligned(n)
            named = {c: f"{n}__{c}" if c in seen else c for c in df.columns if c not in (self.id, "present")} | {"present": f"{n}__present"}
            seen |= set(named)
            out = out.join(df.withColumnsRenamed(named), self.id, "left")
        return out.orderBy("__at")

    def dense(self, name: str, target: str | None = None) -> DataFrame:
        """id, x (an array of doubles) and y: one complete source of numbers; anything missing is refused."""
        df, p = self.aligned(name), self.parts[name]
        if p.kind != "matrix":
            raise SpecError(f"{name} is no matrix")
        cells = [F.col(f"`{c}`").cast("double") for c in p.columns]
        out = df.select(self.id, "present", F.array(*cells).alias("x"))
        if target:
            out = out.join(self.rows.select(self.id, F.col(target).cast("double").alias("y")), self.id)
        gap = ~F.col("present") | F.exists("x", lambda v: v.isNull() | F.isnan(v))
        if target:
            gap = gap | F.col("y").isNull() | F.isnan("y")
        self._none(out.where(gap).select(self.id), "{} misses something: dense rows are complete")
        return out.drop("present")

    def projected(self, names: list[str]) -> DataFrame:
        """id, x: the matrices' values side by side, in the order of the names, and where each begins (provenance())."""
        out = self.rows.select(self.id)
        for n in names:
            out = out.join(self.dense(n).withColumnRenamed("x", f"__x_{n}"), self.id)
        return out.select(self.id, F.concat(*[F.col(f"__x_{n}") for n in names]).alias("x"))

    def provenance(self, names: list[str]) -> list[dict]:
        at, out = 0, []
        for n in names:
            out.append({"source": n, "begin": at, "end": at + len(self.parts[n].columns)})
            at = out[-1]["end"]
        return out

    def replay(self) -> DataFrame:
        """The four sources of the closed form, in its order; others, or fewer, are refused."""
        if set(self.parts) != set(REPLAY):
            raise SpecError(f"the form has the sources {', '.join(REPLAY)} and no others")
        out = self.rows.select(self.id)
        for n in REPLAY:
            df = self.aligned(n)
            out = out.join(df.select(self.id, F.struct(*[F.col(f"`{c}`") for c in df.columns if c != self.id]).alias(n)), self.id)
        return out

    def fingerprint(self) -> str:
        """Digest of the cohort's rows and sources, whatever the order of their rows: the sum of row hashes, made in one aggregate each."""
        sums = {}
        for name, df in {"": self.rows, **{n: p.df for n, p in self.parts.items()}}.items():
            h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")
            r = df.agg(F.count("*").alias("n"), F.sum(h).alias("s")).first()
            sums[name] = [r["n"], str(r["s"]), sorted(f"{c} {k}" for c, k in df.dtypes)]
        return digest(sums)

    # ------------------------------------------------------------ exports

    def envelope(self) -> dict:
        """What a coordinator is told: schema, relations, counts by partition and fold; leaks were refused before."""
        by = [c for c in (self.partition, self.fold) if c]
        counts = [r.asDict() for r in self.rows.groupBy(*by).agg(F.count("*").alias("n_samples")).orderBy(*by).collect()] if by else [{"n_samples": self.rows.count()}]
        return {
            "id": self.id, "relations": {k: getattr(self, k) for k in ("partition", "fold", "group", "origin", "unit", "repetition") if getattr(self, k)},
            "sources": {n: {"kind": p.kind, "columns": p.columns, "time": p.time, "axis": p.axis} for n, p in self.parts.items()}, "counts": counts, "fingerprint": self.fingerprint(),
        }

    def to_dataset(self, name: str, targets: list[str], masked: dict[str, str] | None = None) -> Dataset:
        """A Dataset of one complete matrix: identity columns are metadata, a label whose mask is false is missing, fold ids become folds, which every training row must then have."""
        p = self.parts[name]
        if p.kind != "matrix":
            raise SpecError(f"{name} is no matrix")
        self.dense(name)
        meta = [c for c in dict.fromkeys((self.id, self.group, self.origin, self.unit, self.repetition)) if c]
        rows = self.rows
        for t, mask in (masked or {}).items():
            self._none(rows.where(F.col(mask) & (F.col(t).isNull() | F.isnan(F.col(t).cast("double")))).select(self.id), f"the mask shows a {t} of {{}} that is missing")
            rows = rows.withColumn(t, F.when(F.col(mask), F.col(t)))
        df = rows.select(*dict.fromkeys([*meta, *targets, *filter(None, (self.partition, self.fold))])).join(self.aligned(name).drop("present"), self.id)
        df = with_position(df, self.id).withColumn(PARTITION, F.coalesce(F.col(self.partition), F.lit("train")) if self.partition else F.lit("train"))
        folds = None
        if self.fold:
            train = df.where(F.col(PARTITION) == "train")
            self._none(train.where(F.col(self.fold).isNull()).select(self.id), "the training sample {} has no fold")
            from .operators import folds as fold_rows
            from .operators import partitions

            folds = fold_rows.translated(df, partitions.folds_by_column(train, self.fold, POS).withColumnRenamed(POS, "pos"))
        return Dataset(df, {"features": list(p.columns), "targets": list(targets), "metadata": meta, "weights": [], "ignore": []}, folds=folds)

    def batches(self, name: str, size: int, target: str | None = None, drop_last: bool = False, begin: int = 0) -> Iterator[Batch]:
        """Batches in the order of ids, from row `begin` on: read by position range, so that a batch and never the source is held."""
        if size < 1:
            raise SpecError("a batch has a row at least")
        import numpy as np

        rows = with_position(self.dense(name, target), self.id)
        n = rows.count()
        for at in range(begin, n, size):
            if drop_last and at + size > n:
                return
            own = rows.where(F.col(POS).between(at, min(at + size, n) - 1)).orderBy(POS).collect()
            yield Batch([r[self.id] for r in own], np.array([r["x"] for r in own]), np.array([r["y"] for r in own]) if target else None, at + len(own))


@dataclass
class Batch:
    """ids, x, y of some rows, and the row after them, from which batches() goes on."""

    ids: list
    x: object
    y: object
    after: int


# ---------------------------------------------------------------- made cohorts


@dataclass
class Provider:
    """A cohort that a pure function of (seed, params, context) makes; a checkpoint names the recipe and what it made, and restoring makes it again and compares."""

    generate: Callable[[int, dict, dict], Cohort]
    base: Cohort | None = None
    may_replace: tuple[str, ...] = ()

    def materialize(self, seed: int, params: dict | None = None, context: dict | None = None) -> Cohort:
        made = self.generate(seed, params or {}, context or {})
        if self.base is not None:
            if changed := [n for n in set(made.parts) | set(self.base.parts) if n not in self.may_replace and (n not in made.parts or n not in self.base.parts or _sum(made.parts[n].df) != _sum(self.base.parts[n].df))]:
                raise DataError(f"{sorted(changed)[0]} may not be replaced")
            if _sum(made.rows) != _sum(self.base.rows):
                raise DataError("samples, groups and partitions may not change")
        return made

    def checkpoint(self, seed: int, params: dict | None = None, context: dict | None = None, after: int = 0) -> dict:
        own = {"seed": seed, "params": params or {}, "context": context or {}, "after": after}
        return own | {"fingerprint": self.materialize(seed, params, context).fingerprint()}

    def restore(self, checkpoint: dict) -> tuple[Cohort, int]:
        made = self.materialize(checkpoint["seed"], checkpoint["params"], checkpoint["context"])
        if made.fingerprint() != checkpoint["fingerprint"]:
            raise DataError("what was made is not what the checkpoint says")
        return made, checkpoint["after"]


def _sum(df: DataFrame) -> tuple:
    r = df.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)"))).first()
    return (*r, tuple(sorted(df.dtypes)))


# ---------------------------------------------------------------- files of several kinds


def dosages(spark: SparkSession, path: str, id_col: str = "sample") -> DataFrame:
    """Samples by variants from a VCF text: the number of alternative alleles of each genotype, missing where any allele is."""
    rows = readers.lines(spark, path)
    head = rows.where(F.col("value").startswith("#CHROM")).select("value").first()
    if head is None:
        raise DataError(f"{path} has no header of samples")
    names = head[0].split("\t")[9:]
    cells = rows.where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(F.split("value", "\t").alias("c"))
    each = cells.select(F.when(F.get("c", F.lit(2)) != ".", F.get("c", F.lit(2))).otherwise(F.concat_ws("_", F.get("c", F.lit(0)), F.get("c", F.lit(1)))).alias("variant"), F.posexplode(F.slice("c", 10, len(names))).alias("nth", "cell"))
    alleles = F.split(F.split("cell", ":")[0], r"[/|]")
    dose = F.when(~F.array_contains(alleles, "."), F.size(F.filter(alleles, lambda a: a != "0"))).cast("double")
    long = each.select(F.get(F.lit(names), F.col("nth")).alias(id_col), "variant", dose.alias("dosage"))
    variants = [r[0] for r in long.select("variant").distinct().orderBy("variant").collect()]  # columns of the result
    return long.groupBy(id_col).pivot("variant", variants).agg(F.first("dosage"))


def import_files(spark: SparkSession, manifest: dict, base: str = ".") -> Cohort:
    """A cohort from a manifest: id, cohort (a table of samples) and sources, each with kind and file: numeric (a table), series (long, with time), image (a table that names files) or vcf."""
    key = manifest["id"]
    find = lambda name: files.resolve(name, base, spark)[0]
    options = {k: manifest[k] for k in ("delimiter", "decimal") if k in manifest}
    rows = readers.read(spark, find(manifest["cohort"]), **options).drop(POS)
    if key not in rows.columns:
        raise SpecError(f"the cohort has no column {key!r}")
    parts = {}
    for name, s in manifest["sources"].items():
        kind = s.get("kind")
        own = {k: s.get(k, v) for k, v in {"delimiter": options.get("delimiter", ";"), "decimal": options.get("decimal", ".")}.items()}
        if kind == "vcf":
            df = dosages(spark, find(s["file"]), key)
            parts[name] = Part(df, "matrix", [c for c in df.columns if c != key])
        elif kind in ("numeric", "table", "series"):
            df = readers.read(spark, find(s["file"]), **own).drop(POS)
            values = [c for c in df.columns if c not in (key, s.get("time"))]
            if kind != "table" and (text := [c for c in values if dict(df.dtypes)[c] == "string"]):
                raise DataError(f"{name}: {text[0]} has cells that are no numbers")
            parts[name] = Part(df, {"numeric": "matrix"}.get(kind, kind), values, s.get("time"))
        elif kind == "image":
            table = readers.read(spark, find(s["file"]), **own).drop(POS)
            column = s.get("column", "file")
            at = files.joined(base, "")
            wanted = table.select(key, F.concat(F.lit(at if at.endswith("/") or not at else at + "/"), F.col(column)).alias("path"))
            paths = [r[0] for r in wanted.select("path").distinct().collect()]  # names of files, which Spark takes as a list
            raw = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content", F.col("length").alias("n_bytes"))
            parts[name] = Part(wanted.join(raw, "path", "left").drop("path"), "image", ["content", "n_bytes"])
        else:
            raise SpecError(f"{name}: no file is a {kind}")
    return Cohort(rows, key, parts, **{k: manifest[k] for k in ("partition", "fold", "group", "origin", "unit", "repetition", "strict") if k in manifest})
