"""From a specification to one DataFrame with roles, a partition and audits. Steps compose lazily; only checks run jobs.

A row's position is its place in the file it came from (stacked files follow each other), or its rank by key where a
frame without an order has one. Row-order joins, index partitions and folds go by it; nothing is sorted to make one up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError, SpecError
from ..functions import text
from ..operators import aggregate as aggregation
from ..operators import categorical, joins, missing, partitions, variations
from ..operators import folds as fold_rows
from ..operators.position import POS, stacked_positions, with_position
from ..sources import files, readers
from ..spec import axes, selectors
from ..spec.model import DEFAULTS, STEM, DatasetSpec, Params, Source, parse
from ..spec.normalize import normalized

ORIGIN = "__origin"


@dataclass
class Dataset:
    """All partitions in one DataFrame (column __partition), which column has which role, and what was found on the way."""

    df: DataFrame
    roles: dict[str, list[str]]
    audits: list[joins.Audit] = field(default_factory=list)
    folds: DataFrame | None = None
    spec: DatasetSpec | None = None
    codebooks: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    na: dict[str, DataFrame] = field(default_factory=dict)
    native: dict[str, str] = field(default_factory=dict)

    def block(self, partition: str, role: str) -> DataFrame:
        return self.df.where(F.col(partitions.PARTITION) == partition).select(*[f"`{c}`" for c in self.roles[role]])

    def ordered(self, partition: str, role: str) -> DataFrame:
        """A block with its rows in their order."""
        rows = self.df.where(F.col(partitions.PARTITION) == partition)
        return (rows.orderBy(POS) if POS in rows.columns else rows).select(*[f"`{c}`" for c in self.roles[role]])

    def partitions(self) -> list[str]:
        found = {r[0] for r in self.df.select(partitions.PARTITION).distinct().collect()}
        return [p for p in partitions.ORDER if p in found]

    def manifest(self) -> DataFrame:
        """partition, role, n_rows, n_columns of every block."""
        sizes = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(len(c)).alias("n_columns")) for r, c in self.roles.items() if c])
        return self.df.groupBy(F.col(partitions.PARTITION).alias("partition")).agg(F.count("*").alias("n_rows")).select("partition", "n_rows", F.inline(sizes))

    def target_labels(self) -> dict[str, str]:
        """The name of each target in its file, where no other target has it."""
        own = {c: self.native.get(c, c) for c in self.roles["targets"]}
        return {c: n if list(own.values()).count(n) == 1 else c for c, n in own.items()}

    def axis(self) -> axes.Axis:
        """Name, unit and coordinates of the features."""
        unit = self.spec.params.header_unit if self.spec else None
        return axes.axis_of([self.native.get(c, c) for c in self.roles["features"]], unit)

    def decoded(self, target: str, out: str = "label") -> DataFrame:
        """The rows with the label of a coded target."""
        if target not in self.codebooks:
            raise SpecError(f"{target} is not coded")
        return categorical.decode(self.df, target, self.codebooks[target], out)

    def aggregated(self) -> DataFrame:
        """One row for each key of the declared aggregation, with its partition."""
        own = self.spec.aggregate if self.spec else None
        if not own or not own.by:
            raise SpecError("no aggregation is declared")
        by = [partitions.PARTITION, own.by]
        if own.method == "vote":
            numbers = aggregation.aggregate(self.df, by, self.roles["features"], "mean")
            for t in self.roles["targets"]:
                numbers = numbers.join(aggregation.vote(self.df, by, t), by, "left")
            return numbers
        rows = self.df
        if own.exclude_outliers:
            rows = aggregation.without_outliers(rows, by, self.roles["features"] + self.roles["targets"], own.outlier_threshold)
        return aggregation.aggregate(rows, by, self.roles["features"] + self.roles["targets"], own.method)

    def row_position_report(self) -> dict:
        """Whether rows are told apart by their place alone, why, and in which partitions."""
        key = self.spec.identity if self.spec else []
        if key:
            return {"used": False, "reason": "identity columns are declared", "partitions": []}
        return {"used": True, "reason": "no identity column is declared", "partitions": self.partitions()}

    def write(self, path: str) -> None:
        self.df.write.partitionBy(partitions.PARTITION).parquet(path)


# ---------------------------------------------------------------- one source


def _read(spark: SparkSession, item, params: Params, base: str, frames: dict[str, DataFrame], deferred: str) -> dict[str, DataFrame]:
    """The tables that an input stands for, by name; each is typed on its own cells."""
    if isinstance(item, DataFrame):
        return {"frame": item}
    if isinstance(item, str) and item in frames:
        return {item: frames[item]}
    if isinstance(item, dict):
        if "array" in item:
            return {"array": readers.from_arrays(spark, item["array"]).drop(partitions.PARTITION)}
        if "rows" in item:
            return {"rows": readers.from_rows(spark, item["rows"])}
        raise SpecError(f"an input names array or rows, not {sorted(item)}")
    options = {"delimiter": params.delimiter, "decimal": params.decimal, "header": params.header, "encoding": params.encoding, "deferred": deferred}
    return {path: readers.read(spark, path, **options, **(params.format or {})) for path in files.resolve(item, base, spark)}


def _load(spark: SparkSession, source: Source, params: Params, base: str, frames: dict[str, DataFrame], warnings: list[str], deferred: str, stem: bool) -> DataFrame:
    loaded: dict[str, DataFrame] = {}
    for item in source.input if isinstance(source.input, list) else [source.input]:
        for name, df in _read(spark, item, params, base, frames, deferred).items():
            loaded[name if name not in loaded else f"{name}#{len(loaded)}"] = df
    if stem:
        loaded = {n: df.withColumn(STEM, F.lit(files.stem_of(n))) for n, df in loaded.items()}
    parts, names = list(loaded.values()), [files.stem_of(n) for n in loaded]
    if len(parts) == 1:
        return parts[0]
    if source.merge == "concat_samples":
        return joins.concat_samples(loaded, ORIGIN, warnings).drop(ORIGIN)
    if source.merge not in ("by_key", "concat_features"):
        raise SpecError(f"source {source.id} has {len(parts)} inputs and no merge")
    marks = [f"{deferred}_{i}" for i, df in enumerate(parts) if deferred in df.columns]
    parts = [df.withColumnRenamed(deferred, f"{deferred}_{i}") for i, df in enumerate(parts)]
    df = joins.merge_by_key(parts, source.key, names) if source.key else joins.concat_features(parts, names)
    return df.withColumn(deferred, F.coalesce(*[F.col(m) for m in marks])).drop(*marks) if marks else df


def _missing(df: DataFrame, roles: dict[str, list[str]], key: list[str], p: Params, flag: str, warnings: list[str], source: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """The missing-value policy of a source: targets, metadata and ignored columns stay as they are but for removal and abort."""
    subject = [*key, *roles["features"], *roles["weights"]]
    match p.na_policy:
        case "auto" | "abort":
            cells = subject + (roles["targets"] if p.na_policy == "abort" else [])
            if cells:
                df = missing.abort(df, cells, POS) if POS in df.columns else missing.abort_any(df, cells)
        case "remove_sample":
            df = missing.flag_for_removal(df, [*subject, *roles["targets"], *roles["metadata"]], flag)
        case "remove_feature":
            df = missing.remove_feature(df, roles["features"])
            roles = roles | {"features": [c for c in roles["features"] if c in df.columns]}
        case "ignore":
            warnings.append(f"source {source}: missing cells are kept (na_preserved)")
        case "replace":
            if p.fill_method == "value":
                df = missing.fill_value(df, roles["features"], 0.0 if p.fill_value is None else p.fill_value)
            elif p.fill_method in ("forward_fill", "backward_fill"):
                df = missing.fill_across(df, roles["features"], p.fill_method == "backward_fill")
            else:
                df = missing.fill_statistic(df, roles["features"], p.fill_method, bool(p.allow_across_folds))
    return df, roles


@dataclass
class _Table:
    source: Source
    df: DataFrame
    roles: dict[str, list[str]]
    native: dict[str, str]
    codebooks: dict[str, DataFrame]
    flag: str | None
    refused: str | None


def _coded(df: DataFrame, targets: list[str], p: Params, declared_decimal: bool) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Text targets as codes by first appearance, unless they are to be preserved; text that may be decimal numbers with commas is refused."""
    books = {}
    for t in targets:
        if df.schema[t].dataType.typeName() != "string":
            continue
        if not declared_decimal and df.where(F.col(f"`{t}`").isNotNull()).agg(F.coalesce(F.bool_and(F.col(f"`{t}`").rlike(r"^\s*[+-]?\d+,\d+\s*$") | F.col(f"`{t}`").rlike(r"^\s*[+-]?\d+(\.\d+)?\s*$")), F.lit(False))).first()[0]:
            raise DataError(f"the cells of {t} may be numbers with a decimal comma: declare the decimal mark")
        if p.categorical == "preserve":
            continue
        if p.categorical == "none":
            raise DataError(f"{t} is no number, and categories are not to be coded")
        order = POS if POS in df.columns else t
        books[t] = categorical.codebook(df, t, order)
        df = categorical.factorize(df, t, order, "__code").drop(t).withColumnRenamed("__code", t)
    return df, books


def _table(spark: SparkSession, s: Source, spec: DatasetSpec, base: str, frames: dict[str, DataFrame], warnings: list[str], exempt: list[str]) -> _Table:
    p = s.params.over(spec.params).over(DEFAULTS)
    index = spec.sample_index
    keys = list(dict.fromkeys([*s.key, *exempt]))
    stem = STEM in keys or index.derive_from == STEM
    refused = f"__refused_{s.id}"
    df = _load(spark, s, p, base, frames, warnings, refused, stem)
    if index.derive_from in df.columns and index.strip_suffix and index.key:
        df = df.withColumn(index.key[0], text.strip_suffix(F.col(f"`{index.derive_from}`"), index.strip_suffix))
    if absent := [k for k in s.key if k not in df.columns]:
        raise SpecError(f"source {s.id} has no key column {absent[0]!r}")
    hidden = [c for c in (POS, partitions.PARTITION, refused) if c in df.columns]
    columns = selectors.headers(df.drop(*hidden))
    free = tuple(dict.fromkeys([*s.key, *(s.join.right_on if s.join else []), STEM]))
    chosen = s.columns or ([(s.role, "rest")] if s.role != "mixed" else [("metadata", "rest")])
    roles = selectors.split_roles(columns, chosen, free, s.strict_columns, tuple(spec.identity), tuple(keys))
    if POS not in df.columns and (s.key and s.key != [STEM]):
        df = with_position(df, *[k for k in s.key if k != STEM])
    flag = f"__gone_{s.id}" if p.na_policy == "remove_sample" else None
    df, roles = _missing(df, roles, [k for k in s.key if k in df.columns], p, flag, warnings, s.id)
    df = df.drop(*roles["ignore"])
    roles = roles | {"ignore": []}
    books: dict[str, DataFrame] = {}
    if spec.task_type != "regression" or any(df.schema[t].dataType.typeName() == "string" for t in roles["targets"]):
        df, books = _coded(df, roles["targets"], p, (s.params.over(spec.params)).decimal is not None)
    for v in s.variations:
        other = _load(spark, Source(v.name, v.input, merge="concat_samples"), v.params.over(p), base, frames, warnings, f"__refused_{v.name}", False)
        if POS not in other.columns:
            if not s.key:
                raise SpecError(f"variation {v.name}: a frame without a key has no order")
            other = with_position(other, *s.key)
        bad = f"__refused_{v.name}"
        df = variations.with_variation(df, other.drop(*s.key, bad), v.name, roles["features"])
        roles = roles | {f"features:{v.name}": [f"{v.name}__{f}" for f in roles["features"]]}
    return _Table(s, df, roles, {c: c for own in roles.values() for c in own}, books, flag, refused if refused in df.columns else None)


# ---------------------------------------------------------------- all sources


def _joined(spec: DatasetSpec, tables: list[_Table], audits: list[joins.Audit]) -> _Table:
    """All tables beside the first one that has features, in the order of their declaration."""
    primary = next((t for t in tables if t.source.kind == "table" and t.roles["features"]), None)
    if primary is None:
        raise SpecError("no source has features")
    df, roles, native, books = primary.df, {k: list(v) for k, v in primary.roles.items()}, dict(primary.native), dict(primary.codebooks)
    for t in tables:
        if t is primary:
            continue
        s, right, before = t.source, t.df, set(df.columns)
        own, other = (s.join.left_on, s.join.right_on) if s.join else ([], [])
        if not own and (not s.join or s.join.cardinality == "1:1") and s.key and primary.source.key:
            own, other = primary.source.key, s.key
        if own:
            for side, keys, have in (("left", own, df), ("right", other, right)):
                if absent := [k for k in keys if k not in have.columns]:
                    raise SpecError(f"the join of {s.id} names {absent[0]!r}, which its {side} side has not")
            cardinality, coverage = (s.join.cardinality, s.join.coverage) if s.join else ("1:1", "complete")
            df, audit = joins.contract_join(df, right.drop(POS, partitions.PARTITION), own, other, cardinality, coverage, s.id)
            named = {c: c if c not in before else f"{c}__{s.id}" for c in right.columns if c not in other}
        else:
            right = right.drop(partitions.PARTITION)
            named = {c: c if c not in before else f"{s.id}__{c}" for c in right.columns}
            df, audit = joins.row_order_join(df, right, s.id), joins.Audit("join by row order")
        audits.append(audit)
        for role, names in t.roles.items():
            roles.setdefault(role, []).extend([named[c] for c in names if c in named])
        native.update({named[c]: n for c, n in t.native.items() if c in named})
        books.update({named[c]: b for c, b in t.codebooks.items()})
        if own and t.flag:  # a row that a removing source lacks goes too
            df = df.withColumn(t.flag, F.coalesce(F.col(t.flag), F.lit(True)))
    for t in tables:
        if t.flag:
            df = df.where(~F.coalesce(F.col(t.flag), F.lit(True))).drop(t.flag)
    for t in tables:
        if t.refused:
            bad = df.where(F.col(t.refused).isNotNull()).select(t.refused).limit(1).collect()
            if bad:
                raise DataError(f"source {t.source.id}: {bad[0][0]}")
            df = df.drop(t.refused)
    if len(roles["weights"]) > 1:
        raise SpecError("one column of weights at most")
    return _Table(primary.source, df, roles, native, books, None, None)


def _stacked(parts: dict[str, _Table]) -> _Table:
    """The blocks of partitions that have their own sources, one after the other; columns are matched by name, and must be the same ones."""
    tables = list(parts.values())
    first = tables[0]
    frames = []
    for name, t in parts.items():
        for role in ("features", "targets", "weights"):
            if t.roles[role] and first.roles[role] and set(t.roles[role]) != set(first.roles[role]):
                odd = sorted(set(t.roles[role]) ^ set(first.roles[role]))[0]
                raise SpecError(f"partition {name}: {odd} is among the {role} of some partitions only")
        frames.append(t.df.withColumn(partitions.PARTITION, F.lit(name)))
    frames = joins.common_types(frames)
    if all(POS in df.columns for df in frames):
        frames = stacked_positions(frames)
    df = frames[0]
    for other in frames[1:]:
        df = df.unionByName(other, allowMissingColumns=True)
    roles = {k: list(dict.fromkeys(c for t in tables for c in t.roles.get(k, []))) for k in dict.fromkeys(k for t in tables for k in t.roles)}
    return _Table(first.source, df, roles, {k: v for t in tables for k, v in t.native.items()}, {}, None, None)


def _partitioned(spark: SparkSession, df: DataFrame, spec: DatasetSpec, base: str) -> DataFrame:
    p = spec.partitions
    if p and p.by == "column":
        return partitions.by_column(df, p.column, p.lists, p.unknown)
    if p and p.by in ("index", "index_file"):
        if POS not in df.columns:
            raise SpecError("a partition by index needs rows with an order: read them from a file, or name a key")
        lists = p.lists if p.by == "index" else {part: readers.read_positions(spark, files.resolve(own, base, spark)[0]) for part, own in p.lists.items()}
        return partitions.by_index(df, POS, lists)
    return df if partitions.PARTITION in df.columns else df.withColumn(partitions.PARTITION, F.lit("train"))


def _folds(df: DataFrame, own: dict, base: str) -> DataFrame:
    """fold, side, pos, train_pos of the folds that a specification declares: inline, by column or in a file."""
    if POS not in df.columns:
        raise SpecError("folds need rows with an order: read them from a file, or name a key")
    if own.get("column") and own["column"] not in df.columns:
        raise SpecError(f"there is no column {own['column']!r} of folds")
    if own.get("column") and df.where((F.col(partitions.PARTITION) != "train") & F.col(f"`{own['column']}`").isNotNull()).limit(1).count():
        raise SpecError(f"a row outside train has a fold in {own['column']}")
    if own.get("inline"):
        rows = fold_rows.listed(df.sparkSession, own["inline"])
    elif own.get("column"):
        train = df.where(F.col(partitions.PARTITION) == "train")
        if not train.where(F.col(f"`{own['column']}`").isNotNull()).limit(1).count():
            raise SpecError(f"no training row has a fold in {own['column']}")
        rows = partitions.folds_by_column(train, own["column"], POS).withColumnRenamed(POS, "pos")
    elif own.get("file"):
        rows = fold_rows.read_folds(df.sparkSession, files.resolve(own["file"], base, df.sparkSession)[0], own.get("format") or "auto")
    else:
        raise SpecError("folds name neither inline lists nor a column nor a file")
    return fold_rows.translated(df, rows)


def assemble(spark: SparkSession, spec: DatasetSpec | dict, base: str = ".", frames: dict[str, DataFrame] | None = None) -> Dataset:
    """The primary source is the first with features that is no lookup; all others join it in the order of their declaration.

    Sources with a partition of their own are assembled for each partition, with those that have none, and stacked.
    """
    spec = parse(normalized(spec)) if isinstance(spec, dict) else spec
    warnings: list[str] = []
    audits: list[joins.Audit] = []
    on = {}  # columns that joins read on either side
    for s in spec.sources:
        if s.join:
            on.setdefault(s.id, []).extend(s.join.right_on)
            for o in spec.sources:
                if o is not s:
                    on.setdefault(o.id, []).extend(s.join.left_on)
    marker = [spec.partitions.column] if spec.partitions and spec.partitions.column else []
    marker += [spec.folds["column"]] if spec.folds and spec.folds.get("column") else []
    tables = [_table(spark, s, spec, base, frames or {}, warnings, on.get(s.id, []) + marker) for s in spec.sources]
    named = [p for p in partitions.ORDER if any(t.source.partition == p for t in tables)]
    if named:
        whole = _stacked({p: _joined(spec, [t for t in tables if t.source.partition in (p, None)], audits) for p in named})
        if any(t.codebooks for t in tables):
            raise SpecError("text targets of partitions with their own files cannot be coded alike: preserve them, or part one file by a column")
    else:
        whole = _joined(spec, tables, audits)
    df = _partitioned(spark, whole.df, spec, base)
    warnings += [w for a in audits for w in a.warnings]
    return Dataset(df, whole.roles, audits, _folds(df, spec.folds, base) if spec.folds else None, spec, whole.codebooks, warnings, {}, whole.native)
