"""The declarative description of a dataset, and its validation: all problems are reported together."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from typing import Any

from ..errors import SpecError
from . import enums

STEM = "filename_stem"
PARTS = ("train", "test", "val", "predict")


@dataclass
class Join:
    """The other source's rows beside this one's: `to` names the left source; without keys, row by row."""

    to: str | None = None
    left_on: list[str] = field(default_factory=list)
    right_on: list[str] = field(default_factory=list)
    cardinality: str = "1:1"
    coverage: str = "complete"


@dataclass
class Params:
    """How files are read and missing cells treated; what is None is not declared."""

    delimiter: str | None = None
    decimal: str | None = None
    header: bool | None = None
    encoding: str | None = None
    header_unit: str | None = None
    signal_type: str | None = None
    na_policy: str | None = None
    fill_method: str | None = None
    fill_value: Any = None
    allow_across_folds: bool | None = None
    categorical: str | None = None
    precision: str | None = None
    format: dict | None = None

    def over(self, other: Params) -> Params:
        """This, and what it does not declare from the other, field by field."""
        return Params(**{f.name: own if (own := getattr(self, f.name)) is not None else getattr(other, f.name) for f in fields(Params)})


#: Where nothing is declared.
DEFAULTS = Params(";", ".", True, None, None, "auto", "auto", "value", 0.0, False, "auto", None, {})


@dataclass
class SampleIndex:
    by: str = "row"
    key: list[str] = field(default_factory=list)
    observation_id: str | None = None
    repetition_id: str | None = None
    group_id: str | None = None
    derive_from: str | None = None
    strip_suffix: str | None = None

    @property
    def identity(self) -> list[str]:
        return list(dict.fromkeys(n for n in (*self.key, self.observation_id, self.repetition_id, self.group_id) if n and n != STEM))


@dataclass
class Variation:
    name: str
    input: Any
    params: Params = field(default_factory=Params)


@dataclass
class Source:
    id: str
    input: Any
    role: str = "features"
    kind: str = "table"
    modality: str | None = None
    merge: str = "none"
    partition: str | None = None
    key: list[str] = field(default_factory=list)
    columns: list[tuple[str, Any]] = field(default_factory=list)
    strict_columns: bool = True
    join: Join | None = None
    params: Params = field(default_factory=Params)
    variations: list[Variation] = field(default_factory=list)


@dataclass
class Partitions:
    by: str = "files"
    column: str | None = None
    lists: dict[str, Any] = field(default_factory=dict)
    unknown: str = "train"


@dataclass
class Aggregate:
    by: str | None = None
    method: str = "mean"
    exclude_outliers: bool = False
    outlier_threshold: float = 0.95


@dataclass
class DatasetSpec:
    sources: list[Source]
    name: str = ""
    description: str = ""
    task_type: str = "auto"
    signal_type: str = "auto"
    sample_index: SampleIndex = field(default_factory=SampleIndex)
    conventions: list[str] = field(default_factory=list)
    partitions: Partitions | None = None
    folds: dict | None = None
    aggregate: Aggregate | None = None
    repetition: str | None = None
    params: Params = field(default_factory=Params)
    validation: dict = field(default_factory=dict)
    schema_version: int = 1

    @property
    def identity(self) -> list[str]:
        return self.sample_index.identity

    def to_dict(self) -> dict:
        """The description as parse() takes it, without what is not declared."""

        def plain(x):
            if isinstance(x, dict):
                return {k: plain(v) for k, v in x.items() if v not in (None, [], {}, "")}
            return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

        out = plain({f.name: asdict(v) if hasattr(v := getattr(self, f.name), "__dataclass_fields__") else v for f in fields(self) if f.name != "sources"})
        if self.partitions and self.partitions.by != "column":
            out["partitions"].pop("unknown", None)
        out["sources"] = []
        for s in self.sources:
            own = plain({f.name: asdict(v) if hasattr(v := getattr(s, f.name), "__dataclass_fields__") else v for f in fields(s) if f.name not in ("columns", "variations", "input")})
            own["input"] = s.input
            if s.columns:
                own["columns"] = [{"role": r, "select": c} for r, c in s.columns]
            if s.variations:
                own["variations"] = [plain({"name": v.name, "input": v.input, "params": asdict(v.params)}) for v in s.variations]
            out["sources"].append(own)
        return out


#: Other names of a parameter (fixed values).
PARAM_NAMES = {"decimal_separator": "decimal", "has_header": "header", "categorical_mode": "categorical", "na": "na_policy"}


def _list(x) -> list:
    return [x] if isinstance(x, (str, int)) else list(x or [])


class _Reader:
    """Reads parts of a description and gathers what is wrong with them."""

    def __init__(self):
        self.problems: list[str] = []

    def term(self, kind: str, value, where: str):
        try:
            return enums.read(kind, value)
        except SpecError as e:
            self.problems.append(f"{where}: {e}")
            return value

    def known(self, value: dict, names, where: str) -> dict:
        if not isinstance(value, dict):
            self.problems.append(f"{where}: {value!r} is no object")
            return {}
        self.problems += [f"{where}: unknown key {k!r}" for k in value if k not in names]
        return {k: v for k, v in value.items() if k in names}

    def params(self, value, where: str) -> Params:
        if isinstance(value, Params):
            return value
        own = {PARAM_NAMES.get(k, k): v for k, v in (value or {}).items()}
        if isinstance(own.get("na_policy"), dict):
            na = own.pop("na_policy")
            fill = na.get("fill") if isinstance(na.get("fill"), dict) else {"method": na.get("fill_method"), "value": na.get("fill_value")}
            self.known(na, ("policy", "fill", "fill_method", "fill_value", "fill_per_column", "allow_across_folds"), f"{where} na")
            own |= {"na_policy": na.get("policy"), "fill_method": fill.get("method"), "fill_value": fill.get("value"), "allow_across_folds": na.get("allow_across_folds")}
        p = Params(**self.known(own, [f.name for f in fields(Params)], where))
        for name, kind in (("na_policy", "na_policy"), ("fill_method", "fill_method"), ("categorical", "categorical"), ("header_unit", "header_unit"), ("signal_type", "signal_type")):
            if getattr(p, name) is not None:
                setattr(p, name, self.term(kind, getattr(p, name), where))
        for name in ("delimiter", "decimal"):
            if getattr(p, name) is not None and len(str(getattr(p, name))) != 1:
                self.problems.append(f"{where}: {name} is one character")
        return p

    def columns(self, value, where: str) -> list[tuple[str, Any]]:
        """Roles and selectors, from an object or a list of {role, select}."""
        out = []
        for one in value.items() if isinstance(value, dict) else value or []:
            if isinstance(one, dict):
                own = self.known(one, ("role", "select", "candidates"), f"{where} columns")
                if "role" not in own or "select" not in own:
                    self.problems.append(f"{where}: a column needs role and select")
                    continue
                one = (own["role"], own["select"])
                if own["select"] == "auto":
                    one = (own["role"], {"auto": own.get("candidates") or []})
            role, select = one
            role = self.term("role", role, where)
            out.append((role, {"auto": []} if select == "auto" else select))
        return out

    def join(self, value, where: str) -> Join:
        if isinstance(value, Join):
            return value
        own = self.known(value, ("to", "left", "right", "on", "left_on", "right_on", "how", "cardinality", "coverage"), f"{where} join")
        if own.get("how") and own.get("cardinality") and own["how"] != own["cardinality"]:
            self.problems.append(f"{where}: how and cardinality differ")
        both = _list(own.get("on"))
        if both and (own.get("left_on") or own.get("right_on")):
            self.problems.append(f"{where}: either on, or left_on and right_on")
        out = Join(own.get("to") or own.get("left"), _list(own.get("left_on")) or both, _list(own.get("right_on")) or both, self.term("cardinality", own.get("how") or own.get("cardinality") or "1:1", where), self.term("coverage", own.get("coverage") or "complete", where))
        if len(out.left_on) != len(out.right_on):
            self.problems.append(f"{where}: as many keys are needed on both sides")
        if out.cardinality != "1:1" and not out.left_on:
            self.problems.append(f"{where}: a join {out.cardinality} needs keys")
        return out

    def source(self, value: dict, nth: int) -> Source:
        where = f"source {value.get('id', nth) if isinstance(value, dict) else nth}"
        own = self.known(value, [f.name for f in fields(Source)], where)
        kind = self.term("kind", own.get("kind", "table"), where)
        columns = self.columns(own.get("columns"), where)
        role = self.term("role", own.get("role") or ("mixed" if columns or kind == "lookup" else "features"), where)
        if "input" not in own or own["input"] is None:
            self.problems.append(f"{where}: no input")
        if role == "mixed" and not columns and kind == "table":
            self.problems.append(f"{where}: neither a role nor columns")
        if columns and role != "mixed" and {r for r, _ in columns} - {role, "ignore"}:
            self.problems.append(f"{where}: is all {role} and has columns of other roles")
        if sum(c == "rest" or isinstance(c, dict) and "rest" in c for _, c in columns) > 1:
            self.problems.append(f"{where}: only one selector can take the rest")
        merge = self.term("merge", own.get("merge", "none"), where)
        if isinstance(own.get("input"), list) and len(own["input"]) > 1 and merge == "none":
            self.problems.append(f"{where}: several inputs need a merge")
        if merge == "by_key" and not own.get("key"):
            self.problems.append(f"{where}: merging by key needs a key")
        given = own.get("variations") or []
        variations = []
        for v in [{"name": k, "input": x} for k, x in given.items()] if isinstance(given, dict) else given:
            part = self.known(v, ("name", "input", "params"), f"{where} variations")
            if not part.get("name") or part.get("input") is None:
                self.problems.append(f"{where}: a variation needs name and input")
                continue
            variations.append(Variation(part["name"], part["input"], self.params(part.get("params"), f"{where} variation {part['name']}")))
        if len({v.name for v in variations}) != len(variations):
            self.problems.append(f"{where}: two variations have the same name")
        partition = self.term("partition", own["partition"], where) if own.get("partition") else None
        return Source(str(own.get("id", f"s{nth}")), own.get("input"), role, kind, self.term("modality", own["modality"], where) if own.get("modality") else None, merge, None if partition == "auto" else partition, _list(own.get("key")), columns, bool(own.get("strict_columns", True)), self.join(own["join"], where) if own.get("join") else None, self.params(own.get("params"), where), variations)

    def partitions(self, value: dict) -> Partitions:
        names = {"column": [f"{p}_values" for p in PARTS] + ["column", "unknown_policy", "unknown"], "index": list(PARTS), "index_file": [f"{p}_file" for p in PARTS], "files": []}
        own = self.known(value, ["by", "lists", *dict.fromkeys(n for x in names.values() for n in x)], "partitions")
        by = self.term("partition_by", own.get("by") or ("column" if own.get("column") else "index_file" if any(f"{p}_file" in own for p in PARTS) else "index" if any(p in own for p in PARTS) else "files"), "partitions")
        if by in names:
            self.problems += [f"partitions: {k!r} has no meaning by {by}" for k in own if k not in ("by", "lists", *names[by])]
        end = {"column": "_values", "index_file": "_file"}.get(by, "")
        lists = dict(own.get("lists") or {}) | {p: own[p + end] for p in PARTS if own.get(p + end) is not None}
        if by == "column":
            lists = {p: _list(v) if not isinstance(v, (bool, float)) else [v] for p, v in lists.items()}
            if not own.get("column"):
                self.problems.append("partitions: by column needs a column")
            seen: dict[str, str] = {}
            for p, values in lists.items():
                self.problems += [f"partitions: {v!r} is in {seen[str(v).lower()]} and in {p}" for v in values if seen.setdefault(str(v).lower(), p) != p]
        elif by in ("index", "index_file") and not lists:
            self.problems.append(f"partitions: by {by} needs a list")
        self.problems += [f"partitions: no partition is called {p}" for p in lists if p not in PARTS]
        unknown = own.get("unknown_policy") or own.get("unknown") or "train"
        return Partitions(by, own.get("column"), lists, self.term("unknown", unknown, "partitions"))

    def sample_index(self, value) -> SampleIndex:
        own = self.known(value or {}, ("by", "key", "observation_id", "repetition_id", "group_id", "derive"), "sample_index")
        derive = self.known(own.get("derive") or {}, ("from", "strip_suffix"), "derive")
        out = SampleIndex(self.term("sample_index", own.get("by", "row"), "sample_index"), _list(own.get("key")), own.get("observation_id"), own.get("repetition_id"), own.get("group_id"), derive.get("from"), derive.get("strip_suffix"))
        if out.by == "id" and not out.key:
            self.problems.append("sample_index: by id needs a key")
        return out

    def folds(self, value) -> dict | None:
        if value is None:
            return None
        if isinstance(value, str):
            value = {"file": value}
        if isinstance(value, list):
            value = {"inline": value}
        own = self.known(value, ("inline", "file", "format", "column"), "folds")
        if sum(bool(own.get(k)) for k in ("inline", "file", "column")) != 1:
            self.problems.append("folds: one of inline, file and column is needed")
        if own.get("format"):
            own["format"] = self.term("fold_format", own["format"], "folds")
        return own


def parse(spec: dict) -> DatasetSpec:
    """A DatasetSpec from its dict form; every problem found goes into one error."""
    read = _Reader()
    top = read.known(spec, [*(f.name for f in fields(DatasetSpec)), "identity"], "spec")
    sources = [read.source(s, i) for i, s in enumerate(top.get("sources") or [])]
    ids = [s.id for s in sources]
    if not sources:
        read.problems.append("there is no source")
    read.problems += [f"two sources have the id {i}" for i in dict.fromkeys(ids) if ids.count(i) > 1]
    if sources and not any(s.kind == "table" and s.role in ("features", "mixed") for s in sources):
        read.problems.append("no source has features")
    for s in sources:
        if s.join and s.join.to is not None and s.join.to not in ids:
            read.problems.append(f"source {s.id}: joins {s.join.to!r}, which is no source")
        if s.join and s.join.to == s.id:
            read.problems.append(f"source {s.id}: joins itself")
        if s.kind == "lookup" and not s.join:
            read.problems.append(f"source {s.id}: a lookup that is never joined")
    if top.get("schema_version", 1) != 1:
        read.problems.append(f"schema version {top['schema_version']} is unknown")
    index = top.get("sample_index")
    index = index if isinstance(index, SampleIndex) else read.sample_index(index)
    if top.get("identity"):  # identity columns that need no meaning of their own
        index.key = list(dict.fromkeys([*index.key, *_list(top["identity"])]))
    agg = read.known(top["aggregate"] if isinstance(top.get("aggregate"), dict) else {"by": top.get("aggregate")}, ("by", "method", "exclude_outliers", "outlier_threshold"), "aggregate") if top.get("aggregate") else None
    if agg and agg.get("method"):
        agg["method"] = read.term("aggregate", agg["method"], "aggregate")
    out = DatasetSpec(
        sources, top.get("name") or "", top.get("description") or "", read.term("task_type", top.get("task_type") or "auto", "spec"), read.term("signal_type", top.get("signal_type") or "auto", "spec"), index, _list(top.get("conventions")),
        read.partitions(top["partitions"]) if top.get("partitions") else None, read.folds(top.get("folds")), Aggregate(**agg) if agg else None, top.get("repetition"), read.params(top.get("params"), "params"),
        read.known(top.get("validation") or {}, ("check_file_existence", "allow_train_only", "allow_test_only"), "validation"),
    )
    if read.problems:
        raise SpecError("; ".join(read.problems))
    return out
