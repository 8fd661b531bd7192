"""From inputs to a plan: what they seem to be, each guess with a score and its evidence, and the description they make."""

from __future__ import annotations

import copy
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AssemblyError, SpecError
from ..operators import statistics
from ..operators.position import POS
from ..sources import files, readers
from ..spec.model import DatasetSpec, parse
from ..spec.normalize import normalized
from . import conventions, detectors, identity
from .describe import Description, describe, is_number

DEFAULT_PROFILES = ("classic", "train-test", "bare", "vendor-corpus")


@dataclass
class Decision:
    value: Any
    score: float = 0.0
    evidence: list[str] = field(default_factory=list)
    alternatives: list[dict] = field(default_factory=list)
    ambiguous: bool = False


@dataclass
class Plan:
    """What was guessed about an input; accept() gives the description, which load() takes."""

    spark: SparkSession
    base: str = "."
    structure: Decision | None = None
    signal_type: Decision | None = None
    task_type: Decision | None = None
    identity: Decision | None = None
    assignments: list[dict] = field(default_factory=list)
    columns: list[dict] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    axis: dict | None = None
    alignment: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    spec: dict = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def score(self) -> float:
        made = [d.score for d in (self.structure, self.signal_type, self.task_type) if d]
        return round(sum(made) / len(made), 3) if made else 0.0

    def accept(self, **changes) -> DatasetSpec:
        """The description, with top-level keys changed."""
        if not self.spec.get("sources"):
            raise SpecError("nothing could be guessed: describe the dataset")
        return parse(normalized(copy.copy(self.spec) | changes))

    def to_dict(self) -> dict:
        plain = {k: asdict(v) if isinstance(v := getattr(self, k), Decision) else v for k in ("structure", "signal_type", "task_type", "identity", "assignments", "columns", "params", "axis", "alignment", "warnings")}
        return plain | {"spec": self.spec, "score": self.score}


def column_roles(names: list[str], numeric: set[str], wavelengths: set[str]) -> list[dict]:
    """Role of each column: wavelengths are features, text is metadata; beside wavelengths up to three numbers are targets, without them the last number is."""
    others = [n for n in names if n in numeric and n not in wavelengths]
    out = []
    for n in names:
        if n in wavelengths:
            role, score, why = "features", 0.9, "a header of the wavelength axis"
        elif n not in numeric:
            role, score, why = "metadata", 0.7, "cells that are no numbers"
        elif not wavelengths and len(others) > 1 and n == others[-1]:
            role, score, why = "targets", 0.6, "the last column of numbers"
        elif wavelengths and len(others) <= 3:
            role, score, why = "targets", 0.65, "numbers beside a spectrum"
        else:
            role, score, why = "features", 0.55, "a column of numbers"
        out.append({"col": n, "role": role, "score": score, "evidence": [why]})
    return out


def structure_of(found: conventions.Match, n_files: int) -> Decision:
    if found.spectra:
        return Decision("vendor_corpus", 0.9, [f"{len(found.spectra)} files of one spectrum each, {len(found.reference)} reference files"])
    if found.assignments:
        why = [f"{len(found.assignments)} files are named by role"]
        if len({a.partition for a in found.assignments}) > 1:
            return Decision("train_test_folder", 0.92, why)
        if {"features", "targets"} <= {a.role for a in found.assignments}:
            return Decision("x_y_separate", 0.85, why)
        return Decision("single_partition_folder", 0.8, why)
    if n_files == 1:
        return Decision("single_combined", 0.7, ["one table; its columns are told apart"])
    return Decision("unknown", 0.2, [f"{n_files} files, none named by role"])


def _read(spark: SparkSession, item: files.Item, params: dict) -> DataFrame:
    if item.kind == "frame":
        return item.value
    if item.kind == "rows":
        return readers.from_rows(spark, item.value)
    options = {"delimiter": params.get("delimiter", ";"), "decimal": params.get("decimal_separator", params.get("decimal", ".")), "header": params.get("has_header", params.get("header", True))}
    return readers.read(spark, item.path, **options)


def _numbers(df: DataFrame) -> set[str]:
    return {n for n, k in df.dtypes if n != POS and k in ("double", "float", "bigint", "int", "smallint", "tinyint")}


def _signal(df: DataFrame, features: list[str], unit: str | None) -> Decision:
    array = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("x"))
    r = statistics.block_stats(array, "x").first()
    if r["mean"] is None:
        return Decision("unknown", 0.0, ["no cell"])
    hints = None
    if all(is_number(c) for c in features):
        axis = [float(c) for c in features]
        axis = [1e7 / x for x in axis] if unit == "cm-1" else axis
        if any(min(axis) <= b <= max(axis) for b in detectors.WATER):
            means = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(features)]).first()
            hints = detectors.water_hints([m or 0.0 for m in means], axis)
    value, score = detectors.signal_type(r["low"], r["high"], r["mean"], r["std"], hints)
    return Decision(value, score, [f"range {r['low']:.4g} to {r['high']:.4g}, mean {r['mean']:.4g}, deviation {r['std']:.4g}"])


def _task(df: DataFrame, target: str) -> Decision:
    if target not in _numbers(df):
        n = df.select(f"`{target}`").where(F.col(f"`{target}`").isNotNull()).distinct().limit(3).count()
        return Decision("binary" if n == 2 else "multiclass", 0.9, [f"{target} is text"])
    r = statistics.task_type_stats(df.withColumnRenamed(target, "__t"), "__t").first()
    value, score = detectors.task_type(bool(r["integral"]), r["n_distinct"], r["low"] or 0.0, r["high"] or 0.0, r["n"])
    return Decision(value, score, [f"{target}: {r['n_distinct']} values among {r['n']}"])


def infer(spark: SparkSession, what, base: str = ".", profiles: tuple = DEFAULT_PROFILES, params: dict | None = None, file_params: dict[str, dict] | None = None) -> Plan:
    """A plan for a folder, a file, a pattern, a list of files, or frames. params hold for all files, file_params for named ones; what they declare is not guessed."""
    items = files.items(spark, what, base)
    plan, tables = Plan(spark, base), [i for i in items if i.kind == "file"]
    by_name = {i.name: i for i in items}
    if len(by_name) != len(items):
        raise SpecError("two inputs have the same name: give them one by one")
    found = conventions.match([i.name for i in tables], list(profiles))
    plan.structure = structure_of(found, len(items))
    plan.warnings += found.warnings
    if found.unmatched and plan.structure.value != "single_combined":
        plan.warnings.append(f"files that nothing was made of: {', '.join(found.unmatched)}")
    plan.assignments = [{"ref": a.name, "role": a.role, "partition": a.partition, "score": a.score, "evidence": [f"the name has {a.pattern}"]} for a in found.assignments]

    declared = lambda name: (params or {}) | (file_params or {}).get(name, {})
    seen: dict[str, Description] = {}
    for i in tables:
        if readers.extension(i.path) in readers.TEXT and i.name not in found.spectra:
            own = declared(i.name)
            d = seen[i.name] = describe(spark, i.path, own.get("delimiter"), own.get("decimal_separator") or own.get("decimal"))
            chosen = {}
            if d.delimiter_candidates:
                plan.warnings.append(f"{i.name}: the delimiter may be any of {d.delimiter_candidates}; name it")
            else:
                chosen["delimiter"] = d.delimiter
                if d.decimal == ",":
                    chosen["decimal_separator"] = ","
            if not d.has_header and "has_header" not in own and "header" not in own:
                plan.warnings.append(f"{i.name}: the first record may be data and no header; it is read as a header unless has_header is false")
            plan.params[i.name] = chosen | own
    loaded: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in loaded:
            loaded[name] = _read(spark, by_name[name], plan.params.get(name, declared(name)))
        return loaded[name]

    if found.spectra or found.assignments:
        key = None
        if found.reference:
            guess = identity.sample_id(table(found.reference[0]))
            key = guess[0] if guess else [c for c in table(found.reference[0]).columns if c != POS][0]
        plan.spec = conventions.to_spec(found, reference_key=key)
    elif len(items) == 1:
        _single(plan, items[0], seen, table)
    else:
        plan.warnings.append("no convention fits: describe the dataset, or name a profile")
    _complete(plan, by_name, seen, table)
    return plan


def _single(plan: Plan, item: files.Item, seen: dict[str, Description], table) -> None:
    df = table(item.name)
    names, d = [c for c in df.columns if c != POS], seen.get(item.name)
    numeric = _numbers(df)
    spectral = [n for n in names if is_number(n) and n in numeric]
    found = d.wavelengths if d else detectors.wavelength_header(spectral)
    plan.columns = column_roles(names, numeric, set(spectral) if found else set())
    roles = {r: [c["col"] for c in plan.columns if c["role"] == r] for r in ("features", "targets", "metadata")}
    if found:
        plan.axis = {"unit": found[0], "score": found[1], "range": [float(spectral[0]), float(spectral[-1])]}
    columns = [{"role": r, "select": c} for r, c in roles.items() if c]
    plan.spec = {"name": "dataset", "sources": [{"id": "data", "role": "mixed", "input": item.name, "columns": columns}]}


def _complete(plan: Plan, by_name: dict[str, files.Item], seen: dict[str, Description], table) -> None:
    """Parameters, keys, signal and task of the sources, and inputs that are found from anywhere."""
    sources = plan.spec.get("sources", [])
    features = targets = None
    for part in dict.fromkeys(s.get("partition") for s in sources):
        own = [s for s in sources if s.get("partition") == part and isinstance(s["input"], str)]
        anchor = next((s for s in own if s.get("role") in ("features", "mixed")), None)
        others = {s["id"]: s for s in own if s is not anchor and s.get("join", {}).get("how") == "1:1"}
        if anchor is None:
            continue
        try:
            keys = identity.generated_keys(table(anchor["input"]), {i: table(s["input"]) for i, s in others.items()})
        except AssemblyError as e:
            plan.warnings.append(str(e))
            continue
        for i, k in keys.items():
            others[i]["join"] = {"to": anchor["id"], "on": k["on"], "how": k["how"]}
            a = identity.audit(table(anchor["input"]), table(others[i]["input"]), k["on"], k["on"])
            plan.alignment.append({"source": i, "partition": part} | k | {n: a[n] for n in ("n_left", "n_right", "n_missing", "n_extra")})
        if keys:
            on = next(iter(keys.values()))["on"]
            plan.identity = Decision(on, next(iter(keys.values()))["score"], ["its name, and that its values are unique"])
            plan.spec["sample_index"] = {"by": "id", "key": on}
            for s in [anchor, *(others[i] for i in keys)]:
                if s.get("role") != "mixed":
                    s["columns"] = [{"role": "metadata", "select": [on]}, {"role": s["role"], "select": "rest"}]
                    s["role"] = "mixed"
        if features is None:
            features = anchor
            targets = next((s for s in own if s.get("role") == "targets" or any(c["role"] == "targets" for c in s.get("columns", []))), None)
    for s in sources:
        if isinstance(s["input"], str) and plan.params.get(s["input"]):
            s["params"] = dict(plan.params[s["input"]])
    if features is not None:
        df = table(features["input"])
        key = plan.spec.get("sample_index", {}).get("key")
        chosen = [c for x in features.get("columns", []) if x["role"] == "features" and x["select"] != "rest" for c in x["select"]] or [n for n in df.columns if n in _numbers(df) and n != key]
        if chosen:
            d = seen.get(features["input"])
            unit = d.wavelengths[0] if d and d.wavelengths else None
            if plan.axis is None and unit:
                plan.axis = {"unit": unit, "score": d.wavelengths[1]}
            plan.signal_type = _signal(df, chosen, unit)
    if targets is not None:
        df = table(targets["input"])
        key = plan.spec.get("sample_index", {}).get("key")
        chosen = [c for x in targets.get("columns", []) if x["role"] == "targets" and x["select"] != "rest" for c in x["select"]] or [c for c in df.columns if c not in (POS, key)]
        if chosen:
            plan.task_type = _task(df, chosen[0])
            if plan.task_type.score >= 0.6:
                plan.spec["task_type"] = plan.task_type.value
    for s in sources:
        given = s["input"] if isinstance(s["input"], list) else [s["input"]]
        there = [by_name[g].path or by_name[g].value for g in given]
        s["input"] = there if isinstance(s["input"], list) else there[0]
    if isinstance(plan.spec.get("folds"), dict) and plan.spec["folds"].get("file") in by_name:
        plan.spec["folds"]["file"] = by_name[plan.spec["folds"]["file"]].path
