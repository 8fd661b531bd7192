"""A JSON Schema of descriptions, made from the model's own fields and vocabularies."""

from __future__ import annotations

from dataclasses import fields

from . import enums
from .model import PARAM_NAMES, PARTS, DatasetSpec, Params, Source

_ANY, _TEXT, _TEXTS = {}, {"type": "string"}, {"anyOf": [{"type": "string"}, {"type": "array", "items": {"type": "string"}}]}


def _term(kind: str) -> dict:
    """A word of a vocabulary or one of its aliases."""
    return {"type": "string", "enum": [*enums.VOCABULARY[kind], *enums.ALIASES.get(kind, {})]}


def _object(properties: dict, required: list[str] | None = None) -> dict:
    return {"type": "object", "properties": properties, "additionalProperties": False} | ({"required": required} if required else {})


def json_schema() -> dict:
    terms = {f.name: _term(f.name) for f in fields(Params) if f.name in enums.VOCABULARY}
    params = {f.name: _ANY for f in fields(Params)} | terms | {"delimiter": {"type": "string", "minLength": 1, "maxLength": 1}, "decimal": {"type": "string", "minLength": 1, "maxLength": 1}, "header": {"type": "boolean"}}
    params |= {k: params[v] for k, v in PARAM_NAMES.items()}
    params["na"] = {"anyOf": [params["na_policy"], _object({"policy": params["na_policy"], "fill": _object({"method": _term("fill_method"), "value": _ANY}), "fill_method": _term("fill_method"), "fill_value": _ANY, "fill_per_column": {"type": "boolean"}, "allow_across_folds": {"type": "boolean"}})]}
    params = _object(params)
    join = _object({"to": _TEXT, "left": _TEXT, "right": _TEXT, "on": _TEXTS, "left_on": _TEXTS, "right_on": _TEXTS, "how": _term("cardinality"), "cardinality": _term("cardinality"), "coverage": _term("coverage")})
    columns = {"anyOf": [{"type": "array", "items": _object({"role": _term("role"), "select": _ANY, "candidates": {"type": "array"}}, ["role", "select"])}, {"type": "object"}]}
    variation = _object({"name": _TEXT, "input": _ANY, "params": params}, ["name", "input"])
    source = {f.name: _ANY for f in fields(Source)} | {"id": _TEXT, "role": _term("role"), "kind": _term("kind"), "modality": _term("modality"), "merge": _term("merge"), "partition": _term("partition"), "key": _TEXTS, "columns": columns, "strict_columns": {"type": "boolean"}, "join": join, "params": params, "variations": {"anyOf": [{"type": "array", "items": variation}, {"type": "object"}]}}
    parts = _object({"by": _term("partition_by"), "column": _TEXT, "unknown_policy": _term("unknown"), "unknown": _term("unknown"), "lists": {"type": "object"}} | {p: {"type": "array", "items": {"type": "integer"}} for p in PARTS} | {f"{p}_values": _ANY for p in PARTS} | {f"{p}_file": _TEXT for p in PARTS})
    folds = {"anyOf": [_TEXT, {"type": "array"}, _object({"inline": {"type": "array"}, "file": _TEXT, "format": _term("fold_format"), "column": _TEXT})]}
    index = _object({"by": _term("sample_index"), "key": _TEXTS, "observation_id": _TEXT, "repetition_id": _TEXT, "group_id": _TEXT, "derive": _object({"from": _TEXT, "strip_suffix": _TEXT})})
    aggregate = {"anyOf": [_TEXT, _object({"by": _TEXT, "method": _term("aggregate"), "exclude_outliers": {"type": "boolean"}, "outlier_threshold": {"type": "number"}})]}
    top = {f.name: _ANY for f in fields(DatasetSpec)} | {"schema_version": {"const": 1}, "name": _TEXT, "description": _TEXT, "task_type": _term("task_type"), "signal_type": _term("signal_type"), "sample_index": index, "sources": {"type": "array", "minItems": 1, "items": _object(source, ["input"])}, "partitions": parts, "folds": folds, "aggregate": aggregate, "params": params}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "DatasetSpec"} | _object(top, ["sources"])
