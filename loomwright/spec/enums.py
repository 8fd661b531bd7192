"""Closed vocabularies of a specification (fixed values), read without regard to case, spaces around, - or _."""

from __future__ import annotations

from ..errors import SpecError

VOCABULARY = {
    "role": ("features", "targets", "metadata", "weights", "ignore", "mixed"),
    "kind": ("table", "lookup"),
    "modality": ("spectroscopy", "markers", "metadata", "image"),
    "partition": ("train", "test", "val", "predict", "auto"),
    "task_type": ("auto", "regression", "binary", "multiclass"),
    "sample_index": ("row", "id"),
    "merge": ("concat_samples", "concat_features", "by_key", "none"),
    "cardinality": ("1:1", "m:1", "1:m"),
    "coverage": ("complete", "warn", "drop", "error"),
    "header_unit": ("nm", "cm-1", "none", "text", "index"),
    "signal_type": ("auto", "absorbance", "reflectance", "reflectance%", "transmittance", "transmittance%", "log(1/r)", "kubelka-munk"),
    "na_policy": ("auto", "abort", "remove_sample", "remove_feature", "replace", "ignore"),
    "fill_method": ("value", "mean", "median", "forward_fill", "backward_fill"),
    "categorical": ("auto", "preserve", "none"),
    "partition_by": ("files", "column", "index", "index_file"),
    "unknown": ("train", "test", "drop", "error"),
    "fold_format": ("auto", "csv", "json", "yaml", "txt"),
    "aggregate": ("mean", "median", "vote", "robust_mean"),
}
ALIASES = {
    "role": {"x": "features", "y": "targets", "meta": "metadata", "m": "metadata", "weight": "weights"},
    "partition": {"cal": "train", "calibration": "train", "validation": "val", "holdout": "test", "inference": "predict"},
    "header_unit": {"wavenumber": "cm-1", "cm1": "cm-1", "cm_1": "cm-1", "nanometer": "nm", "nanometers": "nm"},
}


def read(kind: str, value: str) -> str:
    plain = lambda s: s.strip().lower().replace("-", "_")
    known = {plain(v): v for v in VOCABULARY[kind]} | {plain(k): v for k, v in ALIASES.get(kind, {}).items()}
    if not isinstance(value, str) or plain(value) not in known:
        raise SpecError(f"{value!r} is no {kind}; known are {', '.join(VOCABULARY[kind])}")
    return known[plain(value)]
