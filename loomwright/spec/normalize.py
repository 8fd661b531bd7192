"""Other spellings of a description: aliases of its keys, and the flat form in which files are named by partition and role."""

from __future__ import annotations

from itertools import product

from ..errors import SpecError

# Words for partitions and roles, in any case, in either order, with or without what parts them.
PARTITION_WORDS = {"train": ("train", "trn", "cal", "calibration", "fit"), "test": ("test", "tst", "val", "validation", "eval", "holdout", "predict", "inference")}
ROLE_WORDS = {
    "x": ("x", "feature", "features", "spectrum", "spectra", "signal", "signals"),
    "y": ("y", "target", "targets", "label", "labels", "response", "responses"),
    "group": ("group", "groups", "meta", "metadata", "m", "samplemeta", "samplemetadata"),
}
PARAM_WORDS = ("params", "param", "config", "configs", "settings", "options")
FILTER_WORDS = ("filter", "filters", "columns", "cols", "indices", "idx", "select", "selection")
# Other names of top-level keys.
TOP_WORDS = {
    "name": ("dataset_name", "data_name"),
    "description": ("desc", "dataset_description", "data_description"),
    "task_type": ("task", "problem_type", "ml_task", "target_type"),
    "folder": ("dir", "directory", "data_folder", "data_dir", "folder_path", "path"),
    "params": ("global_params", "global", "global_config", "global_settings", "global_options", "loading_params", "loader_params", "read_params", "io_params", "global_loading_params", "global_loading_options", "shared_params"),
    "aggregate": ("aggregation", "aggregate_by", "aggregation_by", "group_by", "aggregate_column", "aggregation_column"),
    "aggregate_method": ("aggregation_method", "aggregate_mode", "aggregation_mode", "aggregate_strategy", "aggregation_strategy"),
    "aggregate_exclude_outliers": ("exclude_outliers", "remove_outliers", "drop_outliers", "exclude_outliers_before_aggregation", "remove_outliers_before_aggregation", "aggregation_exclude_outliers"),
    "repetition": ("repetitions", "repeat", "repeat_by", "repetition_column", "repeat_column", "sample_id_column", "group_column"),
    "folds": ("fold", "cv", "cv_folds", "cross_validation", "cross_validation_folds", "splits", "cv_splits"),
    "sources": ("source_list", "sensor_sources", "input_sources", "feature_sources", "modalities"),
}
#: Parameters that may stand at the top (fixed values).
ROOT_PARAMS = ("delimiter", "decimal_separator", "decimal", "has_header", "header", "header_unit", "na", "na_policy", "categorical", "categorical_mode", "encoding")


def squeezed(key) -> str:
    """Letters and digits of a key, in lower case."""
    return "".join(c for c in str(key).lower() if c.isalnum())


def aliases() -> dict[str, str]:
    """Canonical key of each squeezed spelling; the first meaning counts."""
    out = {squeezed(w): k for k, words in TOP_WORDS.items() for w in (k, *words)}
    flat = {}
    for part, role in product(PARTITION_WORDS, ROLE_WORDS):
        flat[f"{part}_{role}"] = [a + b for p, r in product(PARTITION_WORDS[part], ROLE_WORDS[role]) for a, b in ((p, r), (r, p))]
    for key, spellings in flat.items():
        for s in (squeezed(key), *spellings):
            out.setdefault(s, key)
    for part, words in PARTITION_WORDS.items():
        for p, w in product(words, PARAM_WORDS[:2] + ("config", "settings", "options")):
            out.setdefault(p + w, f"{part}_params")
            out.setdefault(w + p, f"{part}_params")
    for suffix, words in (("params", PARAM_WORDS), ("filter", FILTER_WORDS)):
        for key, spellings in flat.items():
            for s, w in product((squeezed(key), *spellings), words):
                out.setdefault(s + w, f"{key}_{suffix}")
                out.setdefault(w + s, f"{key}_{suffix}")
    return out


_ALIASES = aliases()


def canonical(config: dict) -> dict:
    """The config with canonical keys; a key that is canonical already wins over its aliases."""
    out = {k: v for k, v in config.items() if _ALIASES.get(squeezed(k), k) == k}
    for k, v in config.items():
        if k not in out:
            out.setdefault(_ALIASES[squeezed(k)], v)
    return out


def _flat_source(config: dict, part: str, role: str, given, nth: int, several: bool, anchor: str | None) -> dict:
    name = {"x": "x", "y": "y", "group": "m"}[role]
    whole = {"x": "features", "y": "targets", "group": "metadata"}[role]
    out = {"id": f"{part}_{name}" + (f"_{nth}" if several else ""), "role": whole, "input": given, "partition": part}
    chosen = config.get(f"{part}_{role}_filter")
    targets = config.get(f"{part}_y_filter") if role == "x" and config.get(f"{part}_y") is None else None
    if targets is not None:  # the targets are columns of the features' file
        columns = [{"role": "targets", "select": targets}, {"role": "features", "select": "rest" if chosen is None else chosen}]
        out |= {"role": "mixed", "strict_columns": False, "columns": columns + ([] if chosen is None else [{"role": "ignore", "select": "rest"}])}
    elif chosen is not None:
        out |= {"role": "mixed", "columns": [{"role": whole, "select": chosen}, {"role": "ignore", "select": "rest"}]}
    if params := (config.get(f"{part}_params") or {}) | (config.get(f"{part}_{role}_params") or {}):
        out["params"] = params
    if role != "x" and anchor:
        out["join"] = {"to": anchor, "how": "1:1"}
    return out


def from_flat(config: dict) -> dict:
    """The description that a flat config of files by partition and role stands for."""
    used = {"name", "description", "task_type", "signal_type", "params", "aggregate", "aggregate_method", "aggregate_exclude_outliers", "repetition", "folds", *ROOT_PARAMS}
    sources = []
    for part in PARTITION_WORDS:
        anchor = None
        for role in ROLE_WORDS:
            given = config.get(f"{part}_{role}")
            used |= {f"{part}_{role}{s}" for s in ("", "_params", "_filter")} | {f"{part}_params"}
            if given is None:
                continue
            several = role == "x" and isinstance(given, (list, tuple)) and len(given) > 1
            given = list(given) if role == "x" and isinstance(given, (list, tuple)) else [given]
            for nth, own in enumerate(given):
                sources.append(_flat_source(config, part, role, own, nth, several, anchor))
                anchor = anchor or (sources[-1]["id"] if role == "x" else None)
    if unknown := [k for k in config if k not in used]:
        raise SpecError(f"unknown key {unknown[0]!r}")
    out = {k: config[k] for k in ("name", "description", "task_type", "signal_type", "folds", "repetition") if config.get(k) is not None}
    params = {k: config[k] for k in ROOT_PARAMS if k in config} | (config.get("params") or {})
    if params:
        out["params"] = params
    if config.get("repetition") is not None:
        out["sample_index"] = {"repetition_id": config["repetition"]}
    if config.get("aggregate") is not None:
        own = config["aggregate"]
        by = own if isinstance(own, str) else config.get("repetition") if own is True else None
        out["aggregate"] = own if isinstance(own, dict) else {"by": by, "method": config.get("aggregate_method", "mean"), "exclude_outliers": bool(config.get("aggregate_exclude_outliers", False))}
    return out | {"sources": sources}


def normalized(config: dict) -> dict:
    """A description in the form that parse() takes, from any accepted spelling."""
    if not isinstance(config, dict):
        raise SpecError(f"{config!r} is no description")
    config = canonical(config)
    if "sources" not in config:
        return from_flat(config)
    root = {k: config.pop(k) for k in ROOT_PARAMS if k in config}
    if root:
        config["params"] = root | (config.get("params") or {})
    if isinstance(config.get("aggregate"), (str, bool)) or "aggregate_method" in config or "aggregate_exclude_outliers" in config:
        by, method, outliers = config.pop("aggregate", None), config.pop("aggregate_method", "mean"), config.pop("aggregate_exclude_outliers", False)
        config["aggregate"] = {"by": by if isinstance(by, str) else config.get("repetition"), "method": method, "exclude_outliers": bool(outliers)}
    return config
