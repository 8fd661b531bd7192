"""Names of files that say what is in them: profiles of such names, matching, and the description that a match stands for."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from itertools import product

from ..errors import SpecError
from ..sources.files import REFUSED, stem_of

ROLE = {"x": "features", "y": "targets", "m": "metadata"}
#: Extensions of files that can be tables, and of makers' files of one spectrum each (fixed values).
TABLES = (".csv", ".csv.gz", ".csv.zip", ".tsv", ".txt", ".parquet", ".npy", ".npz", ".xlsx", ".xls")
VENDOR = ("opus", "jcamp", "spc", "asd", "sed", "sig", "spa", "dx", "0")
FOLDS = ("folds", "fold", "cv_folds", "cvfolds", "cross_validation", "crossvalidation", "cv", "splits")


@dataclass
class Profile:
    """patterns: (role, partition) to words found in a stem; bare: role to whole stems; folds: whole words of fold files."""

    name: str
    patterns: dict[tuple[str, str], list[str]] = field(default_factory=dict)
    bare: dict[str, list[str]] = field(default_factory=dict)
    folds: list[str] = field(default_factory=list)
    vendor: list[str] = field(default_factory=list)
    reference: list[str] = field(default_factory=list)
    on_missing: str = "warn"


def _both(roles, parts, role_first_only: bool = False) -> list[str]:
    out = []
    for r, p in product(roles, parts):
        out += [r + p, f"{r}_{p}"] + ([] if role_first_only else [f"{p}_{r}", p + r])
    return out


def builtin() -> dict[str, Profile]:
    """The profiles that come with the library."""
    parts = {"train": ("cal", "train"), "test": ("val", "test")}
    words = {"x": ("x",), "y": ("y",), "m": ("m", "meta", "metadata")}
    bare = {"x": ["x"], "y": ["y"], "m": ["m", "meta", "metadata", "group"]}
    classic = Profile("classic", {(r, p): _both(words[r], parts[p]) for r, p in product(words, parts)}, bare, list(FOLDS))
    simple = Profile("train-test", {(r, p): _both(("m", "meta") if r == "m" else words[r], (p,), r == "m") for r, p in product(words, parts)}, bare, ["folds", "fold", "cv", "splits"])
    named = {"x": ["x", "features", "spectra", "spectrum"], "y": ["y", "target", "targets", "labels"], "m": bare["m"]}
    single = Profile("bare", {(r, "train"): w for r, w in named.items()}, {r: w[:3] if r != "m" else w for r, w in named.items()}, ["folds", "fold", "cv", "splits"])
    corpus = Profile("vendor-corpus", vendor=list(VENDOR), reference=["y", "ref", "reference", "targets", "labels", "meta", "metadata"])
    return {p.name: p for p in (classic, simple, single, corpus)}


def profile(given) -> Profile:
    """A profile by its name, from a dict, or from a JSON or TOML text or file."""
    if isinstance(given, Profile):
        return given
    if isinstance(given, str) and given in builtin():
        return builtin()[given]
    if isinstance(given, (str, os.PathLike)):
        text = given if isinstance(given, str) and given.lstrip()[:1] in "{[#" or "\n" in str(given) else open(given, encoding="utf-8").read() if os.path.exists(given) else None
        if text is None:
            raise SpecError(f"there is no profile {given!r}; known are {', '.join(builtin())}")
        if text.lstrip().startswith("{"):
            given = json.loads(text)
        else:
            import tomllib

            given = tomllib.loads(text)
    if not isinstance(given, dict) or "profile" not in given:
        raise SpecError("a profile has a name under profile")
    patterns, folds = {}, []
    for key, words in (given.get("roles") or {}).items():
        if key == "folds":
            folds = [str(w).lower() for w in words]
            continue
        part, _, role = key.partition("_")
        short = {"x": "x", "y": "y", "group": "m", "meta": "m", "metadata": "m"}.get(role)
        if part not in ("train", "test", "val", "predict") or short is None:
            raise SpecError(f"a profile has no role {key!r}")
        patterns[short, part] = [str(w).lower() for w in words]
    bare = {{"meta": "m"}.get(k, k): [str(w).lower() for w in v] for k, v in (given.get("bare") or {}).items()}
    return Profile(given["profile"], patterns, bare, folds, list((given.get("spectra") or {}).get("formats", [])), [str(w).lower() for w in (given.get("reference") or {}).get("names", [])], (given.get("join") or {}).get("on_missing", "warn"))


def found_in(stem: str, word: str) -> bool:
    """Whether a stem has a word: one of up to two letters stands between separators, a longer one anywhere."""
    if len(word) > 2:
        return word in stem
    return re.search(rf"(^|[_\-. ]){re.escape(word)}($|[_\-. ])", stem) is not None


@dataclass
class Assignment:
    name: str
    role: str
    partition: str
    pattern: str
    score: float


@dataclass
class Match:
    assignments: list[Assignment] = field(default_factory=list)
    folds: list[str] = field(default_factory=list)
    spectra: list[str] = field(default_factory=list)
    reference: list[str] = field(default_factory=list)
    unmatched: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    on_missing: str = "warn"


def match(names: list[str], profiles: list, extensions: tuple[str, ...] = TABLES) -> Match:
    """What the names of files say: by patterns first, then whole stems for roles that no training file has.

    Where several files have one role of a partition, features become several sources; of other roles the first counts.
    """
    profiles, out = [profile(p) for p in profiles], Match()
    tables, left = [], []
    for n in names:
        low = n.lower()
        if low.endswith(REFUSED):
            left.append(n)
        elif any(low.rsplit(".", 1)[-1] in p.vendor for p in profiles if p.vendor) and "." in low:
            out.spectra.append(n)
        elif low.endswith(extensions):
            tables.append(n)
        else:
            left.append(n)
    taken: dict[tuple[str, str], list[Assignment]] = {}
    rest = []
    for n in tables:
        stem, hit = stem_of(n).lower(), None
        for p in profiles:
            hit = hit or next(((r, part, w) for (r, part), words in p.patterns.items() for w in words if found_in(stem, w)), None)
        if hit is None and any(found_in(stem, w) for p in profiles for w in p.folds):
            out.folds.append(n)
        elif hit is None:
            rest.append(n)
        else:
            role, part, word = hit
            taken.setdefault((role, part), []).append(Assignment(n, ROLE[role], part, word, 0.9))
    for n in rest:
        stem = stem_of(n).lower()
        if out.spectra and any(stem == w for p in profiles for w in p.reference):
            out.reference.append(n)
            continue
        role = next((r for p in profiles for r, stems in p.bare.items() if stem in stems), None)
        if role is None or (role, "train") in taken:
            left.append(n)
        else:
            taken[role, "train"] = [Assignment(n, ROLE[role], "train", f"bare:{stem}", 0.75)]
    for (role, part), own in taken.items():
        if role != "x" and len(own) > 1:
            out.warnings.append(f"several files are {ROLE[role]} of {part}: {', '.join(a.name for a in own)}; the first counts")
            left += [a.name for a in own[1:]]
            own = own[:1]
        out.assignments += own
    order = {r: i for i, r in enumerate(ROLE.values())}
    out.assignments.sort(key=lambda a: (a.partition != "train", a.partition, order[a.role], a.name))
    if len(out.folds) > 1:
        out.warnings.append(f"several files are folds: {', '.join(out.folds)}; the first counts")
    out.unmatched = sorted(left)
    out.on_missing = next((p.on_missing for p in profiles if p.vendor), "warn")
    return out


def to_spec(found: Match, name: str = "dataset", reference_key: str | None = None) -> dict:
    """The description that a match stands for: each partition's targets and metadata join its first features row by row."""
    if found.spectra:
        sources = [{"id": "spectra", "role": "features", "input": found.spectra, "merge": "concat_samples", "key": "filename_stem"}]
        for n in found.reference[:1]:
            sources.append({"id": "reference", "kind": "lookup", "role": "targets", "input": n, "join": {"to": "spectra", "left_on": "filename_stem", "right_on": reference_key or "filename_stem", "how": "m:1", "coverage": found.on_missing}})
        return {"name": name, "sources": sources}
    parts = list(dict.fromkeys(a.partition for a in found.assignments))
    sources = []
    for part in parts:
        own = [a for a in found.assignments if a.partition == part]
        several = sum(a.role == "features" for a in own) > 1
        anchor, nth = None, 0
        for a in own:
            short = {"features": "x", "targets": "y", "metadata": "m"}[a.role]
            source = {"id": f"{part}_{short}" + (f"_{nth}" if several and short == "x" else ""), "role": a.role, "input": a.name}
            if len(parts) > 1:
                source["partition"] = part
            if anchor:
                source["join"] = {"to": anchor, "how": "1:1"}
            elif short == "x":
                anchor = source["id"]
            nth += short == "x"
            sources.append(source)
    spec = {"name": name, "sources": sources}
    if found.folds:
        spec["folds"] = {"file": found.folds[0], "format": "auto"}
    return spec
