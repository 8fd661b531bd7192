"""Proposals that a user confirms or overrides one by one: each kind in a fixed order, with scored alternatives; only a lock changes the description."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from itertools import combinations
from typing import Any

from pyspark.sql import DataFrame

from ..errors import SpecError
from ..operators.position import POS
from . import identity
from .engine import Plan

#: Kinds of proposals in their order (fixed values).
KINDS = ("structure", "role", "partition", "pairing", "identity", "signal_type", "task_type", "folds")
STATUSES = ("proposed", "confirmed", "overridden")


@dataclass
class Proposal:
    kind: str
    subject: str
    value: Any
    score: float
    alternatives: list[dict] = field(default_factory=list)
    status: str = "proposed"


def pairings(frames: dict[str, DataFrame], targets: list[str]) -> list[Proposal]:
    """Which tables have as many rows as a table of targets: one of them (better with a unique id of both), or two to four stacked."""
    rows = {n: df.count() for n, df in frames.items()}
    unique: dict[str, set[str]] = {}
    for n, df in frames.items():
        unique[n] = {p.name for p in identity.profiles(df, [c for c in df.columns if c != POS and identity.is_id_name(c)]) if p.n_rows and p.n_rows == p.n_unique}
    out = []
    for t in targets:
        others = [n for n in frames if n != t and n not in targets]
        found = []
        for n in others:
            if rows[n] != rows[t]:
                continue
            shared = sorted(unique[n] & unique[t])
            same = shared and not identity.audit(frames[n], frames[t], shared[0], shared[0])["n_missing"]
            found.append({"value": {"sources": [n], "by": shared[0] if shared else "row"}, "score": 0.9 if same else 0.7 if shared else 0.45})
        equal = sum(f["value"]["by"] == "row" for f in found) > 1
        for f in found:
            f["score"] = 0.3 if equal and f["value"]["by"] == "row" else f["score"]
        found += [{"value": {"sources": list(c), "by": "stack"}, "score": 0.5} for k in (2, 3, 4) for c in combinations(others, k) if sum(rows[n] for n in c) == rows[t] and all(rows[n] for n in c)]
        found.sort(key=lambda f: -f["score"])
        if found:
            out.append(Proposal("pairing", t, found[0]["value"], round(found[0]["score"], 3), found[1:]))
    return out


class Session:
    """A plan's proposals, and the description that the confirmed and overridden ones make."""

    def __init__(self, plan: Plan, frames: dict[str, DataFrame] | None = None):
        self.plan, self.proposals = plan, []
        add = lambda kind, subject, value, score: self.proposals.append(Proposal(kind, subject, value, round(score, 3)))
        if plan.structure:
            add("structure", "input", plan.structure.value, plan.structure.score)
        for a in plan.assignments:
            add("role", a["ref"], a["role"], 0.85 if a["score"] >= 0.9 else 0.6)
        for a in plan.assignments:
            add("partition", a["ref"], a["partition"], a["score"])
        if frames:
            self.proposals += pairings(frames, [a["ref"] for a in plan.assignments if a["role"] == "targets" and a["ref"] in frames])
        for kind in ("identity", "signal_type", "task_type"):
            if own := getattr(plan, kind):
                add(kind, "dataset", own.value, own.score)
        if plan.spec.get("folds"):
            add("folds", "dataset", plan.spec["folds"], 0.9)
        self.proposals.sort(key=lambda p: KINDS.index(p.kind))

    def lock(self, kind: str, subject: str, value: Any = None) -> Proposal:
        """Confirm a proposal, or override its value."""
        own = next((p for p in self.proposals if p.kind == kind and p.subject == subject), None)
        if own is None:
            raise SpecError(f"there is no proposal of {kind} for {subject}")
        own.status = "confirmed" if value is None or value == own.value else "overridden"
        own.value = own.value if value is None else value
        return own

    def spec(self) -> dict:
        """The plan's description as the locks change it; proposals that are not locked leave it as it is."""
        out = copy.deepcopy({k: v for k, v in self.plan.spec.items() if k != "sources"}) | {"sources": [dict(s) for s in self.plan.spec.get("sources", [])]}
        named = {a["ref"]: s for a in self.plan.assignments for s in out["sources"] if isinstance(s["input"], str) and s["input"].rsplit("/", 1)[-1] == a["ref"]}
        for p in self.proposals:
            if p.status == "proposed":
                continue
            if p.kind in ("role", "partition") and p.subject in named:
                named[p.subject][p.kind] = p.value
            elif p.kind in ("signal_type", "task_type", "folds"):
                out[p.kind] = p.value
            elif p.kind == "identity":
                out["sample_index"] = {"by": "id", "key": p.value}
            elif p.kind == "pairing" and p.subject in named and len(p.value["sources"]) == 1 and p.value["sources"][0] in named:
                left = named[p.value["sources"][0]]
                named[p.subject]["join"] = {"to": left["id"], "how": "1:1"} | ({} if p.value["by"] == "row" else {"on": p.value["by"]})
        return out
