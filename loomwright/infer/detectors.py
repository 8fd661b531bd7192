"""Scored guesses about a dataset, from bounded samples and single aggregates."""

from __future__ import annotations

import re

#: Scored conditions of the signal types (fixed values): low and high bounds of the block's minimum, maximum and mean.
_RULES = (
    ("reflectance", (0, None), (None, 1.2), None, 0.5), ("reflectance", (0, None), (None, 1.2), (0.1, 0.8), 0.3), ("reflectance", (0, None), (None, 1.0), None, 0.2),
    ("transmittance", (0, None), (None, 1.2), None, 0.4), ("transmittance", (0, None), (None, 1.2), (0.05, 0.5), 0.2),
    ("reflectance%", (0, None), (1.5, 120), None, 0.5), ("reflectance%", (0, None), (1.5, 120), (10, 80), 0.3), ("reflectance%", (0, None), (1.5, 100), None, 0.2),
    ("transmittance%", (0, None), (1.5, 120), None, 0.4), ("transmittance%", (0, None), (1.5, 120), (5, 50), 0.2),
    ("absorbance", (-0.5, None), (0.5, 5), None, 0.4), ("absorbance", (-0.5, None), (0.5, 5), (0.2, 2), 0.3), ("absorbance", (-0.2, None), (0.5, 5), None, 0.2), ("absorbance", (-0.5, None), (1, 5), None, 0.1),
)


def _within(x: float, bounds) -> bool:
    """Bounds belong to the range, but for a low one of 1.5, above which percentages begin."""
    return bounds is None or (bounds[0] is None or x > bounds[0] or x == bounds[0] != 1.5) and (bounds[1] is None or x <= bounds[1])


#: Wavelengths in nm at which water absorbs, and what a peak or a dip of the mean spectrum there adds to each type (fixed values).
WATER = (1450.0, 1940.0, 2500.0)
_PEAK = {"absorbance": 0.3, "reflectance": -0.1, "transmittance": -0.1, "reflectance%": -0.1, "transmittance%": -0.1}
_DIP = {"absorbance": -0.1, "reflectance": 0.2, "transmittance": 0.2, "reflectance%": 0.2, "transmittance%": 0.2}


def water_hints(mean: list[float], axis: list[float]) -> dict[str, float]:
    """What the mean spectrum's peaks and dips at the water bands say for each signal type; axis in nm."""
    out = dict.fromkeys(_PEAK, 0.0)
    if not axis:
        return out
    for band in WATER:
        if not min(axis) <= band <= max(axis):
            continue
        at = min(range(len(axis)), key=lambda i: abs(axis[i] - band))
        around = mean[max(0, at - 10) : at + 11]
        level = sum(around) / len(around)
        for name in out:
            out[name] += _PEAK[name] if mean[at] > 1.05 * level else _DIP[name] if mean[at] < 0.95 * level else 0
    return out


def signal_type(low: float, high: float, mean: float, std: float, hints: dict[str, float] | None = None) -> tuple[str, float]:
    if abs(mean) < 0.01 and std > 0.1 or abs(std - 1) < 0.1 and abs(mean) < 0.1 or low < -0.5 and high < 0.5 and abs(mean) < 0.01:
        return "preprocessed", 0.9
    scores: dict[str, float] = {}
    for name, lows, highs, means, points in _RULES:
        if _within(low, lows) and _within(high, highs) and _within(mean, means):
            scores[name] = scores.get(name, 0) + points
    scores = {k: v + 0.2 * (hints or {}).get(k, 0.0) for k, v in scores.items()}
    if not scores or max(scores.values()) <= 0:
        return "unknown", 0.0
    scores = {k: max(v, 0.0) for k, v in scores.items()}
    best = max(scores, key=scores.get)
    share = scores[best] / sum(scores.values())
    return (best, share) if share >= 0.7 else ("unknown", share)


def task_type(integral: bool, n_distinct: int, low: float, high: float, n: int) -> tuple[str, float]:
    if not n:
        return "regression", 0.0
    if integral:
        return ("binary", 0.9) if n_distinct == 2 else ("multiclass", 0.8) if 3 <= n_distinct <= 100 else ("regression", 0.8)
    if 0 <= low and high <= 1 and n_distinct <= 0.05 * n:
        return ("binary" if n_distinct == 2 else "multiclass"), 0.6
    return "regression", 0.8


def wavelength_header(names: list[str]) -> tuple[str, float] | None:
    """The unit of headers that are a wavelength axis: ten numbers or more, strictly monotonic, evenly enough spaced, in range."""
    try:
        x = [float(n) for n in names]
    except ValueError:
        return None
    steps = [b - a for a, b in zip(x, x[1:], strict=False)]
    if len(x) < 10 or not (all(s > 0 for s in steps) or all(s < 0 for s in steps)):
        return None
    mean = sum(steps) / len(steps)
    if (sum((s - mean) ** 2 for s in steps) / len(steps)) ** 0.5 > 0.5 * abs(mean):
        return None
    low, high = min(x), max(x)
    if 200 <= low <= 2600 and 350 <= high <= 2600:
        return "nm", 0.85
    return ("cm-1", 0.85) if 400 <= low <= 15000 and 1000 <= high <= 15000 else None


# Names of columns that identify samples, compared in lower case and without separators; and, with them, beginnings and ends.
ID_NAMES = {"sample", "sampleid", "id", "name", "code", "ref", "reference", "key", "index", "spectrumid", "scanid"}


def is_id_name(name: str) -> bool:
    low = re.sub(r"[\s\-.]+", "_", name.strip().lower())
    return low.replace("_", "") in ID_NAMES or low.endswith("_id") or low.startswith("id_")


def sample_id_score(name: str, uniqueness: float, dtype: str) -> float:
    """How likely a column identifies samples; 0.5 is accepted."""
    if re.fullmatch(r"\d+(\.\d+)?", name):
        return 0.0
    score = 0.5 * is_id_name(name) + (0.35 if uniqueness >= 1 else 0.15 if uniqueness >= 0.9 else 0)
    return score + (-0.25 if dtype == "double" else 0.1 if dtype == "string" else 0)
