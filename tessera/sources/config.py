"""Run settings: `key: value` or `key = value` lines with # comments, typed once."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

# The names of settings (here and in Settings), other names of some, and words for on and off.
ALIASES = {
    "workers": "cpu_workers", "triangle_area": "triangle_size", "clusters_per_frame": "cluster_count",
}
_ON, _OFF = {"on", "yes", "true", "1", "y"}, {"off", "no", "false", "0", "n"}


def read_settings(text: str) -> dict[str, str]:
    """Lower-cased keys and their values; a colon parts before an equals sign does, a line with neither raises."""
    out = {}
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].strip()
        if not line:
            continue
        mark = ":" if ":" in line else "="
        key, found, value = line.partition(mark)
        if not found:
            raise ValueError(f"neither a colon nor an equals sign: {raw.strip()}")
        key = key.strip().lower()
        out[ALIASES.get(key, key)] = value.strip().strip("\"'")
    return out


def as_bool(value: str, default: bool = False) -> bool:
    """on or off in any usual spelling; empty is the default, anything else raises."""
    low = value.strip().lower()
    if not low:
        return default
    if low not in _ON | _OFF:
        raise ValueError(f"neither on nor off: {value}")
    return low in _ON


def as_list(value: str) -> list[str]:
    """Parts between commas, semicolons and spaces."""
    return [x for x in re.split(r"[,;\s]+", value) if x]


def frame_range(value: str) -> tuple[int, int] | None:
    """Both ends of `a-b` (or `a`), inclusive; None for all."""
    if not value.strip() or value.strip().lower() == "all":
        return None
    a, _, b = value.partition("-")
    first, last = int(a), int(b or a)
    if first > last:
        raise ValueError(f"an empty range: {value}")
    return first, last


@dataclass(frozen=True)
class Settings:
    """The settings that the steps use, with their usual values."""

    input: str = ""
    output_name_prefix: str = ""
    model: str = "CG"
    neutral: list[str] = field(default_factory=list)
    custom_ff: str = ""
    res_name: list[str] = field(default_factory=lambda: ["POPC", "DOPE", "SAPI"])
    atom_name: list[str] = field(default_factory=lambda: ["GL2"])
    resume_from: float = 1
    cpu_workers: int = 4
    triangle_size: float = 1.0
    triangle_max_cv: float = 0.25
    min_triangle_count: int = 2
    triangle_kd_tree: int = 48
    fitting: bool = True
    cluster_count: bool = True
    coverage: bool = True
    distribution: bool = True
    defect_type_coverage: bool = True
    min_defect_size: float = 15.0
    max_defect_size: float = 250.0
    min_probability: float = 1e-4
    layer_analysis: bool = True
    layer_thickness: str = "auto"
    layer_thickness_tol: float = 8.0
    layer_max_pair_dist: float = 40.0
    layer_bilayer_frac: float = 0.5
    curvature_analysis: bool = True
    curvature_frames: str = "all"
    verbose: bool = False

    @classmethod
    def parse(cls, text: str) -> Settings:
        """Settings of a file's text; unknown keys are left out."""
        given = read_settings(text)
        made = {}
        for f in fields(cls):
            if given.get(f.name, "") == "":
                continue
            v, kind = given[f.name], str(f.type)
            made[f.name] = as_bool(v) if kind == "bool" else int(v) if kind == "int" else float(v) if kind == "float" else as_list(v) if kind.startswith("list") else v
        return cls(**made)

    def runs(self, step: float) -> bool:
        """Whether a step is at or after the one to resume from; whole numbers count alone."""
        return int(step) >= int(self.resume_from)
