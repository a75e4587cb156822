"""Column expressions about beads and their types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_positive(v: Column) -> Column:
    """Finite and above 0; false for null. Spark holds NaN above every number, so it is named."""
    return F.coalesce(~F.isnan(v) & (v > 0) & (v < float("inf")), F.lit(False))


def residue_name(name: Column, model: str = "CG") -> Column:
    """Trimmed and upper-cased; coarse-grained names keep 4 characters."""
    upper = F.upper(F.trim(name))
    return F.substring(upper, 1, 4) if model.upper() == "CG" else upper


def neutral_names(values: str | list[str], model: str = "CG") -> set[str]:
    """Names of neutral residues, split at commas, semicolons and spaces."""
    text = values if isinstance(values, str) else " ".join(values)
    names = {x.strip().upper() for x in text.replace(",", " ").replace(";", " ").split()}
    return {x[:4] if model.upper() == "CG" else x for x in names if x}


def bead_flag(residue: Column, bead_type: Column, neutral: set[str]) -> Column:
    """n for a neutral residue, t for a type that starts with C, else h."""
    tail = F.upper(F.trim(bead_type)).startswith("C")
    flag = F.when(tail, "t").otherwise("h")
    return F.when(residue.isin(sorted(neutral)), "n").otherwise(flag) if neutral else flag


def sigma_from_c6_c12(c6: Column, c12: Column) -> Column:
    """(C12 / C6) ** (1/6) in nm; raises where either isn't positive."""
    ratio = c12 / c6
    return F.when((c6 > 0) & (c12 > 0), F.power(ratio, F.lit(1 / 6))).otherwise(F.raise_error(F.lit("C6 and C12 must be positive")).cast("double"))


def radius_from_sigma(sigma_nm: Column) -> Column:
    """Radius in angstroms of a sigma in nm: half of the distance of least energy, 5 * 2 ** (1/6) * sigma."""
    return sigma_nm * (5 * 2 ** (1 / 6))
