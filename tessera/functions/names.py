"""Frames and leaflets from the names of files, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of file names, the first that fits counts.
FRAME_FORMS = (r"frame_(\d+)_clusters_both\.npz$", r"frame_(\d+)_(?:radius_)?defects\.npz$", r"frame_(\d+)", r"(\d+)")
PRUNED_FORM = r"frame_(\d+)_pruned_clusters_(upper|lower)\.npz$"


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(path, "[^/]*$", 0)


def _found(name: Column, form: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(name, form, group), F.lit(""))


def _needed(value: Column, path: Column) -> Column:
    return F.coalesce(value, F.raise_error(F.concat(F.lit("a file name of no known form: "), path)).cast("string"))


def frame_of(path: Column) -> Column:
    """The frame in a file's name; a name without digits raises, null stays null."""
    found = F.coalesce(*[_found(base_name(path), f) for f in FRAME_FORMS])
    return F.when(path.isNotNull(), _needed(found, path)).cast("long")


def pruned_frame_and_side(path: Column) -> tuple[Column, Column]:
    """Frame and side of a pruned leaflet's file; any other name raises."""
    name = base_name(path)
    frame, side = (F.when(path.isNotNull(), _needed(_found(name, PRUNED_FORM, g), path)) for g in (1, 2))
    return frame.cast("long"), side


def split_frame(path: Column, prefix: str = "frame") -> Column:
    """The frame of `prefix_N.ext`; any other name raises."""
    return F.when(path.isNotNull(), _needed(_found(base_name(path), rf"^{re.escape(prefix)}_(\d+)(?:\.[^.]*)?$"), path)).cast("long")
