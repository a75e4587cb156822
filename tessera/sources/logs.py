"""Small text files of a run: box and atom tables as CSV lines, logs of triangles, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the files, the line between sections, captions and the forms of lines.
BOX_COLUMNS = ("frame", "X(AA)", "Y(AA)", "Z(AA)")
ATOM_COLUMNS = ("resname", "atom_name", "atom_type", "vdw_radius", "flag")
SEPARATOR = "-" * 60
TIMES = "Pipeline step timings"
TIME_LINE = "{:<5}{:<24}{:>12}{:>12}"
MODES = ("degenerate_triangle", "head_above_override", "below_min_total_coverage", "classified")


def box_lines(box: DataFrame) -> DataFrame:
    """frame and line: a box table's rows as CSV, lengths at four decimals."""
    return box.select("frame", F.format_string("%d,%.4f,%.4f,%.4f", F.col("frame").cast("long"), "lx", "ly", "lz").alias("line"))


def parse_box_lines(lines: DataFrame) -> DataFrame:
    """frame, lx, ly, lz of a box table's lines (without the header); a malformed one raises."""
    row = F.from_csv("line", "frame long, lx double, ly double, lz double", {"mode": "FAILFAST"})
    bad = F.raise_error(F.concat(F.lit("a malformed row: "), "line"))
    kinds = (("frame", "long"), ("lx", "double"), ("ly", "double"), ("lz", "double"))
    return lines.select(row.alias("r"), "line").select(*[F.coalesce(f"r.{c}", bad.cast(t)).alias(c) for c, t in kinds])


def write_boxes(box: DataFrame, path: str) -> None:
    """The box table as CSV with a header, by frame."""
    cells = [F.format_string("%.4f", c).alias(n) for c, n in zip(("lx", "ly", "lz"), BOX_COLUMNS[1:], strict=True)]
    box.orderBy("frame").select("frame", *cells).write.mode("overwrite").csv(path, header=True)


def boxes_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """frame, lx, ly, lz of a box table, which build() gives where the file isn't there yet; a malformed row or an empty table raises."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        write_boxes(build(), path)
        lines = spark.read.text(path)
    rows = parse_box_lines(lines.where(F.col("value") != ",".join(BOX_COLUMNS)).select(F.col("value").alias("line")))
    if rows.isEmpty():
        raise ValueError(f"{path} has no frames")
    return rows


def atom_lines(atom_table: DataFrame) -> DataFrame:
    """line: an atom table (res_name, atom_name, bead_type, radius, flag) as CSV; an unknown radius is empty."""
    return atom_table.select(F.to_csv(F.struct("res_name", "atom_name", "bead_type", F.col("radius").cast("string").alias("radius"), "flag")).alias("line"))


def parse_atom_lines(lines: DataFrame) -> DataFrame:
    """res_name, atom_name, flag and radius of an atom table's lines; texts without blanks at their ends, flags in lower case, a row without a number for its radius raises."""
    row = F.from_csv("line", "res_name string, atom_name string, bead_type string, radius string, flag string", {"mode": "FAILFAST"})
    cell = lambda c: F.trim(F.col(f"r.{c}"))
    radius = F.coalesce(cell("radius").try_cast("double"), F.raise_error(F.concat(F.lit("no radius: "), "line")).cast("double"))
    return lines.select(row.alias("r"), "line").select(cell("res_name").alias("res_name"), cell("atom_name").alias("atom_name"), F.lower(cell("flag")).alias("flag"), radius.alias("radius"))


def write_atom_table(atom_table: DataFrame, path: str) -> None:
    """The atom table as CSV with a header, by residue and atom."""
    named = atom_table.select("res_name", "atom_name", "bead_type", "radius", "flag").orderBy("res_name", "atom_name").toDF(*ATOM_COLUMNS)
    named.write.mode("overwrite").csv(path, header=True)


def read_atom_table(spark: SparkSession, path: str) -> DataFrame:
    """res_name, atom_name, flag and radius of an atom table's file."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return parse_atom_lines(lines.where(F.col("line") != ",".join(ATOM_COLUMNS)))


def bead_map_lines(pairs: DataFrame) -> DataFrame:
    """frame, tri and line: each triangle's candidate beads in the order of their serials, with their signed distance from its plane.

    pairs: frame, tri, serial, x, y, z (bead), cx, cy, cz (triangle), nx, ny, nz (its normal, of any length).
    """
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    along = sum(((F.col(c) - F.col(f"c{c}")) * F.col(f"n{c}") for c in "xyz"), F.lit(0.0)) / F.when(size == 0, 1.0).otherwise(size)
    held = pairs.select("frame", "tri", F.struct("serial", along.alias("d")).alias("b")).groupBy("frame", "tri").agg(F.sort_array(F.collect_list("b")).alias("b"))
    entry = F.concat_ws("/", F.transform("b", lambda b: F.concat_ws(":", b["serial"].cast("string"), F.format_string("%.1f", b["d"]))))
    return held.select("frame", "tri", F.concat(F.rpad(F.col("frame").cast("string"), 15, " "), F.rpad(F.col("tri").cast("string"), 20, " "), entry).alias("line"))


def coverage_lines(classes: DataFrame) -> DataFrame:
    """frame, tri and line: each triangle's fractions and mode.

    classes: frame, tri, side, local_tri, head_fraction, other_fraction, total_fraction, n_candidates, n_used, mode_code, is_defect.
    """
    mode: Column = F.coalesce(F.get(F.array(*map(F.lit, MODES)), F.col("mode_code").cast("int")), F.lit("unknown"))
    text = F.format_string(
        "frame=%d tri=%d side=%s local_tri=%d head_frac=%.5f other_frac=%.5f total_frac=%.5f ncand=%d nused=%d mode=%s defect=%d",
        F.col("frame").cast("long"), F.col("tri").cast("long"), "side", F.col("local_tri").cast("long"), "head_fraction", "other_fraction", "total_fraction",
        F.col("n_candidates").cast("long"), F.col("n_used").cast("long"), mode, F.col("is_defect").cast("int"),
    )
    return classes.select("frame", "tri", text.alias("line"))


def sections(texts: list[str | None]) -> str:
    """A report's sections with a line of dashes between them; blank ones are left out."""
    kept = [trimmed for t in texts if (trimmed := (t or "").strip("\n")).strip()]
    return f"\n{SEPARATOR}\n".join(kept) + "\n"


def timings(took: dict[int, float], names: dict[int, str]) -> str:
    """A table of seconds and minutes of each step, and of all; every line, the head too, has the same form."""
    steps = [(k, names[k], took.get(k, 0.0)) for k in sorted(names)]
    steps.append(("total", "", sum(s for *_, s in steps)))
    head, *body = [TIME_LINE.format(*c) for c in [("step", "name", "seconds", "minutes"), *((k, n, f"{s:.3f}", f"{s / 60:.3f}") for k, n, s in steps)]]
    bar = "=" * 30
    return "\n".join((bar, TIMES, bar, head, *body[:-1], "-" * len(head), body[-1])) + "\n"
