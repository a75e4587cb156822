"""Force-field text files as dimension tables: bead types by residue and atom, radii by type.

Files are split to numbered lines; which section a line stands in is the last header before it, by a window over the
file. So every format is a projection of one table of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.beads import radius_from_sigma, sigma_from_c6_c12
from tessera.sources.merges import first_wins


def file_lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, line_no, line (trimmed, not empty) of a folder's files whose names match the glob pattern."""
    whole = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "raw")).select("path", "line_no", F.btrim("raw", F.lit(" \t\r")).alias("line")).where("line <> ''")


def _in_file():
    return Window.partitionBy("path").orderBy("line_no")


def _latest(value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(_in_file().rowsBetween(Window.unboundedPreceding, 0))


def _tokens(line: Column) -> Column:
    return F.split(line, r"\s+")


def lib_types(lines: DataFrame) -> DataFrame:
    """path, line_no, res, atom, type of the quoted rows of `!entry.RES.unit.atoms` tables."""
    header = F.col("line").startswith("!entry.")
    table = F.when(header & F.col("line").contains(".unit.atoms"), F.upper(F.trim(F.split("line", r"\.")[1]))).when(header, "")
    quoted = F.split("line", '"')
    rows = lines.withColumn("res", _latest(table)).where((F.col("res") != "") & F.col("line").startswith('"'))
    return rows.select("path", "line_no", "res", F.trim(F.get(quoted, F.lit(1))).alias("atom"), F.trim(F.get(quoted, F.lit(3))).alias("type")).where("atom <> '' AND type <> ''")


def prepc_types(lines: DataFrame) -> DataFrame:
    """path, line_no, res, atom, type of the numbered rows below `RES XYZ` headers, without DUMM."""
    t = _tokens(F.col("line"))
    res = F.when((F.size(t) >= 3) & (F.get(t, F.lit(1)) == "XYZ"), F.upper(F.get(t, F.lit(0))))
    rows = lines.withColumns({"t": t, "res": _latest(res)}).where("res IS NOT NULL AND size(t) >= 3 AND t[1] <> 'XYZ' AND t[1] <> 'DUMM'")
    return rows.where(F.col("t")[0].rlike(r"^[+-]?\d+$")).select("path", "line_no", "res", F.col("t")[1].alias("atom"), F.col("t")[2].alias("type"))


def _sections(lines: DataFrame) -> DataFrame:
    """Data tokens t of an .itp file's lines and the section and number of section they stand in; comments are gone."""
    name = F.when(F.col("line").rlike(r"^\[.*\]$"), F.lower(F.btrim("line", F.lit("[] \t"))))
    data = F.btrim(F.split("line", ";")[0], F.lit(" \t"))
    head = name.isNotNull()
    marked = lines.withColumns({"section": _latest(name), "part": F.sum(F.when(head, 1).otherwise(0)).over(_in_file()), "data": data})
    return marked.where((F.col("data") != "") & ~F.col("line").rlike(r"^\[.*\]$")).withColumn("t", _tokens(F.col("data")))


def itp_types(lines: DataFrame) -> DataFrame:
    """path, line_no, res, atom, type: a molecule's name from [moleculetype], its atoms (5th token) and their types (2nd) from [atoms] rows of 7 tokens or more."""
    rows = _sections(lines)
    first = F.row_number().over(Window.partitionBy("path", "part").orderBy("line_no")) == 1
    named = rows.withColumn("first", first).withColumn("res", _latest(F.when((F.col("section") == "moleculetype") & F.col("first"), F.col("t")[0])))
    return named.where("section = 'atoms' AND size(t) >= 7 AND res IS NOT NULL").select("path", "line_no", "res", F.col("t")[4].alias("atom"), F.col("t")[1].alias("type"))


def martini_version(lines: DataFrame) -> DataFrame:
    """path and version (3, 2 or null) by each file's first line."""
    top = lines.groupBy("path").agg(F.upper(F.min_by("line", "line_no")).alias("top"))
    three = F.col("top").rlike("MARTINI ?3 FORCE FIELD")
    two = F.col("top").rlike("MARTINI FORCE ?FIELD V2|MARTINI V2")
    return top.select("path", F.when(three, 3).when(two, 2).alias("version"))


def martini_sigmas(lines: DataFrame) -> DataFrame:
    """path, line_no, type, sigma_nm of self-pairs in [nonbond_params]; version 2 has C6 and C12. Such a section in a file of no known version raises."""
    rows = _sections(lines).where("section = 'nonbond_params'").join(martini_version(lines), "path")
    pairs = rows.where("size(t) >= 5 AND t[0] = t[1]").select("path", "line_no", F.col("t")[0].alias("type"), "version", *[F.col("t")[i].try_cast("double").alias(c) for i, c in ((3, "p"), (4, "q"))])
    unknown = F.raise_error(F.concat(F.lit("no known Martini version: "), "path")).cast("double")
    sigma = F.when(F.col("version") == 3, F.col("p")).when(F.col("version") == 2, F.when((F.col("p") > 0) & (F.col("q") > 0), sigma_from_c6_c12(F.col("p"), F.col("q")))).otherwise(unknown)
    return pairs.select("path", "line_no", "type", sigma.alias("sigma_nm")).where("sigma_nm IS NOT NULL")


def dat_radii(lines: DataFrame) -> DataFrame:
    """path, line_no, type, radius of rows below the line that ends in RE."""
    t = _tokens(F.col("line"))
    mark = F.when((F.size(t) >= 2) & (F.element_at(t, -1) == "RE"), 1)
    rows = lines.withColumns({"t": t, "mark": mark}).withColumn("inside", _latest(F.col("mark"))).where("inside = 1 AND mark IS NULL AND size(t) >= 2")
    return rows.select("path", "line_no", F.col("t")[0].alias("type"), F.col("t")[1].try_cast("double").alias("radius")).where("radius IS NOT NULL")


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first file (by name) has its way, and in a file the last line."""
    return first_wins(rows, keys, F.col("path").asc(), F.col("line_no").desc())


def type_table(spark: SparkSession, folder: str, model: str = "CG") -> DataFrame:
    """res, atom, type of a folder: .itp files for CG, .lib and then .prepc files for AA."""
    if model.upper() == "CG":
        return _merged(itp_types(file_lines(spark, folder, "*.[iI][tT][pP]")), ["res", "atom"]).select("res", "atom", "type")
    lib = lib_types(file_lines(spark, folder, "*.lib")).withColumn("path", F.concat(F.lit("0/"), "path"))
    prep = prepc_types(file_lines(spark, folder, "*.prepc")).withColumn("path", F.concat(F.lit("1/"), "path"))
    return _merged(lib.unionByName(prep), ["res", "atom"]).select("res", "atom", "type")


def radius_table(spark: SparkSession, folder: str, model: str = "CG") -> DataFrame:
    """type and radius (in angstroms) of a folder: Martini self-pairs for CG, .dat files for AA."""
    if model.upper() == "CG":
        rows = _merged(martini_sigmas(file_lines(spark, folder, "*.[iI][tT][pP]")), ["type"])
        return rows.select("type", radius_from_sigma(F.col("sigma_nm")).alias("radius"))
    return _merged(dat_radii(file_lines(spark, folder, "*.dat")), ["type"]).select("type", "radius")
