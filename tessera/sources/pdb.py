"""Multi-frame PDB text as a table of beads, read in byte ranges; PDB lines as columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that one task starts in. A frame belongs to the range in which it begins.
RANGE_BYTES = 64 << 20
SCHEMA = "frame long, line_no long, record string, serial int, name string, alt_loc string, res_name string, chain string, res_seq string, icode string, x double, y double, z double, occupancy string, temp_factor string, element string, charge string, cryst1 string"
#: name -> (first, past last) column of an atom line.
FIELDS = {
    "record": (0, 6), "serial": (6, 11), "name": (12, 16), "alt_loc": (16, 17), "res_name": (17, 21), "chain": (21, 22), "res_seq": (22, 26), "icode": (26, 27),
    "x": (30, 38), "y": (38, 46), "z": (46, 54), "occupancy": (54, 60), "temp_factor": (60, 66), "element": (76, 78), "charge": (78, 80),
}
#: Numbers of five columns that are decimal, and those that begin with a capital letter (hybrid-36).
_DECIMAL, _CAPITAL = 100_000, 26 * 36**4
_TEXT = "path string, start long, stop long"


def _chunks(path: str, start: int, stop: int) -> Iterator[list[str]]:
    """Lines of each END-closed chunk that begins in [start, stop)."""
    files, place = fs.FileSystem.from_uri(path)
    with files.open_input_file(place) as f:
        f.seek(max(0, start - 1))
        at = max(0, start - 1)
        rest, lines, inside = b"", [], start == 0
        first_line = start > 0  # the line that holds byte start - 1 began before the range
        begin = 0
        while True:
            block = f.read(1 << 20)
            data = rest + block
            parts = data.split(b"\n")
            rest = parts.pop() if block else b""
            for raw in parts:
                here, at = at, at + len(raw) + 1
                line = raw.decode("utf-8", "replace").rstrip("\r")
                if not inside:
                    if line[:6].strip() == "END" and not (first_line and here > start - 1):
                        inside, begin, lines = True, at, []
                        if begin >= stop:
                            return
                    first_line = False
                    continue
                if line[:6].strip() == "END":
                    yield lines
                    begin, lines = at, []
                    if begin >= stop:
                        return
                elif line[:6].strip() not in ("MODEL", "ENDMDL"):
                    lines.append(line)
            if not block:
                break
        if inside and any(x.strip() for x in lines):
            yield lines


def _serials(text: pd.Series) -> pd.Series:
    """As read_serial."""
    out = pd.to_numeric(text, errors="coerce").astype("Float64")
    for first, base in (("A-Z", _DECIMAL), ("a-z", _DECIMAL + _CAPITAL)):
        wide = text.str.fullmatch(f"[{first}][0-9{first}]{{4}}")
        out[wide] = text[wide].map(lambda x, base=base: int(x, 36) - 10 * 36**4 + base).astype("Float64")
    return out


def _has_atoms(lines: list[str]) -> bool:
    return any(x[:6].strip() in ("ATOM", "HETATM") for x in lines)


def _census(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in frames:
        for r in x.itertuples(index=False):
            n, last = 0, None
            for lines in _chunks(r.path, r.start, r.stop):
                last = next((y for y in reversed(lines) if y[:6].strip() == "CRYST1"), last)
                n += _has_atoms(lines)
            yield pd.DataFrame({"path": [r.path], "start": [r.start], "stop": [r.stop], "frames": [n], "last": [last]})


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in frames:
        for r in x.itertuples(index=False):
            frame, cell = r.first, r.cell
            for lines in _chunks(r.path, r.start, r.stop):
                cell = next((y for y in reversed(lines) if y[:6].strip() == "CRYST1"), cell)
                if not _has_atoms(lines):
                    continue
                atoms = [(i, y) for i, y in enumerate(lines) if y[:6].strip() in ("ATOM", "HETATM")]
                out = pd.DataFrame({"line_no": [i for i, _ in atoms]})
                text = pd.Series([y for _, y in atoms], dtype=object)
                for k, (a, b) in FIELDS.items():
                    out[k] = text.str[a:b] if k in ("alt_loc", "chain", "icode") else text.str[a:b].str.strip()
                out["serial"] = _serials(out["serial"])
                for k in ("x", "y", "z"):
                    out[k] = pd.to_numeric(out[k], errors="coerce")
                out = out[out[["x", "y", "z"]].notna().all(axis=1)]
                out["serial"] = out["serial"].astype("Int32")
                yield out.assign(frame=frame, cryst1=cell)[[c.split()[0] for c in SCHEMA.split(", ")]]
                frame += 1


def stamp(path: str) -> str:
    """A file's size and time, which tell a changed trajectory from the old one."""
    files, place = fs.FileSystem.from_uri(path)
    info = files.get_file_info(place)
    return f"{info.size} {info.mtime_ns}"


def read_pdb(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The beads of a trajectory (SCHEMA); path is a URI that every executor can open.

    A bare END closes a frame, the last may lack it; MODEL and ENDMDL don't count. Chunks without ATOM or HETATM have
    no number; a chunk without CRYST1 has the last one seen. Atom lines without three coordinates are left out; a serial that
    is no number is null (`numbered` leaves such atoms out, boxes count them). A first pass counts frames per range, so that ranges
    know their first frame's number; only one row per range comes to the driver.
    """
    files, place = fs.FileSystem.from_uri(path)
    size = files.get_file_info(place).size
    ranges = [(path, a, min(a + range_bytes, size)) for a in range(0, size, range_bytes)]
    if not ranges:
        return spark.createDataFrame([], SCHEMA)
    dealt = spark.createDataFrame(ranges, _TEXT).repartition(len(ranges), "start")
    known = sorted(dealt.mapInPandas(_census, _TEXT + ", frames long, last string").collect(), key=lambda r: r.start)
    first, cell, rows = 0, None, []
    for r in known:
        rows.append((r.path, r.start, r.stop, first, cell))
        first, cell = first + r.frames, r.last or cell
    return spark.createDataFrame(rows, _TEXT + ", first long, cell string").repartition(len(rows), "start").mapInPandas(_parse, SCHEMA)


def numbered(atoms: DataFrame) -> DataFrame:
    """The atoms that have a serial."""
    return atoms.where("serial IS NOT NULL")


def format_serial(serial: Column) -> Column:
    """A serial in five columns: decimal up to 99999, then by digits of base 36 that begin with a letter (hybrid-36: A0000 is 100000, a0000 follows ZZZZZ)."""
    over = serial.cast("long") - _DECIMAL
    digits = lambda n: F.conv((n + 10 * 36**4).cast("string"), 10, 36)
    none = F.raise_error(F.concat(F.lit("a serial of more than five columns: "), serial.cast("string"))).cast("string")
    return F.when(over < 0, F.format_string("%5d", serial)).when(over < _CAPITAL, digits(over)).when(over < 2 * _CAPITAL, F.lower(digits(over - _CAPITAL))).when(serial.isNull(), "     ").otherwise(none)


def read_serial(text: Column) -> Column:
    """The number that format_serial wrote, as an int; null where there is none."""
    over = (F.conv(text, 36, 10).cast("long") - 10 * 36**4 + _DECIMAL).cast("int")
    return F.when(text.rlike("^[A-Z][0-9A-Z]{4}$"), over).when(text.rlike("^[a-z][0-9a-z]{4}$"), over + _CAPITAL).otherwise(text.try_cast("int"))


def atom_columns(line: Column) -> dict[str, Column]:
    """The fields of an atom line; numbers that can't be read are null."""
    cell = {k: F.substring(line, a + 1, b - a) for k, (a, b) in FIELDS.items()}
    kinds = {"serial": read_serial, **dict.fromkeys("xyz", lambda c: c.try_cast("double"))}
    return {k: kinds[k](F.trim(c)) if k in kinds else c if k in ("alt_loc", "chain", "icode") else F.trim(c) for k, c in cell.items()}


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines (line, and any other columns) of atoms with their fields; other records and atoms without three coordinates are left out."""
    atoms = lines.where(F.trim(F.substring("line", 1, 6)).isin("ATOM", "HETATM")).withColumns(atom_columns(F.col("line")))
    return atoms.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").drop("line")


def read_frames(spark: SparkSession, folder: str, pattern: str = "*.pdb") -> DataFrame:
    """The beads of a folder of one-frame files: frame is the first number in a file's name, which a name must have; line_no counts from 0."""
    whole = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("path"), "value")
    number = F.regexp_extract("path", r"(\d+)", 1)
    frame = F.when(number != "", number).otherwise(F.raise_error(F.concat(F.lit("no number in the name "), "path")).cast("string")).cast("long")
    return parse_lines(whole.select(frame.alias("frame"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")))


def cell_lengths(cryst1: Column) -> dict[str, Column]:
    """lx, ly, lz and the angles of a CRYST1 line; nulls where there is none."""
    at = {"lx": (7, 9), "ly": (16, 9), "lz": (25, 9), "alpha": (34, 7), "beta": (41, 7), "gamma": (48, 7)}
    return {k: F.trim(F.substring(cryst1, a, n)).try_cast("double") for k, (a, n) in at.items()}


def format_cryst1(lx: Column, ly: Column, lz: Column, alpha: float = 90.0, beta: float = 90.0, gamma: float = 90.0, group: str = "P 1", z: int = 1) -> Column:
    """A CRYST1 line."""
    return F.format_string("CRYST1%9.3f%9.3f%9.3f%7.2f%7.2f%7.2f %-11s%4d", lx, ly, lz, F.lit(alpha), F.lit(beta), F.lit(gamma), F.lit(group), F.lit(z))


def format_atom() -> Column:
    """An atom line of a row of SCHEMA; blank optional fields get their usual values."""
    text = lambda c, blank, width: F.lpad(F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", blank).otherwise(F.trim(c)), width, " ")
    one = lambda c: F.rpad(F.coalesce(c, F.lit("")), 1, " ")
    name = F.when(F.length(F.trim("name")) >= 4, F.trim("name")).otherwise(F.rpad(F.concat(F.lit(" "), F.trim("name")), 4, " "))
    head = F.concat(F.rpad("record", 6, " "), format_serial(F.col("serial")), F.lit(" "), F.rpad(name, 4, " "), one("alt_loc"), F.rpad(F.substring("res_name", 1, 4), 4, " "), one("chain"), F.lpad("res_seq", 4, " "), one("icode"))
    return F.concat(head, F.lit("   "), F.format_string("%8.3f%8.3f%8.3f", "x", "y", "z"), text("occupancy", "1.00", 6), text("temp_factor", "0.00", 6), F.lit(" " * 10), text("element", "  ", 2), text("charge", "  ", 2))


def pdb_lines(atoms: DataFrame, box: DataFrame) -> DataFrame:
    """frame, ord, line of each frame as PDB text: CRYST1 of its box, atoms by serial, END."""
    cell = box.select("frame", F.lit(-1).cast("long").alias("ord"), format_cryst1(F.col("lx"), F.col("ly"), F.col("lz")).alias("line"))
    body = atoms.select("frame", F.col("serial").cast("long").alias("ord"), format_atom().alias("line"))
    end = box.select("frame", F.lit(1 << 40).alias("ord"), F.lit("END").alias("line"))
    return cell.unionByName(body).unionByName(end)


def write_pdb(atoms: DataFrame, box: DataFrame, folder: str) -> None:
    """One text file per frame, under folder/frame=N."""
    lines = pdb_lines(atoms, box).repartition("frame").sortWithinPartitions("frame", "ord")
    lines.select("frame", "line").write.mode("overwrite").partitionBy("frame").text(folder)
