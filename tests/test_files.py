import pytest

from tessera.operators import colors, tiling, trim
from tessera.plans import files  # noqa: F401
from tessera.sources import config, logs, pdb

_TRI = "frame long, side string, tri_id long, v0 long, v1 long, v2 long, cx double, cy double, cz double"


def test_box_table_is_built_once(spark, tmp_path):
    path, calls = f"file://{tmp_path}/boxes", []
    box = spark.createDataFrame([(1, 2.0, 3.00004, 4.0), (0, 1.0, 2.0, 3.0)], "frame long, lx double, ly double, lz double")
    build = lambda: calls.append(1) or box
    for _ in range(2):
        assert sorted(map(tuple, logs.boxes_or_build(spark, path, build).collect())) == [(0, 1.0, 2.0, 3.0), (1, 2.0, 3.0, 4.0)]
    assert calls == [1]
    (tmp_path / "bad.csv").write_text("frame,X(AA),Y(AA),Z(AA)\n0,1.0,x,3.0\n")
    with pytest.raises(Exception, match="malformed|MALFORMED"):
        logs.boxes_or_build(spark, f"file://{tmp_path}/bad.csv", build).collect()
    (tmp_path / "empty.csv").write_text("frame,X(AA),Y(AA),Z(AA)\n")
    with pytest.raises(ValueError, match="no frames"):
        logs.boxes_or_build(spark, f"file://{tmp_path}/empty.csv", build)


def test_atom_table_file(spark, tmp_path):
    path = f"file://{tmp_path}/atoms"
    rows = spark.createDataFrame([("POPC", "GL2", "Na", 2.6, "H"), ("DOPE", "C1,A", "C1", 2.4, "t")], "res_name string, atom_name string, bead_type string, radius double, flag string")
    logs.write_atom_table(rows, path)
    assert sorted(map(tuple, logs.read_atom_table(spark, path).collect())) == [("DOPE", "C1,A", "t", 2.4), ("POPC", "GL2", "h", 2.6)]
    unknown = spark.createDataFrame([("X", "Y", "UNKNOWN", None, "h")], rows.schema)
    with pytest.raises(Exception, match="no radius"):
        logs.parse_atom_lines(logs.atom_lines(unknown)).collect()


def test_folder_of_frames(spark, tmp_path):
    line = "ATOM  {:>5} GL2  POPC    1    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00\n"
    (tmp_path / "frame_10.pdb").write_text("CRYST1\n" + line.format(1, 1, 2, 3) + line.format("***", 4, 5, 6) + "END\n")
    (tmp_path / "frame_2.pdb").write_text(line.format(1, 7, 8, 9).replace("9.000", "nan!!"))
    got = pdb.read_frames(spark, f"file://{tmp_path}").orderBy("line_no").collect()
    assert [(r.frame, r.line_no, r.serial, r.x) for r in got] == [(10, 1, 1, 1.0), (10, 2, None, 4.0)]
    assert pdb.numbered(pdb.read_frames(spark, f"file://{tmp_path}")).count() == 1


def test_reports():
    assert logs.sections(["a\n", "", None, "\nb"]) == "a\n" + "-" * 60 + "\nb\n"
    text = logs.timings({1: 60.0}, {1: "tables", 2: "tiles"}).splitlines()
    assert text[4].split() == ["1", "tables", "60.000", "1.000"] and text[-1].split() == ["total", "60.000", "1.000"] and set(text[-2]) == {"-"}


def test_settings_and_windows(spark):
    with pytest.raises(ValueError):
        config.read_settings("model: CG\nno separator here")
    for scale in (0.0, -1.0, 3.5):
        with pytest.raises(ValueError):
            tiling.cut(None, None, scale)
    assert colors.rgb("#f218bc") == (242 / 255, 24 / 255, 188 / 255)


def test_trim_both(spark):
    """Two flat leaflets of 4 triangles in a row: only the middle ones have no open edge once all share a ring."""
    def leaf(side, z):
        return [(0, side, k, k, k + 1, k + 2, k + 0.5, 0.5, z) for k in range(4)]

    mesh = spark.createDataFrame(leaf("upper", 10.0) + leaf("lower", -10.0), _TRI)
    frame = [(0, x, y, 0.0) for x in (-9.0, 9.0) for y in (-9.0, 9.0)]
    kinds = "frame long, x double, y double, z double"
    held = spark.createDataFrame([*frame, (0, 0.5, 0.5, 0.0), (0, 1.5, 0.5, 10.0), (0, 2.5, 0.5, 11.0)], kinds)
    got = {(r.side, r.tri_id) for r in trim.trim_both(mesh, held).collect()}
    assert got == {("upper", 0), ("upper", 1), ("lower", 0), ("lower", 1)}
    # all would go, or nothing is known of the frame: nothing goes
    for atoms in (spark.createDataFrame(frame, kinds), spark.createDataFrame([], kinds)):
        assert trim.trim_both(mesh, atoms).count() == 8
    with pytest.raises(ValueError, match="out of range"):
        trim.validate(spark.createDataFrame([(0, "upper", 99)], "frame long, side string, tri_id long"), mesh, spark.createDataFrame([(0, "upper", 1)], "frame long, side string, vid long"))
