import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import mesh, tiling
from tessera.sources import config, forcefield, pdb, ply
from tessera.streaming import resume


def atom(serial, x, record="ATOM", res="POPC"):
    return f"{record:<6}{serial:5d} {' GL1':<4} {res:<4}A{1:4d}    {x:8.3f}{0:8.3f}{0:8.3f}  1.00  0.00"


TEXT = "\n".join(["REMARK only a header", "END", "CRYST1   10.000   20.000   30.000  90.00  90.00  90.00 P 1           1", atom(1, 1), atom(2, 2, "HETATM"), "END", "MODEL 2", atom(1, 3), "ATOM  broken", "ENDMDL", "END", atom(1, 4)]) + "\n"


@pytest.mark.parametrize("size", [7, 64, 100, 1 << 20])
def test_frames_of_any_ranges(spark, tmp_path, size):
    (tmp_path / "t.pdb").write_text(TEXT)
    rows = pdb.read_pdb(spark, f"file://{tmp_path}/t.pdb", size).orderBy("frame", "line_no").collect()
    assert [(r.frame, r.x, r.record) for r in rows] == [(0, 1.0, "ATOM"), (0, 2.0, "HETATM"), (1, 3.0, "ATOM"), (2, 4.0, "ATOM")]
    assert all(r.cryst1.startswith("CRYST1") for r in rows)
    c = pdb.read_pdb(spark, f"file://{tmp_path}/t.pdb", size).select(*[v.alias(k) for k, v in pdb.cell_lengths(F.col("cryst1")).items()]).first()
    assert (c.lx, c.ly, c.lz, c.gamma) == (10, 20, 30, 90)


def test_pdb_round_trip(spark, tmp_path):
    (tmp_path / "t.pdb").write_text(TEXT)
    rows = pdb.read_pdb(spark, f"file://{tmp_path}/t.pdb")
    box = tiling.fallback_box(rows)
    lines = pdb.pdb_lines(rows, box).orderBy("frame", "ord")
    (tmp_path / "u.pdb").write_text("\n".join(r.line for r in lines.collect()) + "\n")
    again = pdb.read_pdb(spark, f"file://{tmp_path}/u.pdb")
    cols = ["frame", "record", "serial", "name", "res_name", "x", "y", "z"]
    assert sorted(map(tuple, again.select(*cols).collect())) == sorted(map(tuple, rows.select(*cols).collect()))
    pdb.write_pdb(rows, box, f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").where("value LIKE 'CRYST1%'").count() == 3


def test_force_fields(spark, tmp_path):
    (tmp_path / "a.itp").write_text("; MARTINI FORCEFIELD V2.2\n[ moleculetype ]\n; name n\nPOPC 1\n[ atoms ]\n1 Q0 1 POPC NC3 1 1.0\n2 C1 1 POPC C1A 2 0 ; tail\n2 C2 1 POPC C1A 2 0\n3 Na 1 POPC short\n[ nonbond_params ]\nC1 C1 1 0.15091 0.16267E-02\nC1 Q0 1 0.1 0.1\n")
    (tmp_path / "b.ITP").write_text(";;;;; Martini 3 Force Field: Particle definition\n[ moleculetype ]\nPOPC 1\n[ atoms ]\n1 XX 1 POPC NC3 1 0\n[nonbond_params]\nC1 C1 1 0.30 3.5\nP1 P1 1 0.47 3.5\n")
    types = {(r.res, r.atom): r.type for r in forcefield.type_table(spark, f"file://{tmp_path}").collect()}
    assert types == {("POPC", "NC3"): "Q0", ("POPC", "C1A"): "C2"}
    radii = {r.type: r.radius for r in forcefield.radius_table(spark, f"file://{tmp_path}").collect()}
    assert radii["P1"] == pytest.approx(2.6378, abs=1e-4) and radii["C1"] == pytest.approx(5 * 2 ** (1 / 6) * 0.47, rel=1e-3)
    (tmp_path / "c.lib").write_text('!entry.PC.unit.atoms table\n "N31" "NA" 0 1\n!entry.PC.unit.connect array\n "X" "Y"\n')
    (tmp_path / "d.prepc").write_text("PC  XYZ 0\n 1 DUMM DU M\n 4 C21 cA M\n 5 N31 zz M\nloop\n")
    (tmp_path / "e.dat").write_text("H1 1.0\nMOD4 RE\nNA 1.82 0.17\nbad x\n")
    assert {(r.res, r.atom): r.type for r in forcefield.type_table(spark, f"file://{tmp_path}", "AA").collect()} == {("PC", "N31"): "NA", ("PC", "C21"): "cA"}
    assert {r.type: r.radius for r in forcefield.radius_table(spark, f"file://{tmp_path}", "AA").collect()} == {"NA": 1.82}


def test_tile_and_cut(spark):
    a = spark.createDataFrame([(0, i, float(x), 0.0, 0.0) for i, x in enumerate((0, 5, 10))], "frame long, bead long, x double, y double, z double")
    box = spark.createDataFrame([(0, 10.0, 10.0, 10.0)], "frame long, lx double, ly double, lz double")
    tiled = tiling.tile(a, box)
    assert tiled.count() == 27 and tiled.where("i = 0 AND j = 0").count() == 3
    xs = sorted(r.x for r in tiling.cut(tiled, box).where("j = 0").collect())
    assert xs == [0, 0, 5, 10, 10]
    edge = tiling.cut(tiling.tile(a.withColumn("x", F.when(F.col("x") == 5, 7.5).otherwise(F.col("x"))), box), box).where("j = 0")
    assert edge.where("x = -2.5").count() == 1  # the window's end is in it
    assert [r.serial for r in tiling.renumber(a, ["bead"]).orderBy("bead").collect()] == [1, 2, 3]


def test_config():
    s = config.Settings.parse("input: a.pdb # c\ntriangle_area = 2.5\nneutral: TAG, CHOL\nfitting: off\nodd: 1\nverbose: on\n")
    assert (s.input, s.triangle_size, s.neutral, s.fitting, s.verbose) == ("a.pdb", 2.5, ["TAG", "CHOL"], False, True)
    assert config.frame_range("2-5") == (2, 5) and config.frame_range("all") is None
    with pytest.raises(ValueError):
        config.as_bool("maybe")


def test_meshes(spark):
    rng = np.random.default_rng(1)
    flat = [(0, "upper", *p, 3.0) for p in rng.uniform(0, 40, (300, 2)).tolist()]
    m = mesh.surfaces(spark.createDataFrame(flat, "frame long, side string, x double, y double, z double"), 2.0).toPandas()
    assert np.allclose(m[["az", "bz", "cz_"]], 3.0)
    c = np.cross(m[["bx", "by_", "bz"]].to_numpy() - m[["ax", "ay", "az"]].to_numpy(), m[["cx_", "cy_", "cz_"]].to_numpy() - m[["ax", "ay", "az"]].to_numpy())
    assert (c[:, 2] > 0).all() and np.linalg.norm(c, axis=1).mean() / 2 == pytest.approx(2.0, rel=0.15)
    oct_v = np.array([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]], float)
    oct_t = np.array([[0, 2, 4], [2, 1, 4], [1, 3, 4], [3, 0, 4], [2, 0, 5], [1, 2, 5], [3, 1, 5], [0, 3, 5]])
    v, t = mesh.subdivide(oct_v, oct_t, 4)
    v = 5 * v / np.linalg.norm(v, axis=1, keepdims=True)
    assert len(t) == 8 * 4**4
    assert np.nanmedian(mesh.vertex_curvature(v, t)) == pytest.approx(-1 / 5, rel=0.02)
    lv, lt = mesh.subdivide(oct_v, oct_t, 2, loop=True)
    assert len(lt) == 128 and np.linalg.norm(lv, axis=1).std() < 0.1
    v2, t2 = ply.read_ply(ply.ply_text(v, t, colors=np.ones((len(v), 3)), quality=np.zeros(len(v))))
    assert np.allclose(v2, v, atol=1e-4) and (t2 == t).all()
    h = mesh.curvatures(spark.createDataFrame(m)).toPandas()
    assert len(h) and abs(h.h).max() < 1e-6


def test_growing_trajectory(spark, tmp_path):
    src, out, ck = (f"file://{tmp_path}/{d}" for d in ("src", "out", "ck"))
    rows = lambda a, b: spark.range(a, b).selectExpr("id AS frame", "id * 2.0D AS v")
    rows(0, 3).write.parquet(src)
    go = lambda: resume.grow(spark, src, "frame long, v double", out, ck, ["frame"], lambda d: d)
    assert go() == 3
    rows(2, 6).write.mode("append").parquet(src)
    assert go() == 6 and go() == 6  # frame 2 came twice and is there once
    assert resume.pending(rows(0, 9).select("frame"), spark.read.parquet(out), ["frame"]).count() == 3


def test_serials_past_five_digits(spark, tmp_path):
    serials = [1, 99999, 100000, 100239, 43770015, 43770016, 87440031]
    rows = spark.createDataFrame([(0, "ATOM", n, "GL1", "POPC", float(i), 0.0, 0.0) for i, n in enumerate(serials)], "frame long, record string, serial int, name string, res_name string, x double, y double, z double")
    for c in ("alt_loc", "chain", "res_seq", "icode", "occupancy", "temp_factor", "element", "charge"):
        rows = rows.withColumn(c, F.lit("1" if c == "res_seq" else " "))
    lines = pdb.pdb_lines(rows, tiling.fallback_box(rows)).orderBy("frame", "ord")
    assert [r.line[6:11] for r in lines.where("line LIKE 'ATOM%'").collect()] == ["    1", "99999", "A0000", "A006N", "ZZZZZ", "a0000", "zzzzz"]
    assert [(r.serial, r.x) for r in pdb.parse_lines(lines).orderBy("x").collect()] == [(n, float(i)) for i, n in enumerate(serials)]
    path = tmp_path / "wide.pdb"
    path.write_text("\n".join(r.line for r in lines.collect()) + "\n" + atom(1, 50.0).replace("    1 ", "***** ", 1) + "\n")
    assert [(r.serial, r.x) for r in pdb.read_pdb(spark, f"file://{path}").orderBy("x").collect()] == [*[(n, float(i)) for i, n in enumerate(serials)], (None, 50.0)]


def test_cut_goes_by_the_middle_of_places_as_given(spark):
    a = spark.createDataFrame([(0, i, x, 0.0, 0.0) for i, x in enumerate((0.0004, 7.5, 10.0))], "frame long, bead long, x double, y double, z double")
    box = spark.createDataFrame([(0, 10.0, 10.0, 10.0)], "frame long, lx double, ly double, lz double")
    # the window begins at 5.0002 - 7.5, not at -2.5 as it would by rounded places
    assert sorted(r.x for r in tiling.cut(tiling.tile(a, box), box).where("j = 0").collect()) == [0.0, 0.0, 7.5, 10.0, 10.0]
