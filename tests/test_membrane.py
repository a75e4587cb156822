import shutil
from dataclasses import replace
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.plans import program
from tessera.plans.membrane import Analysis
from tessera.sources import ply, tables
from tessera.sources.config import Settings


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """Two frames of a flat bilayer with a hole of tail beads in the upper leaflet."""
    d = tmp_path_factory.mktemp("md")
    rng = np.random.default_rng(5)
    rows = []
    for frame in range(2):
        serial = 0
        for z, tail in ((20.0, 12.0), (-20.0, -12.0)):
            for i in range(11):
                for j in range(11):
                    serial += 1
                    x, y = 4.0 * i + rng.normal(0, 0.1), 4.0 * j + rng.normal(0, 0.1)
                    hole = z > 0 and abs(i - 5) <= 1 and abs(j - 5) <= 1
                    rows.append((frame, "ATOM", serial, "GL2", "POPC", x, y, z))
                    if not hole:
                        serial += 1
                        rows.append((frame, "ATOM", serial, "PO4", "POPC", x, y, z + np.sign(z) * 2))
                    serial += 1
                    rows.append((frame, "ATOM", serial, "C1A", "POPC", x, y, tail))
    atoms = spark.createDataFrame([(int(a), b, int(c), e, f, float(x), float(y), float(z)) for a, b, c, e, f, x, y, z in rows], "frame long, record string, serial int, name string, res_name string, x double, y double, z double")
    (d / "ff").mkdir()
    (d / "ff" / "ff.itp").write_text("; MARTINI FORCEFIELD V2.2\n[ moleculetype ]\nPOPC 1\n[ atoms ]\n1 Qa 1 POPC PO4 1 0\n2 C3 1 POPC GL2 2 0\n3 C1 1 POPC C1A 3 0\n[ nonbond_params ]\n" + "\n".join(f"{t} {t} 1 0.15091 0.16267E-02" for t in ("Qa", "C3", "C1")) + "\n")
    s = Settings(res_name=["POPC"], atom_name=["GL2"], custom_ff=f"file://{d}/ff", triangle_size=3.0, triangle_kd_tree=12, min_defect_size=1.0, max_defect_size=60.0)
    return Analysis(spark, s, f"file://{d}/out", atoms, smooth=4.0, grid=5)


def test_finds_the_hole(run):
    facts = run.table("facts").toPandas()
    upper = facts[facts.side == "upper"]
    assert set(upper.frame) == {0, 1}
    for _, own in upper.groupby("frame"):
        top = own.sort_values("area").iloc[-1]
        assert 30 < top.area < 250 and abs(top.cx - 20) < 4 and abs(top.cy - 20) < 4
    again = run.table("facts").toPandas()
    assert len(again) == len(facts)  # nothing is computed twice


def test_statistics(run, spark, tmp_path):
    out = run.summary()
    assert set(out) == {"fit", "counts", "coverage", "sizes", "histogram", "types", "layers", "layer_fit", "curvature", "curvature_fit"}
    assert out["coverage"].where("frame IS NULL").count() == 1
    assert set(out["layers"].toPandas().region_type) <= {"monolayer", "bilayer"}
    assert abs(out["curvature"].toPandas().h).max() < 0.2
    path = f"file://{tmp_path}/clusters"
    tables.write_clusters(run.table("facts"), path)
    back = tables.cluster_rows(spark, path)
    assert back.count() == run.table("facts").count() and back.where("side = 'other'").count() == 0
    assert tables.cluster_areas(spark, path).count() == back.count()
    with pytest.raises(ValueError):
        tables.region_areas(spark, path)


def test_level_sets_in_the_run(run, spark, tmp_path):
    (tmp_path / "ff").mkdir()
    (tmp_path / "ff" / "ff.itp").write_text((Path(run.settings.custom_ff.removeprefix("file://")) / "ff.itp").read_text())
    folded = Analysis(spark, replace(run.settings, custom_ff=f"file://{tmp_path}/ff"), f"file://{tmp_path}/out", run._atoms, grid=5, reach=12.0)
    m = folded.table("mesh").toPandas()
    assert set(zip(m.frame, m.side)) == {(f, s) for f in range(2) for s in ("upper", "lower")}
    up = m[m.side == "upper"]
    assert (up.nz > 0.9).all() and (m[m.side == "lower"].nz < -0.9).all() and abs(up.az.mean() - 20) < 1
    assert abs(m.groupby(["frame", "side"]).area.mean() / 3 - 1).max() < 0.2
    facts = folded.table("facts").toPandas()
    assert set(facts[facts.side == "upper"].frame) == {0, 1}
    assert abs(folded.table("vertex_h").toPandas().h).median() < 0.05


def test_publishes_files(run, spark, tmp_path):
    out = f"file://{tmp_path}/res"
    wrote = program.publish(run, out)
    assert {w.removeprefix(f"{out}/") for w in wrote} >= {"boxes.csv", "atoms.csv", "clusters.csv", "layers.csv", "curvature.csv", "report", "summary/curvature_fit"}
    text = "\n".join(r.value for r in spark.read.text(f"{out}/report").collect())
    assert "coverage, all frames" in text and "surfaces" in text
    facts, mesh = run.table("pruned").toPandas(), run.table("mesh").toPandas()
    for kind, rows in (("clusters_ply", facts), ("defects_ply", facts), ("curvature_ply", mesh)):
        for (frame, side), own in rows.groupby(["frame", "side"]):
            files = list((tmp_path / "res" / kind / f"frame={frame}" / f"side={side}").glob("*.txt"))
            assert len(files) == 1
            verts, tris = ply.read_ply(files[0].read_text())
            assert len(tris) == len(own) and tris.max() == len(verts) - 1
            m = mesh[(mesh.frame == frame) & (mesh.side == side)].set_index("tri_id").loc[sorted(own.tri_id)]
            assert np.allclose(verts[tris[:, 0]], m[["ax", "ay", "az"]], rtol=1e-4, atol=1e-4) and np.allclose(verts[tris[:, 2]], m[["cx_", "cy_", "cz_"]], rtol=1e-4, atol=1e-4)
    before = {w: spark.read.text(w).count() for w in wrote if w.endswith(".csv")}
    program.publish(run, out)
    assert before == {w: spark.read.text(w).count() for w in wrote if w.endswith(".csv")}


def test_damaged_frames_are_done_again(run, spark, tmp_path):
    want = {n: run.table(n).toPandas() for n in ("raw", "classes")}
    base = tmp_path / "copy"
    shutil.copytree(Path(run.folder.removeprefix("file://")), base / Path(run.folder).name)
    again = lambda: Analysis(spark, run.settings, f"file://{base}", run._atoms, smooth=4.0, grid=5)
    own = base / Path(run.folder).name
    log = lambda n: spark.read.parquet(f"file://{own}/done/{n}").count()
    assert again().folder == f"file://{own}" and again().table("classes").count() == len(want["classes"]) and log("classes") == 2
    files = sorted((own / "classes").glob("batch=*/*.parquet"))
    hit = [f for f in files if spark.read.parquet(f"file://{f}").where("frame = 1").count()][0]
    frames = {r.frame for r in spark.read.parquet(f"file://{hit}").select("frame").distinct().collect()}
    hit.write_bytes(hit.read_bytes()[: hit.stat().st_size // 2])
    for f in (own / "raw").glob("batch=*/*"):
        f.unlink()  # files that are gone: both frames
    later = again()
    for name in ("raw", "classes"):
        got = later.table(name).toPandas()
        cols = sorted(got.columns)
        order = lambda d: d[cols].sort_values(["frame", "side", "tri_id"]).reset_index(drop=True)  # noqa: E731, B023
        pd.testing.assert_frame_equal(order(got), order(want[name]))
        assert log(name) == 4  # both frames have new entries: done again, or moved out of the damaged batch
    seen = spark.read.parquet(f"file://{own}/done/classes").groupBy("frame").agg(F.count_distinct("digest").alias("n")).collect()
    assert {r.frame: r.n for r in seen} == {0: 1, 1: 1} and frames <= {0, 1}
    assert len(again().table("classes").toPandas()) == len(want["classes"]) and log("classes") == 4


def test_settings_file_frames_and_resume(run, spark, tmp_path):
    (tmp_path / "run.conf").write_text("input: file:///no/where.pdb\nresume_from = 6  # pruning\ncurvature_frames: 1-1\nclusters_per_frame: off\n")
    s = program.read_settings(spark, f"file://{tmp_path}/run.conf")
    assert (s.resume_from, s.curvature_frames, s.cluster_count) == (6, "1-1", False)
    later = Analysis(spark, replace(run.settings, resume_from=6), str(Path(run.folder).parent).replace("file:/", "file:///"), run._atoms, smooth=4.0, grid=5)
    assert later.folder == run.folder and later.table("facts").count() == run.table("facts").count()  # the same tables
    fresh = Analysis(spark, replace(run.settings, resume_from=3), f"file://{tmp_path}/fresh", run._atoms, smooth=4.0, grid=5)
    with pytest.raises(ValueError, match="step"):
        fresh.table("mesh")
    some = Analysis(spark, replace(run.settings, curvature_frames="1-1"), f"file://{tmp_path}/some", run._atoms, smooth=4.0, grid=5)
    some._ready["mesh"] = run.table("mesh")
    assert {r.frame for r in some._vertex_h().select("frame").distinct().collect()} == {1}
