import pytest

from tessera.operators import clusters, coverage

TRI = "frame long, tri long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"
BEAD = "frame long, bead long, x double, y double, z double, radius double, flag string"


def judge(spark, beads, tri=(0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)):
    t = spark.createDataFrame([(0, 0, *tri)], TRI)
    b = spark.createDataFrame([(0, i, *x) for i, x in enumerate(beads)], BEAD)
    near = b.selectExpr("frame", "0L AS tri", "bead")
    return coverage.classify(t, b, near).first(), coverage.head_veto(t, b, near).count()


def test_modes_and_types(spark):
    r, left = judge(spark, [])
    assert (r["mode"], r.defect_type, r.is_defect, r.total_fraction, left) == (3, 0, True, 0.0, 1)
    r, left = judge(spark, [(1.0, 0.0, 5.0, 0.01, "h")])
    assert (r["mode"], r.is_defect, left) == (1, False, 0) and r.head_fraction == pytest.approx(1 / 231)
    r, left = judge(spark, [(0.3, 0.3, 31.0, 2.0, "n")])
    assert (r.n_candidates, r.n_after_slab, r.is_defect, left) == (1, 0, True, 1)
    r, _ = judge(spark, [(0.3, 0.3, 1.0, 2.0, "t"), (0.3, 0.3, 2.0, 2.0, "n")])
    assert (r.defect_type, r.n_used, r.total_fraction) == (1, 2, 1.0)
    r, left = judge(spark, [(0.3, 0.3, 1.0, 2.0, "t")], (0.0,) * 9)
    assert (r["mode"], r.is_defect, left) == (0, False, 0)


def test_beads_must_be_known(spark):
    b = spark.createDataFrame([("POPC", "GL1"), ("POPC", "XX")], "res_name string, atom_name string")
    a = spark.createDataFrame([("POPC", "GL1", "h", 2.6)], "res_name string, atom_name string, flag string, radius double")
    assert coverage.bead_table(b.limit(1), a).first().flag == "h"
    with pytest.raises(Exception, match="no such bead"):
        coverage.bead_table(b, a).collect()


def sheets(spark, gap):
    rows = [(0, s, i, float(i), 0.0, z, 0.0, 0.0, n) for s, z, n in (("upper", gap, 1.0), ("lower", 0.0, -1.0)) for i in range(5)]
    return spark.createDataFrame(rows, "frame long, side string, tri_id long, cx double, cy double, cz double, nx double, ny double, nz double")


@pytest.mark.parametrize(("gap", "kind", "share"), [(30.0, "bilayer", 1.0), (60.0, "monolayer", 0.0)])
def test_layers(spark, gap, kind, share):
    t = sheets(spark, gap)
    found = clusters.layers(t.selectExpr("frame", "side", "0L AS cluster", "tri_id"), clusters.apposition(t)).collect()
    assert len(found) == 2 and all((r.region_type, r.paired_fraction) == (kind, share) for r in found)
