"""k nearest by cubes and de-duplication by rounds against plain Python."""

import numpy as np
import pytest

from tessera.operators import clusters, spatial


def plain_nearest(b, p, k):
    out = set()
    for f, i, *q in b:
        far = sorted((sum((u - v) * (u - v) for u, v in zip(q, at, strict=True)), t) for g, t, *at in p if g == f)
        out |= {(f, i, t, r + 1) for r, (_, t) in enumerate(far[:k])}
    return out


@pytest.mark.parametrize("limits", [(4096, 16384, 200), (7, 11, 3)])
def test_k_nearest(spark, monkeypatch, limits):
    for name, v in zip(("BEADS", "POINTS", "DENSITY"), limits, strict=True):
        monkeypatch.setattr(spatial, name, v)
    rng = np.random.default_rng(4)
    sheet = [(0, i, float(x), float(y), float(2 * np.sin(x / 5))) for i, (x, y) in enumerate(rng.uniform(-30, 30, (400, 2)))]
    knot = [(1, i, 5.0, 5.0, 5.0) for i in range(60)] + [(1, 60 + i, float(x), 0.0, 0.0) for i, x in enumerate(rng.uniform(-1e4, 1e4, 40))]
    grid = [(2, i, float(i % 8), float(i // 8), 0.0) for i in range(64)]  # ties everywhere
    few = [(3, 9, 1.0, 1.0, 1.0), (3, 4, 2.0, 1.0, 1.0), (3, 5, float("nan"), 0.0, 0.0)]
    p = sheet + knot + grid + few
    b = [(0, i, *map(float, q)) for i, q in enumerate(rng.uniform(-40, 40, (60, 3)))] + [(1, i, *map(float, rng.normal(5, s, 3))) for i, s in enumerate([0.1, 1, 50, 3000] * 8)]
    b += [(2, i, float(i % 8), float(i // 8), 0.0) for i in range(64)] + [(3, 1, 0.0, 0.0, 0.0), (3, 2, 1e6, 1e6, -1e6), (4, 1, 0.0, 0.0, 0.0)]
    one = spark.createDataFrame(b, "frame long, bead long, x double, y double, z double")
    two = spark.createDataFrame(p, "frame long, tri long, x double, y double, z double")
    for k in (6, 48) if limits[0] > 7 else (6,):
        got = [(r.frame, r.bead, r.tri, r["rank"]) for r in spatial.k_nearest(one, two, k).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_nearest(b, [x for x in p if x[2] == x[2]], k)
    assert spatial.k_nearest(one, two.where("false"), 6).count() == 0 and spatial.k_nearest(one.where("false"), two, 6).count() == 0


def test_k_nearest_of_beads_far_off_a_sheet(spark, monkeypatch):
    """A dense sheet and beads far above it: cubes stay much smaller than the beads' distance, and chunks of few distances give the same."""
    rng = np.random.default_rng(6)
    p = [(0, i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(rng.uniform(0, 1, (20_000, 3)) * (80, 40, 2))]
    b = [(0, i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(np.concatenate([rng.uniform(0, 40, (20, 2)), rng.uniform(20, 60, (20, 1))], axis=1))]
    monkeypatch.setattr(spatial, "HELD", 4096)
    levels, write = [], spatial.written

    def written(df, name):
        out = write(df, name)
        if name == "nearest-found":
            levels.append(out.where("settled").agg({"level": "max"}).first()[0] or 0)
        return out

    monkeypatch.setattr(spatial, "written", written)
    near = spatial.k_nearest(spark.createDataFrame(b, "frame long, bead long, x double, y double, z double"), spark.createDataFrame(p, "frame long, tri long, x double, y double, z double"), 6)
    assert {(r.frame, r.bead, r.tri, r["rank"]) for r in near.collect()} == plain_nearest(b, p, 6)
    assert max(levels) < 3  # by the distance of the farthest beads it would be 4


def test_dedup_is_the_walk_in_order(spark):
    rng = np.random.default_rng(8)
    rows = [(f, s, i, int(rng.integers(1, 4)), float(rng.integers(1, 9)), float(x), float(y)) for f in range(2) for s in ("upper", "lower") for i, (x, y) in enumerate(rng.uniform(-148, 148, (300, 2)).round(0))]
    rows += [(2, "upper", i, 1, 1.0, 3.0, 3.0) for i in range(500)] + [(3, "upper", i, 1, float(i), 6.0 * i, 0.0) for i in range(12)]
    c = spark.createDataFrame(rows, "frame long, side string, cluster long, n long, area double, cx double, cy double")
    box = spark.createDataFrame([(f, 300.0, 300.0) for f in range(4)], "frame long, lx double, ly double")
    mid = spark.createDataFrame([(f, s, 0.0, 0.0) for f in range(4) for s in ("upper", "lower")], "frame long, side string, center_x double, center_y double")
    kept = {}
    for f, s, i, n, area, x, y in sorted(rows, key=lambda r: (-r[4], -r[3], r[2])):
        if all((x - u) ** 2 + (y - v) ** 2 >= 100 for u, v, _ in kept.get((f, s), [])):
            kept.setdefault((f, s), []).append((x, y, i))
    got = clusters.deduplicate(c, box, mid).collect()
    assert sorted((r.frame, r.side, r.cluster) for r in got) == sorted((*k, i) for k, v in kept.items() for *_, i in v)
    assert clusters.deduplicate(c.where("false"), box, mid).count() == 0 and clusters.deduplicate(c, box, mid, 0).count() == len(rows)


def test_components_of_points_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(9)
    rows = [(0, i, *map(float, q)) for i, q in enumerate(rng.permutation(np.stack([np.arange(150) * 7.9, np.zeros(150), np.zeros(150)], axis=1)))]  # a chain
    rows += [(1, i, *map(float, q)) for i, q in enumerate(rng.uniform(-40, 40, (250, 3)))] + [(2, i, 1.0, 1.0, 1.0) for i in range(300)] + [(2, 900, 9.0, 1.0, 1.0), (2, 901, 17.1, 1.0, 1.0), (2, 902, float("nan"), 1.0, 1.0)]
    rows += [(3, i, float(8 * (i % 6)), float(8 * (i // 6)), 0.0) for i in range(36)]  # all exactly a radius apart
    root = {}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for r in rows:
        root[r[:2]] = r[:2]
    for i, p in enumerate(rows):
        for q in rows[:i]:
            if p[0] == q[0] and sum((u - v) ** 2 for u, v in zip(p[2:], q[2:], strict=True)) <= 64:
                x, y = sorted((find(p[:2]), find(q[:2])))
                root[y] = x
    points = spark.createDataFrame(rows, "frame long, bead long, x double, y double, z double")
    got = spatial.point_components(points, 8.0)
    assert {(r.frame, r.bead, r.component) for r in got.collect()} == {(*r[:2], find(r[:2])[1]) for r in rows}
    assert spatial.point_components(points.where("false"), 8.0).count() == 0
