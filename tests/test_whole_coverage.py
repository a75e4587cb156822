"""The coverage queries of the whole job against brute force over all triangles, 48 candidates and 231 samples."""

import numpy as np
import pytest

from tessera.plans import catalog
from tessera.plans.proxies import view

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def brute(spark):
    """Each bead's nearest triangles, and each triangle's row."""
    f, b = view(spark, SMALL, "facets").toPandas(), view(spark, SMALL, "beads").toPandas()
    frame, low = f.frame.to_numpy() % 5, np.floor(f.ay / 40) * 40
    corners = [np.stack([f[x] * 2 - 40, f[y] - low - 20, f[z] * 2 - 4], axis=1) for x, y, z in (("ax", "ay", "az"), ("bx", "by_", "bz"), ("cx_", "cy_", "cz_"))]
    samples = [(j / 20, (20 - i - j) / 20) for i in range(21) for j in range(21 - i)]
    assert len(samples) == 231
    mids = sum(corners) / 3
    near, rows = set(), {t: {"n_candidates": 0, "n_after_slab": 0, "n_used": 0, "h": set(), "t": set(), "n": set(), "top": (-np.inf, 0, "t")} for t in f.tri_id}
    for q in b.itertuples():
        p = np.array([q.x, q.y, q.z])
        own = np.flatnonzero(frame == q.frame)
        d2 = ((mids[own] - p) ** 2).sum(axis=1)
        for rank, (i, d) in enumerate(sorted(zip(own, d2), key=lambda x: (round(x[1], 9), f.tri_id[x[0]]))[:48]):
            near.add((q.frame, q.bead, f.tri_id[i], rank + 1))
            r, (a, c, e) = rows[f.tri_id[i]], (x[i] for x in corners)
            r["n_candidates"] += 1
            n = np.cross(c - a, e - a)
            n /= np.linalg.norm(n)
            depth = (p - a) @ n
            if abs(depth) > 30:
                continue
            r["n_after_slab"] += 1
            foot = p - depth * n
            hit = {s for s, (wb, wc) in enumerate(samples) if ((a + wb * (c - a) + wc * (e - a) - foot) ** 2).sum() <= q.radius**2}
            r["n_used"] += bool(hit)
            r[q.flag] |= hit
            if hit and q.flag != "h":
                r["top"] = max(r["top"], (depth, -q.bead, q.flag))
    return f, near, rows


def test_whole_knn(spark, brute):
    f, near, _ = brute
    got = catalog.QUERIES["knn_join_whole"](spark, SMALL).collect()
    assert {(r.frame, r.bead, r.tri, r["rank"]) for r in got} == near and len(got) == len(near)
    assert {r.tri for r in got} - set(f.tri_id[f.defect]) and max(r["rank"] for r in got) == min(48, (f.frame % 5).value_counts().max())


def test_knn_join_takes_all_triangles(spark, brute):
    f, near, _ = brute
    got = catalog.QUERIES["knn_join"](spark, SMALL).collect()
    assert {(r.frame, r.bead, r.tri, r["rank"]) for r in got} == {x for x in near if x[3] <= catalog.NEAREST} and len(got) == len(set(got))
    assert {r.tri for r in got} - set(f.tri_id[f.defect]) and "WHERE defect" not in catalog.SQL["knn_join"]


def test_whole_coverage(spark, brute):
    f, _, rows = brute
    got = {r.tri: r for r in catalog.QUERIES["coverage_classify_whole"](spark, SMALL).collect()}
    assert set(got) == set(f.tri_id)
    for t, want in rows.items():
        r = got[t]
        assert (r.n_candidates, r.n_after_slab, r.n_used) == (want["n_candidates"], want["n_after_slab"], want["n_used"])
        share = [round(len(x) / 231, 6) for x in (want["h"], want["t"] | want["n"], want["h"] | want["t"] | want["n"])]
        assert [r.head_fraction, r.other_fraction, r.total_fraction] == share
        kind = want["top"][2] if len(want["n"]) == len(want["t"]) else "n" if len(want["n"]) > len(want["t"]) else "t"
        assert (r["mode"], r.defect_type, r.is_defect) == (1 if want["h"] else 3, int(kind == "n"), not want["h"])
    veto = {r.tri for r in catalog.QUERIES["head_veto_antijoin_whole"](spark, SMALL).collect()}
    assert veto == {t for t, r in got.items() if r.is_defect}
