import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import clusters, graph


def brute_components(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


pairs = st.integers(1, 9).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)).filter(lambda e: e[0] < e[1]))))


@settings(max_examples=150, deadline=None)
@given(pairs)
def test_labels_and_bridges(case):
    n, edges = case
    edges = sorted(edges)
    a, b = (np.array([e[k] for e in edges], int) for k in (0, 1))
    assert graph._labels(n, a, b).tolist() == brute_components(n, edges)
    cut = graph.bridges(n, a, b)
    for k in range(len(edges)):
        rest = edges[:k] + edges[k + 1 :]
        assert cut[k] == (len(set(brute_components(n, rest))) > len(set(brute_components(n, edges))))


def triangles(spark, rows):
    return spark.createDataFrame([(0, "upper", i, *v) for i, v in enumerate(rows)], "frame long, side string, tri_id long, v0 long, v1 long, v2 long")


def test_fan_with_tail(spark):
    fan = [(0, i, i % 6 + 1) for i in range(1, 7)] + [(1, 2, 9)]
    left = graph.pruned_components(triangles(spark, fan)).toPandas()
    assert sorted(left.tri_id) == list(range(6)) and left["size"].unique().tolist() == [6]


def test_strip_has_only_bridges(spark):
    strip = [(i, i + 1, i + 2) for i in range(5)]
    assert graph.pruned_components(triangles(spark, strip)).count() == 0
    assert graph.bridge_edges(triangles(spark, strip)).count() == 4


def test_edge_of_three(spark):
    book = triangles(spark, [(0, 1, 2), (0, 1, 3), (0, 1, 4)])
    assert graph.adjacency(book).count() == 3
    assert graph.manifold_adjacency(book).count() == 0
    assert graph.components(book).select("component").distinct().count() == 1


def dedup(spark, rows, tolerance=10.0):
    c = spark.createDataFrame([(0, "upper", i, 1, a, x, y) for i, (a, x, y) in enumerate(rows)], "frame long, side string, cluster long, n long, area double, cx double, cy double")
    box = spark.createDataFrame([(0, 100.0, 100.0)], "frame long, lx double, ly double")
    mid = spark.createDataFrame([(0, "upper", 0.0, 0.0)], "frame long, side string, center_x double, center_y double")
    return sorted(r.cluster for r in clusters.deduplicate(c, box, mid, tolerance).collect())


def test_greedy_dedup(spark):
    assert dedup(spark, [(2.0, 0.0, 0.0), (1.0, 10.0, 0.0)]) == [0, 1]  # exactly the tolerance apart: both stay
    assert dedup(spark, [(3.0, 0.0, 0.0), (2.0, 8.0, 0.0), (1.0, 16.0, 0.0)]) == [0, 2]  # the middle goes, what it alone is near stays
    assert dedup(spark, [(2.0, -49.0, 0.0), (1.0, 49.0, 0.0)]) == [0, 1]  # no distance across the cell's faces
    assert dedup(spark, [(2.0, 0.0, 0.0), (1.0, 101.0, 0.0)]) == [0]  # wrapped onto the first
