import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import beads, geometry
from tessera.operators import stats


def areas(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "area double")


def test_histogram_edges(spark):
    rows = {r.mid: (r.n, r.p) for r in stats.histogram(areas(spark, [5.7, 0.4, 1.0, 1.49, 1.5])).collect()}
    assert rows == {1.0: (2, 2 / 3), 2.0: (1, 1 / 3), 3.0: (0, 0.0), 4.0: (0, 0.0), 5.0: (0, 0.0)}


def test_histogram_of_small_values(spark):
    (r,) = stats.histogram(areas(spark, [0.7])).collect()
    assert (r.mid, r.n, r.p) == (0.85, 1, 1.0)


def test_histogram_takes_finite_positive_values(spark):
    assert stats.histogram(areas(spark, [math.nan, math.inf, -1, 0])).count() == 0
    assert sum(r.n for r in stats.histogram(areas(spark, [math.nan, math.inf, -1, 0, 1, 2])).collect()) == 2


def test_fit_of_an_exponential(spark):
    hist = spark.range(1, 101).select(F.col("id").cast("double").alias("mid"), F.exp(-F.col("id") / 20).alias("p"))
    r = stats.fit(hist, 1, 100, None).first()
    assert r.pi == pytest.approx(20) and r.slope == pytest.approx(-0.05) and r.r2 == pytest.approx(1)


def test_fit_of_a_constant(spark):
    hist = spark.createDataFrame([(float(i), 0.25) for i in range(1, 5)], "mid double, p double")
    r = stats.fit(hist, 0, 9, None).first()
    assert math.isnan(r.pi) and math.isnan(r.r2) and r.slope == 0


def test_fit_needs_bins_and_a_window(spark):
    hist = spark.createDataFrame([(1.0, 0.5), (2.0, 0.5)], "mid double, p double")
    assert stats.fit(hist, 0, 9, None).count() == 0
    with pytest.raises(Exception, match="fewer than 3"):
        stats.fit(hist, 0, 9, None, strict=True).collect()
    with pytest.raises(ValueError):
        stats.fit(hist, 9, 9, None)
    with pytest.raises(ValueError):
        stats.fit(hist, 0, 9, 2.0)


def test_segments(spark):
    c = spark.createDataFrame([(1.0, h) for h in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)], "area double, h double")
    got = [r.segment for r in stats.curvature_segments(c).orderBy("h").collect()]
    assert got[:3] == [1, 2, 3] and got[-2:] == [5, 5]
    with pytest.raises(ValueError):
        stats.curvature_segments(c.withColumn("h", F.lit(1.0)))


def test_sides(spark):
    c = spark.createDataFrame([(0, "upper:0", 1.0), (0, "lower:1", 2.0), (0, "foo:2", 4.0)], "frame long, cluster string, area double").withColumn("side", stats.cluster_side(F.col("cluster")))
    r = stats.clusters_per_frame(c).first()
    assert (r.upper, r.lower, r.total) == (1, 1, 3)
    box = spark.createDataFrame([(0, 10.0, 10.0)], "frame long, lx double, ly double")
    assert {r.frame: r.total for r in stats.coverage(c, box).collect()} == {0: 1.5, None: 1.5}
    with pytest.raises(Exception, match="no box"):
        stats.coverage(c, box.where("frame = 9")).collect()


def test_wrap_and_flags(spark):
    one = spark.range(1)
    assert one.select(geometry.wrap(F.lit(-7.5), F.lit(0.0), F.lit(10.0)).alias("w")).first().w == 2.5
    flags = spark.createDataFrame([("SC1",), ("C1",), ("UNKNOWN",)], "t string").select(beads.bead_flag(F.lit("POPC"), F.col("t"), set()).alias("f"))
    assert [r.f for r in flags.collect()] == ["h", "t", "h"]
    assert one.select(beads.bead_flag(F.lit("TAG"), F.lit("C1"), {"TAG"}).alias("f")).first().f == "n"
    assert one.select(beads.radius_from_sigma(F.lit(0.47)).alias("r")).first().r == pytest.approx(2.6378, abs=1e-4)
    assert len(geometry.barycentric_grid(21)) == 231 and all(abs(sum(w) - 1) < 1e-12 for w in geometry.barycentric_grid(21))
