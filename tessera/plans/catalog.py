"""All queries by name over the proxy views, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import beads as bead_functions
from tessera.functions import geometry as geo
from tessera.operators import clusters as cl
from tessera.operators import coverage as cov
from tessera.operators import graph, spatial, stats, tiling
from tessera.plans.proxies import sql, view
from tessera.plans.ship import ship
from tessera.sources import merges
from tessera.streaming import resume

#: Window and least probability of the fits.
LOW, HIGH, LEAST_P = 15.0, 250.0, 1e-4
#: Points of the sampling grid and candidates per bead in the coverage queries; cutoffs of the spatial ones.
GRID, NEAREST, CUTOFF, PAIRING = 5, 6, 8.0, 6.0
#: Candidates per bead in the queries of the whole job, whose grid is cov.GRID.
WHOLE_NEAREST = 48

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(body: str | None = None, needs: tuple[str, ...] = ()):
    """Registers a query and, given its body, its SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, lambda name: view(spark, sf_dir, name))

        run.__doc__ = f.__doc__
        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if body:
            SQL[f.__name__] = sql(needs, body)
        return f

    return register


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _pooled(df: DataFrame) -> DataFrame:
    """frame as text, the row that pools all frames named so."""
    return df.withColumn("frame", F.coalesce(F.col("frame").cast("string"), F.lit("all")))


def _hist_sql(by: str = "", rows: str = "clusters") -> str:
    b = f"{by}, " if by else ""
    on = f"AND m.{by} = v.{by}" if by else ""
    return f""", v AS (SELECT {b}area FROM {rows} WHERE isfinite(area) AND area > 0),
m AS (SELECT {b}max(area) AS vmax, CAST(floor(max(area)) AS BIGINT) AS nb FROM v {"GROUP BY " + by if by else ""}),
c AS (SELECT {"v." + by + ", " if by else ""}CASE WHEN nb = 0 THEN 0 ELSE least(CAST(floor(area - 0.5) AS BIGINT), nb - 1) END AS bin, count(*) AS n FROM v JOIN m ON true {on}
      WHERE nb = 0 OR area >= 0.5 AND area <= nb + 0.5 GROUP BY ALL),
s AS (SELECT {b}unnest(range(greatest(nb, 1))) AS bin, vmax, nb FROM m),
hist AS (SELECT {"s." + by + ", " if by else ""}s.bin, CASE WHEN nb = 0 THEN (vmax + 1) / 2 ELSE CAST(s.bin + 1 AS DOUBLE) END AS mid, CAST(coalesce(n, 0) AS BIGINT) AS n,
      coalesce(n, 0) / sum(coalesce(n, 0)) OVER ({"PARTITION BY s." + by if by else ""}) AS p FROM s LEFT JOIN c ON c.bin = s.bin {"AND c." + by + " = s." + by if by else ""})"""


def _fit_sql(by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f""", u AS (SELECT {b}mid, ln(p) AS y FROM hist WHERE p > 0 AND p >= {LEAST_P} AND mid BETWEEN {LOW} AND {HIGH}),
g AS (SELECT {b}count(*) AS bins, regr_slope(y, mid) AS slope, regr_intercept(y, mid) AS intercept, regr_sxx(y, mid) AS sxx, regr_syy(y, mid) AS syy, regr_sxy(y, mid) AS sxy FROM u {"GROUP BY " + by if by else ""} HAVING count(*) >= 3)
SELECT {b}bins, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(1 - greatest(syy - sxy * sxy / sxx, 0) / syy, 6) AS r2, round(sqrt(greatest(syy - sxy * sxy / sxx, 0) / greatest(bins - 2, 1)), 6) AS rmse, round(abs(1 / slope), 6) AS pi FROM g"""


@query(_hist_sql() + " SELECT bin, mid, n, round(p, 9) AS p FROM hist", ("clusters",))
def hist_area(spark, t):
    """Size histogram of all clusters."""
    return stats.histogram(t("clusters")).withColumn("p", F.round("p", 9))


@query(_hist_sql() + _fit_sql(), ("clusters",))
def fit_pi(spark, t):
    """Packing-defect constant of all clusters."""
    return _round(stats.fit(stats.histogram(t("clusters")), LOW, HIGH, LEAST_P))


@query(_hist_sql("region_type") + _fit_sql("region_type"), ("clusters",))
def fit_pi_by_region(spark, t):
    """The constant for each region type."""
    by = ("region_type",)
    return _round(stats.fit(stats.histogram(t("clusters"), by=by), LOW, HIGH, LEAST_P, by))


_SEGMENTS = ", e AS (SELECT min(h) AS lo, max(h) AS hi FROM clusters WHERE isfinite(area) AND isfinite(h)), seg AS (SELECT c.*, 1 + " + " + ".join(f"CASE WHEN h >= lo + (hi - lo) / 5 * {i} THEN 1 ELSE 0 END" for i in range(1, 5)) + " AS segment FROM clusters c, e WHERE isfinite(area) AND isfinite(h) AND area > 0)"


@query(_SEGMENTS + _hist_sql("segment", "seg") + _fit_sql("segment"), ("clusters",))
def fit_pi_by_h_segment(spark, t):
    """The constant for each of five curvature segments."""
    by = ("segment",)
    return _round(stats.fit(stats.histogram(stats.curvature_segments(t("clusters")), by=by), LOW, HIGH, LEAST_P, by))


@query(_SEGMENTS + " SELECT segment, count(*) AS n, round(min(h), 9) AS lo, round(max(h), 9) AS hi FROM seg GROUP BY segment", ("clusters",))
def h_segments(spark, t):
    """Clusters and curvature range of each segment."""
    return stats.curvature_segments(t("clusters")).groupBy("segment").agg(F.count("*").alias("n"), F.round(F.min("h"), 9).alias("lo"), F.round(F.max("h"), 9).alias("hi"))


@query("SELECT frame, count(*) FILTER (side = 'upper') AS upper, count(*) FILTER (side = 'lower') AS lower, count(*) AS total FROM clusters GROUP BY frame", ("clusters",))
def clusters_per_frame(spark, t):
    """Clusters per frame and side."""
    return stats.clusters_per_frame(t("clusters"))


@query("SELECT coalesce(CAST(frame AS VARCHAR), 'all') AS frame, count(*) FILTER (side = 'upper') AS upper, count(*) FILTER (side = 'lower') AS lower, count(*) AS total, count(*) / count(DISTINCT frame) AS mean_per_frame FROM clusters GROUP BY ROLLUP (frame)", ("clusters",))
def clusters_rollup(spark, t):
    """Clusters per frame and over all, with the mean per frame."""
    return _pooled(stats.clusters_rollup(t("clusters")).drop("all_frames"))


@query("""SELECT frame, round(sum(CASE WHEN side = 'upper' THEN area ELSE 0 END), 7) AS upper, round(sum(CASE WHEN side = 'lower' THEN area ELSE 0 END), 7) AS lower FROM clusters WHERE isfinite(area) AND area > 0 GROUP BY frame""", ("clusters",))
def areas_per_frame(spark, t):
    """Area sums per frame and side."""
    return _round(stats.areas_per_frame(t("clusters")), 7)


@query(""", a AS (SELECT frame % 5 AS frame, sum(CASE WHEN side = 'upper' THEN area ELSE 0 END) AS up, sum(CASE WHEN side = 'lower' THEN area ELSE 0 END) AS lo FROM clusters WHERE isfinite(area) AND area > 0 GROUP BY 1),
s AS (SELECT frame, 100 * up / (lx * ly) AS upper, 100 * lo / (lx * ly) AS lower, 100 * (up + lo) / (2 * lx * ly) AS total FROM a JOIN box USING (frame))
SELECT CAST(frame AS VARCHAR) AS frame, round(upper, 7) AS upper, round(lower, 7) AS lower, round(total, 7) AS total FROM s UNION ALL SELECT 'all', round(avg(upper), 7), round(avg(lower), 7), round(avg(total), 7) FROM s""", ("clusters", "box"))
def coverage(spark, t):
    """Surface coverage per frame and its means."""
    return _pooled(_round(stats.coverage(t("clusters").withColumn("frame", F.col("frame") % 5), t("box")), 7))


@query("""SELECT coalesce(CAST(frame AS VARCHAR), 'all') AS frame, round(coalesce(avg(area) FILTER (side = 'upper'), 0), 7) AS upper, round(coalesce(avg(area) FILTER (side = 'lower'), 0), 7) AS lower, round(avg(area), 7) AS total
FROM clusters WHERE isfinite(area) AND area > 0 GROUP BY ROLLUP (frame)""", ("clusters",))
def mean_size_per_frame(spark, t):
    """Mean cluster size per frame and pooled."""
    return _pooled(_round(stats.mean_sizes(t("clusters")), 7))


@query(""", s AS (SELECT f.frame, sum(CASE WHEN defect_type = 1 THEN area ELSE 0 END) AS neutral, sum(CASE WHEN defect_type = 0 THEN area ELSE 0 END) AS tail
FROM (SELECT DISTINCT frame FROM facets) f LEFT JOIN (SELECT frame, area, defect_type FROM facets WHERE defect) d USING (frame) GROUP BY ROLLUP (f.frame))
SELECT coalesce(CAST(frame AS VARCHAR), 'all') AS frame, round(neutral, 7) AS neutral, round(tail, 7) AS tail, round(coalesce(100 * neutral / nullif(neutral + tail, 0), 0), 7) AS neutral_percent, round(coalesce(100 * tail / nullif(neutral + tail, 0), 0), 7) AS tail_percent FROM s""", ("facets",))
def type_area_rollup(spark, t):
    """Area by defect type, per frame and pooled."""
    return _pooled(_round(stats.type_areas(t("facets").where("defect"), t("facets")), 7))


@query("SELECT frame, round(lx, 6) AS lx, round(ly, 6) AS ly, round(lz, 6) AS lz FROM box", ("box",))
def bbox_per_frame(spark, t):
    """Bounds of each frame."""
    return _round(tiling.boxes(t("beads")))


@query(""", o AS (SELECT * FROM (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)),
m AS (SELECT frame, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM beads GROUP BY frame)
SELECT frame, bead, i, j, round(x + i * lx, 3) AS x, round(y + j * ly, 3) AS y, round(z, 3) AS z
FROM beads JOIN box USING (frame) JOIN m USING (frame), o
WHERE round(x + i * lx, 3) BETWEEN mx - 0.75 * lx AND mx + 0.75 * lx AND round(y + j * ly, 3) BETWEEN my - 0.75 * ly AND my + 0.75 * ly""", ("beads", "box"))
def tile_cut(spark, t):
    """Nine copies of each frame, cut to one and a half boxes."""
    return tiling.cut(tiling.tile(t("beads"), tiling.boxes(t("beads"))), tiling.boxes(t("beads"))).select("frame", "bead", "i", "j", "x", "y", "z")


@query("""SELECT bead, t.type, coalesce(t.type, 'UNKNOWN') AS bead_type, r.radius, CASE WHEN label = 9 THEN 'n' WHEN coalesce(t.type, 'UNKNOWN') LIKE 'C%' THEN 't' ELSE 'h' END AS flag
FROM beads LEFT JOIN (VALUES (0, 'Q0'), (1, 'Qa'), (2, 'P5'), (3, 'C1'), (4, 'C3'), (5, 'SC1'), (7, 'Na'), (9, 'C1')) t(label, type) USING (label) LEFT JOIN (VALUES ('Q0', 2.6), ('Qa', 2.5), ('C1', 2.4), ('C3', 2.3), ('SC1', 2.2)) r(type, radius) ON r.type = t.type""".replace("r.radius", "CAST(r.radius AS DOUBLE) AS radius"), ("beads",))
def atom_flag_join(spark, t):
    """Types, radii and flags of beads by dimension joins; misses are UNKNOWN, without a radius."""
    types = spark.createDataFrame([(0, "Q0"), (1, "Qa"), (2, "P5"), (3, "C1"), (4, "C3"), (5, "SC1"), (7, "Na"), (9, "C1")], "label int, type string")
    radii = spark.createDataFrame([("Q0", 2.6), ("Qa", 2.5), ("C1", 2.4), ("C3", 2.3), ("SC1", 2.2)], "type string, radius double")
    joined = t("beads").drop("radius", "flag").join(F.broadcast(types), "label", "left").join(F.broadcast(radii), "type", "left")
    kind = F.coalesce("type", F.lit("UNKNOWN"))
    return joined.select("bead", "type", kind.alias("bead_type"), "radius", bead_functions.bead_flag(F.col("label").cast("string"), kind, {"9"}).alias("flag"))


@query("SELECT event_id, last_value(CASE WHEN event_id % 7 = 3 THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS carried FROM events")
def carry_forward(spark, t):
    """The last seen value before or at each row, as a frame takes the last cell that was written."""
    seen = F.when(F.col("event_id") % 7 == 3, F.col("props"))
    return t("events").select("event_id", F.last(seen, ignorenulls=True).over(Window.partitionBy("user_id").orderBy("event_id")).alias("carried"))


@query("SELECT l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber DESC, l_quantity) AS r FROM lineitem) WHERE r = 1")
def first_wins_merge(spark, t):
    """Of rows with one key the first file's, and in a file the last."""
    return merges.first_wins(t("lineitem"), ["l_partkey", "l_suppkey"], F.col("l_orderkey").asc(), F.col("l_linenumber").desc(), F.col("l_quantity").asc()).select("l_partkey", "l_suppkey", "l_quantity")


@query("SELECT event_type, user_id % 7 AS slot, min(event_id) AS first_seen FROM events GROUP BY ALL")
def unique_pairs_first_seen(spark, t):
    """Distinct pairs and where each is seen first."""
    return merges.first_seen(t("events").withColumn("slot", F.col("user_id") % 7), ["event_type", "slot"], "event_id")


@query("SELECT tri_id, round(area, 6) AS area, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(px / sqrt(px * px + py * py + pz * pz), 6) AS nx, round(py / sqrt(px * px + py * py + pz * pz), 6) AS ny, round(pz / sqrt(px * px + py * py + pz * pz), 6) AS nz FROM facets", ("facets",))
def tri_geometry(spark, t):
    """Areas, centroids and normals."""
    a, b, c = ((F.col(f"{k}x{e}"), F.col(f"{k}y{e}" if k != "b" else "by_"), F.col(f"{k}z{e}")) for k, e in (("a", ""), ("b", ""), ("c", "_")))
    n, m = geo.local_frame(a, b, c)["n"], geo.centroid(a, b, c)
    return _round(t("grid_tris").select("tri_id", geo.area(a, b, c).alias("area"), *[m[i].alias(f"c{x}") for i, x in enumerate("xyz")], *[n[i].alias(f"n{x}") for i, x in enumerate("xyz")]))


@query("SELECT frame, side, count(*) AS n, round(avg(area), 6) AS mean, round(stddev_pop(area), 6) AS std, round(stddev_pop(area) / avg(area), 6) AS cv, round(min(area), 6) AS least, round(max(area), 6) AS most FROM facets GROUP BY frame, side", ("facets",))
def tri_area_stats(spark, t):
    """Area statistics of each mesh."""
    return _round(tiling.area_stats(t("facets")))


@query(""", m AS (SELECT frame, (min(x) + max(x)) / 2 AS mx FROM beads GROUP BY frame)
SELECT bead, round((x - mx + lx / 4) - (lx / 2) * floor((x - mx + lx / 4) / (lx / 2)) - lx / 4, 6) AS wx FROM beads JOIN box USING (frame) JOIN m USING (frame)""", ("beads", "box"))
def wrap_periodic(spark, t):
    """Beads wrapped to half the cell's length around its middle."""
    mid = t("beads").groupBy("frame").agg(((F.min("x") + F.max("x")) / 2).alias("mx"))
    return t("beads").join(t("box"), "frame").join(mid, "frame").select("bead", F.round(geo.wrap(F.col("x"), F.col("mx"), F.col("lx") / 2), 6).alias("wx"))


@query("SELECT frame, side, CAST(floor(tri_id / 10) AS BIGINT) AS cluster, count(*) AS n, round(sum(area), 6) AS area, round(sum(area * cx) / sum(area), 6) AS cx, round(sum(area * cy) / sum(area), 6) AS cy, round(sum(area * cz) / sum(area), 6) AS cz FROM facets GROUP BY ALL", ("facets",))
def weighted_centroid(spark, t):
    """Area and area-weighted centroid of runs of triangles."""
    members = t("facets").select("frame", "side", "tri_id", F.floor(F.col("tri_id") / 10).cast("long").alias("cluster"))
    return _round(cl.cluster_facts(members, t("facets")))


_EDGES = """, tri AS (SELECT * FROM facets WHERE defect), ed AS (SELECT frame, side, tri_id, least(v0, v1) AS e0, greatest(v0, v1) AS e1 FROM tri UNION ALL SELECT frame, side, tri_id, least(v1, v2), greatest(v1, v2) FROM tri UNION ALL SELECT frame, side, tri_id, least(v2, v0), greatest(v2, v0) FROM tri),
adj AS (SELECT DISTINCT x.frame, x.side, x.tri_id AS a, y.tri_id AS b FROM ed x JOIN ed y ON x.frame = y.frame AND x.side = y.side AND x.e0 = y.e0 AND x.e1 = y.e1 AND x.tri_id < y.tri_id)"""


@query(_EDGES + " SELECT * FROM adj", ("facets",))
def edge_adjacency(spark, t):
    """Defect triangles that share an edge."""
    return graph.adjacency(t("facets").where("defect"))


@query(_EDGES + """, two AS (SELECT frame, side, e0, e1, min(tri_id) AS a, max(tri_id) AS b FROM ed GROUP BY ALL HAVING count(*) = 2)
SELECT two.frame, two.side, a, b, round(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)), 6) AS edge_len, round(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)), 6) AS neck_width,
round(least(s.area, u.area) / greatest(s.area, u.area), 6) AS area_ratio, round(sqrt((s.cx - u.cx) * (s.cx - u.cx) + (s.cy - u.cy) * (s.cy - u.cy) + (s.cz - u.cz) * (s.cz - u.cz)), 6) AS centroid_dist
FROM two JOIN vertices p ON p.vid = e0 JOIN vertices q ON q.vid = e1 JOIN tri s ON s.tri_id = a JOIN tri u ON u.tri_id = b""", ("facets", "vertices"))
def edge_metrics(spark, t):
    """Edges of exactly two defect triangles and their metrics."""
    tri = t("facets").where("defect")
    corners = tri.select("frame", "side", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct().join(t("vertices").select("vid", "x", "y", "z"), "vid")
    return _round(graph.edge_metrics(tri, corners))


@query(_EDGES + " SELECT DISTINCT frame, side, tri_id FROM (SELECT *, count(*) OVER (PARTITION BY frame, side, e0, e1) AS n FROM ed) WHERE n = 1", ("facets",))
def boundary_triangles(spark, t):
    """Defect triangles at a border."""
    return graph.boundary_triangles(t("facets").where("defect"))


_COMPONENTS = _EDGES + """, both_ AS (SELECT a, b FROM adj UNION ALL SELECT b, a FROM adj), reach AS (SELECT tri_id AS n, tri_id AS r FROM tri UNION SELECT both_.b, reach.r FROM reach JOIN both_ ON both_.a = reach.n),
comp AS (SELECT n AS tri_id, min(r) AS component FROM reach GROUP BY n),
sized AS (SELECT frame, side, component, count(*) AS size FROM comp JOIN tri USING (tri_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY frame, side ORDER BY size DESC, component) - 1 AS cluster FROM sized)"""


@query(_COMPONENTS + " SELECT r.frame, r.side, tri_id, component, size, cluster FROM comp JOIN ranked r USING (component)", ("facets",))
def components(spark, t):
    """Defect clusters by shared edges, larger first."""
    return graph.components(t("facets").where("defect"))


@query(_COMPONENTS + " SELECT frame, side, component, size FROM ranked WHERE cluster < 2", ("facets",))
def top2_components(spark, t):
    """Each leaflet's two largest clusters."""
    return graph.components(t("facets").where("defect")).where("cluster < 2").select("frame", "side", "component", "size").distinct()


# an edge is a bridge if its ends lie apart without it
_BRIDGES = _EDGES + """, pair AS (SELECT DISTINCT frame, side, a, b FROM (SELECT frame, side, min(tri_id) AS a, max(tri_id) AS b FROM ed GROUP BY frame, side, e0, e1 HAVING count(*) = 2)),
way AS (SELECT a AS p, b AS q FROM pair UNION ALL SELECT b, a FROM pair), detour AS (SELECT a, b, a AS pt FROM pair UNION SELECT d.a, d.b, way.q FROM detour d JOIN way ON way.p = d.pt AND NOT (d.a = way.p AND d.b = way.q) AND NOT (d.b = way.p AND d.a = way.q)),
bridge AS (SELECT frame, side, a, b FROM pair ANTI JOIN (SELECT a, b FROM detour WHERE pt = b) USING (a, b))"""


@query(_BRIDGES + """, held AS (SELECT a, b FROM pair ANTI JOIN bridge USING (a, b)), both_ AS (SELECT a, b FROM held UNION ALL SELECT b, a FROM held),
reach AS (SELECT tri_id AS n, tri_id AS r FROM tri UNION SELECT both_.b, reach.r FROM reach JOIN both_ ON both_.a = reach.n), comp AS (SELECT n AS tri_id, min(r) AS component FROM reach GROUP BY n),
ranked AS (SELECT *, row_number() OVER (PARTITION BY frame, side ORDER BY size DESC, component) - 1 AS cluster FROM (SELECT frame, side, component, count(*) AS size FROM comp JOIN tri USING (tri_id) GROUP BY ALL HAVING count(*) >= 2))
SELECT r.frame, r.side, tri_id, component, size, cluster FROM comp JOIN ranked r USING (component)""", ("facets",))
def bridge_prune(spark, t):
    """Clusters that are left without bridges."""
    return graph.pruned_components(t("facets").where("defect"))


@query(_BRIDGES + " SELECT frame, side, a, b FROM bridge", ("facets",))
def bridge_edges(spark, t):
    """The bridges of the defect graph."""
    return graph.bridge_edges(t("facets").where("defect"))


def _dedup_input(t):
    beads = t("beads").select("frame", F.when(F.col("z") > 0, "upper").otherwise("lower").alias("side"), F.col("bead").alias("cluster"), F.col("label").cast("long").alias("n"), F.col("radius").alias("area"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    return beads, t("box"), cl.centers(beads)


@query(""", c AS (SELECT frame, CASE WHEN z > 0 THEN 'upper' ELSE 'lower' END AS side, bead AS cluster, label AS n, radius AS area, x, y FROM beads),
m AS (SELECT frame, side, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM c GROUP BY ALL),
w AS (SELECT frame, side, cluster, n, area, (x - mx + lx / 2) - lx * floor((x - mx + lx / 2) / lx) - lx / 2 AS wx, (y - my + ly / 2) - ly * floor((y - my + ly / 2) / ly) - ly / 2 AS wy, row_number() OVER (PARTITION BY frame, side ORDER BY area DESC, n DESC, cluster) AS r FROM c JOIN m USING (frame, side) JOIN box USING (frame)),
g AS (SELECT frame, side, 0 AS r, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, c BIGINT)[]) AS kept FROM (SELECT DISTINCT frame, side FROM w)
UNION ALL SELECT g.frame, g.side, w.r, CASE WHEN len(list_filter(kept, lambda k: (k.x - w.wx) * (k.x - w.wx) + (k.y - w.wy) * (k.y - w.wy) < 100.0)) = 0 THEN list_append(kept, {'x': w.wx, 'y': w.wy, 'c': w.cluster}) ELSE kept END FROM g JOIN w ON g.frame = w.frame AND g.side = w.side AND w.r = g.r + 1),
l AS (SELECT frame, side, arg_max(kept, r) AS kept FROM g GROUP BY ALL), k AS (SELECT unnest(kept).c AS cluster FROM l)
SELECT frame, side, cluster, CAST(n AS BIGINT) AS n, area, round(wx, 6) AS wx, round(wy, 6) AS wy FROM w JOIN k USING (cluster)""", ("beads", "box"))
def greedy_dedup(spark, t):
    """Greedy periodic de-duplication of clusters."""
    return cl.deduplicate(*_dedup_input(t)).select("frame", "side", "cluster", "n", "area", F.round("wx", 6).alias("wx"), F.round("wy", 6).alias("wy"))


_TRIS = "SELECT frame % 5 AS frame, tri_id AS tri, ax * 2 - 40 AS ax, ay - floor(ay / 40) * 40 - 20 AS ay, az * 2 - 4 AS az, bx * 2 - 40 AS bx, by_ - floor(ay / 40) * 40 - 20 AS by, bz * 2 - 4 AS bz, cx_ * 2 - 40 AS cx, cy_ - floor(ay / 40) * 40 - 20 AS cy, cz_ * 2 - 4 AS cz FROM {facets} WHERE defect"
_ALL_TRIS = _TRIS.removesuffix(" WHERE defect")


def _near_sql(tris: str, nearest: int) -> str:
    """The triangles of a view text, their mid-points and each bead's nearest."""
    quoted = tris.format(facets="facets").replace(" AS by,", ' AS "by",')
    return f""", tris AS ({quoted}), mids AS (SELECT frame, tri, (ax + bx + cx) / 3 AS x, (ay + "by" + cy) / 3 AS y, (az + bz + cz) / 3 AS z FROM tris),
near AS (SELECT b.frame, bead, tri, (b.x - m.x) * (b.x - m.x) + (b.y - m.y) * (b.y - m.y) + (b.z - m.z) * (b.z - m.z) AS d2 FROM beads b JOIN mids m ON b.frame = m.frame),
knn AS (SELECT *, row_number() OVER (PARTITION BY frame, bead ORDER BY d2, tri) AS rank FROM near QUALIFY rank <= {nearest})"""


_HALF, _ALL, _WHOLE = _near_sql(_TRIS, NEAREST), _near_sql(_ALL_TRIS, NEAREST), _near_sql(_ALL_TRIS, WHOLE_NEAREST)
_KNN_ROWS = " SELECT frame, bead, tri, round(d2, 6) AS d2, CAST(rank AS INT) AS rank FROM knn"


def _tris(spark, t, text: str = _TRIS) -> DataFrame:
    return spark.sql(text, facets=t("facets"))


def _mids(tris: DataFrame) -> DataFrame:
    return tris.select("frame", "tri", *[((F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3).alias(c) for c in "xyz"])


@query(_ALL + _KNN_ROWS, ("facets", "beads"))
def knn_join(spark, t):
    """Each bead's nearest of all triangles."""
    return _round(spatial.k_nearest(t("beads"), _mids(_tris(spark, t, _ALL_TRIS)), NEAREST))


@query(f""", near AS (SELECT p.frame, p.bead AS a, q.bead AS b FROM beads p JOIN beads q ON p.frame = q.frame AND p.bead <> q.bead AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) <= {CUTOFF * CUTOFF}),
reach AS (SELECT bead AS n, bead AS r FROM beads UNION SELECT near.b, reach.r FROM reach JOIN near ON near.a = reach.n)
SELECT frame, bead, min(r) AS component FROM reach JOIN beads ON bead = n GROUP BY ALL""", ("beads",))
def radius_components(spark, t):
    """Components of beads within a cutoff."""
    return spatial.point_components(t("beads"), CUTOFF)


@query(f""", near AS (SELECT p.frame, p.bead AS a, q.bead AS b FROM beads p JOIN beads q ON p.frame = q.frame AND p.bead <> q.bead AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) <= {CUTOFF * CUTOFF}),
reach AS (SELECT bead AS n, bead AS r FROM beads UNION SELECT near.b, reach.r FROM reach JOIN near ON near.a = reach.n),
c AS (SELECT frame, bead, min(r) AS component, any_value(z) AS z FROM reach JOIN beads ON bead = n GROUP BY ALL), s AS (SELECT frame, component, count(*) AS n, avg(z) AS z FROM c GROUP BY ALL),
two AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n DESC, component) AS r FROM s QUALIFY r <= 2)
SELECT frame, component, n, round(z, 6) AS z, CASE WHEN row_number() OVER (PARTITION BY frame ORDER BY z DESC, component) = 1 THEN 'upper' ELSE 'lower' END AS side FROM two""".replace("GROUP BY ALL), s AS", "GROUP BY frame, bead), s AS"), ("beads",))
def leaflet_split(spark, t):
    """The two largest components of each frame, by height."""
    return _round(spatial.leaflets(t("beads"), CUTOFF))


_SHEETS = "SELECT bead % 10 AS frame, CASE WHEN bead % 3 = 0 THEN 'upper' ELSE 'lower' END AS side, bead AS tri_id, x AS cx, y AS cy, z AS cz, CAST(0.6 AS DOUBLE) AS nx, CAST(0 AS DOUBLE) AS ny, CAST(0.8 AS DOUBLE) AS nz FROM {beads}"
_NEAR = f""", sheets AS ({_SHEETS.format(beads="beads")}), near AS (SELECT o.frame, o.side, o.tri_id, q.tri_id AS opposite, (o.cx - q.cx) * (o.cx - q.cx) + (o.cy - q.cy) * (o.cy - q.cy) + (o.cz - q.cz) * (o.cz - q.cz) AS d2, abs((q.cx - o.cx) * o.nx + (q.cy - o.cy) * o.ny + (q.cz - o.cz) * o.nz) AS thickness
FROM sheets o JOIN sheets q ON o.frame = q.frame AND o.side <> q.side), best AS (SELECT *, row_number() OVER (PARTITION BY frame, side, tri_id ORDER BY d2, opposite) AS r FROM near WHERE d2 <= {PAIRING * PAIRING} QUALIFY r = 1),
paired AS (SELECT s.frame, s.side, s.tri_id, opposite, thickness FROM sheets s LEFT JOIN best USING (frame, side, tri_id))"""


@query(_NEAR + " SELECT frame, side, tri_id, coalesce(opposite, -1) AS opposite, round(thickness, 6) AS thickness FROM paired", ("beads",))
def apposition(spark, t):
    """Nearest triangles of the other leaflet and the thickness along the normal."""
    return _round(cl.apposition(spark.sql(_SHEETS, beads=t("beads")), PAIRING)).withColumn("opposite", F.coalesce("opposite", F.lit(-1)))


@query(_NEAR + """, md AS (SELECT frame, side, median(thickness) AS median FROM paired GROUP BY ALL)
SELECT frame, side, tri_id % 7 AS cluster, round(avg(CASE WHEN abs(thickness - median) <= 1.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS paired_fraction, CASE WHEN avg(CASE WHEN abs(thickness - median) <= 1.5 THEN 1.0::DOUBLE ELSE 0 END) >= 0.4 THEN 'bilayer' ELSE 'monolayer' END AS region_type
FROM paired JOIN md USING (frame, side) GROUP BY ALL""".replace("GROUP BY ALL\"", ""), ("beads",))
def layer_class(spark, t):
    """Monolayer or bilayer by the share of paired triangles."""
    sheets = spark.sql(_SHEETS, beads=t("beads"))
    members = sheets.select("frame", "side", (F.col("tri_id") % 7).alias("cluster"), "tri_id")
    return _round(cl.layers(members, cl.apposition(sheets, PAIRING), tolerance=1.5, bilayer_fraction=0.4))


def _coverage_sql(side: int) -> str:
    grid = ", ".join(f"({i}, {w[1]!r}, {w[2]!r})" for i, w in enumerate(geo.barycentric_grid(side)))
    n = len(geo.barycentric_grid(side))
    return f""", g(s, wb, wc) AS (VALUES {grid}),
fr AS (SELECT *, sqrt(abx * abx + aby * aby + abz * abz) AS la, sqrt(n0 * n0 + n1 * n1 + n2 * n2) AS ln_ FROM (SELECT *, aby * acz - abz * acy AS n0, abz * acx - abx * acz AS n1, abx * acy - aby * acx AS n2 FROM
(SELECT *, bx - ax AS abx, "by" - ay AS aby, bz - az AS abz, cx - ax AS acx, cy - ay AS acy, cz - az AS acz FROM tris))),
fu AS (SELECT *, abx / la AS u0, aby / la AS u1, abz / la AS u2, n0 / ln_ AS w0, n1 / ln_ AS w1, n2 / ln_ AS w2 FROM fr),
fv AS (SELECT *, w1 * u2 - w2 * u1 AS q0, w2 * u0 - w0 * u2 AS q1, w0 * u1 - w1 * u0 AS q2 FROM fu),
pr AS (SELECT v.frame, v.tri, b.bead, b.flag, b.radius, (b.x - ax) * w0 + (b.y - ay) * w1 + (b.z - az) * w2 AS depth, (b.x - ax) * u0 + (b.y - ay) * u1 + (b.z - az) * u2 AS px, (b.x - ax) * q0 + (b.y - ay) * q1 + (b.z - az) * q2 AS py,
abx * u0 + aby * u1 + abz * u2 AS lb, acx * u0 + acy * u1 + acz * u2 AS lcx, acx * q0 + acy * q1 + acz * q2 AS lcy FROM knn JOIN fv v ON v.frame = knn.frame AND v.tri = knn.tri JOIN beads b ON b.bead = knn.bead),
sl AS (SELECT * FROM pr WHERE depth BETWEEN -30 AND 30),
hit AS (SELECT sl.*, s FROM sl JOIN g ON (wb * lb + wc * lcx - px) * (wb * lb + wc * lcx - px) + (wc * lcy - py) * (wc * lcy - py) <= radius * radius),
ag AS (SELECT frame, tri, count(DISTINCT bead) AS n_used, count(DISTINCT s) FILTER (flag = 'h') AS head, count(DISTINCT s) FILTER (flag <> 'h') AS other, count(DISTINCT s) AS total, count(DISTINCT s) FILTER (flag = 'n') AS neutral, count(DISTINCT s) FILTER (flag = 't') AS tail FROM hit GROUP BY ALL),
tp AS (SELECT frame, tri, flag AS top FROM hit WHERE flag <> 'h' QUALIFY row_number() OVER (PARTITION BY frame, tri ORDER BY depth DESC, bead) = 1),
cn AS (SELECT frame, tri, count(*) AS n_candidates FROM knn GROUP BY ALL), sn AS (SELECT frame, tri, count(*) AS n_after_slab FROM sl GROUP BY ALL),
cl AS (SELECT t.frame, t.tri, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_after_slab, 0) AS n_after_slab, coalesce(n_used, 0) AS n_used, round(coalesce(head, 0) / {n}, 6) AS head_fraction, round(coalesce(other, 0) / {n}, 6) AS other_fraction, round(coalesce(total, 0) / {n}, 6) AS total_fraction,
CASE WHEN coalesce(head, 0) > 0 THEN 1 ELSE 3 END AS mode, CASE WHEN coalesce(neutral, 0) > coalesce(tail, 0) THEN 1 WHEN coalesce(neutral, 0) < coalesce(tail, 0) THEN 0 WHEN top = 'n' THEN 1 ELSE 0 END AS defect_type, coalesce(head, 0) = 0 AS is_defect
FROM tris t LEFT JOIN ag USING (frame, tri) LEFT JOIN tp USING (frame, tri) LEFT JOIN cn USING (frame, tri) LEFT JOIN sn USING (frame, tri))"""


@query(_HALF + _coverage_sql(GRID) + " SELECT * FROM cl", ("facets", "beads"))
def coverage_classify(spark, t):
    """Defects and their types by the beads that cover triangles."""
    tris = _tris(spark, t)
    near = spatial.k_nearest(t("beads"), _mids(tris), NEAREST)
    return _round(cov.classify(tris, t("beads"), near, GRID))


@query(_HALF + _coverage_sql(GRID) + " SELECT frame, tri FROM cl WHERE is_defect", ("facets", "beads"))
def head_veto_antijoin(spark, t):
    """Defects by an anti-join against heads that cover."""
    tris = _tris(spark, t)
    return cov.head_veto(tris, t("beads"), spatial.k_nearest(t("beads"), _mids(tris), NEAREST), GRID)


def _whole(spark, t) -> tuple[DataFrame, DataFrame]:
    """All triangles, whichever will prove to be defects, and each bead's nearest of them."""
    tris = _tris(spark, t, _ALL_TRIS)
    return tris, spatial.k_nearest(t("beads"), _mids(tris), WHOLE_NEAREST)


@query(_WHOLE + _KNN_ROWS, ("facets", "beads"))
def knn_join_whole(spark, t):
    """knn_join over all triangles, with as many candidates as the reference's default."""
    return _round(_whole(spark, t)[1])


@query(_WHOLE + _coverage_sql(cov.GRID) + " SELECT * FROM cl", ("facets", "beads"))
def coverage_classify_whole(spark, t):
    """coverage_classify over all triangles, with the reference's candidates and samples."""
    tris, near = _whole(spark, t)
    return _round(cov.classify(tris, t("beads"), near))


@query(_WHOLE + _coverage_sql(cov.GRID) + " SELECT frame, tri FROM cl WHERE is_defect", ("facets", "beads"))
def head_veto_antijoin_whole(spark, t):
    """head_veto_antijoin over all triangles, with the reference's candidates and samples."""
    tris, near = _whole(spark, t)
    return cov.head_veto(tris, t("beads"), near)


@query(""", hv AS (SELECT vid, CAST(vid % 97 AS DOUBLE) / 97 - 0.5 AS h FROM vertices), th AS (SELECT frame, side, tri_id, area, CAST(floor(tri_id / 10) AS BIGINT) AS cluster, (a.h + b.h + c.h) / 3 AS h FROM facets JOIN hv a ON a.vid = v0 JOIN hv b ON b.vid = v1 JOIN hv c ON c.vid = v2)
SELECT frame, side, cluster, round(sum(area), 6) AS area, round(sum(area * h) / sum(area), 6) + 0.0 AS h FROM th GROUP BY ALL""", ("facets", "vertices"))
def cluster_h(spark, t):
    """Area-weighted curvature of clusters."""
    facets = t("facets")
    corners = facets.select("frame", "side", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct().withColumn("h", (F.col("vid") % 97).cast("double") / 97 - 0.5)
    members = facets.select("frame", "side", "tri_id", F.floor(F.col("tri_id") / 10).cast("long").alias("cluster"))
    return _round(cl.cluster_curvature(members, facets, cl.triangle_curvature(facets, corners))).withColumn("h", F.col("h") + 0.0)


@query("SELECT DISTINCT frame, side FROM clusters c WHERE NOT EXISTS (SELECT 1 FROM clusters d WHERE d.cluster % 400 = 1 AND d.frame = c.frame AND d.side = c.side)", ("clusters",))
def resume_antijoin(spark, t):
    """Jobs (frame, side) that have no output yet."""
    clusters = t("clusters")
    return resume.pending(clusters.select("frame", "side"), clusters.where("cluster % 400 = 1"), ["frame", "side"])
