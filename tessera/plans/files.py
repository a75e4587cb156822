"""Queries for the operators on files' names and lines, on edges of meshes and on their colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as geo
from tessera.functions import names
from tessera.operators import colors, trim
from tessera.plans.catalog import _round, query
from tessera.sources import forcefield, logs, pdb, tables


@query("SELECT event_id, event_id AS frame FROM events")
def frame_names(spark, t):
    """Frames of files of four forms of name."""
    number = F.col("event_id").cast("string")
    forms = [F.concat(F.lit("/out/7/frame_"), number, F.lit("_clusters_both.npz")), F.concat(F.lit("frame_1_of_frame_"), number, F.lit("_radius_defects.npz")), F.concat(F.lit("x3/frame_"), number, F.lit(".pdb")), F.concat(F.lit("snap"), number, F.lit("_2.pdb"))]
    path = F.get(F.array(*forms), (F.col("event_id") % 4).cast("int"))
    return t("events").select("event_id", names.frame_of(path).alias("frame"))


@query("SELECT event_id, user_id AS frame, CASE WHEN event_id % 2 = 0 THEN 'upper' ELSE 'lower' END AS side, event_id % 1000 AS split FROM events")
def leaflet_names(spark, t):
    """Frame and side of pruned leaflets' files, and frames of split ones."""
    side = F.when(F.col("event_id") % 2 == 0, "upper").otherwise("lower")
    frame, found = names.pruned_frame_and_side(F.concat(F.lit("a/b_1/frame_"), F.col("user_id").cast("string"), F.lit("_pruned_clusters_"), side, F.lit(".npz")))
    split = names.split_frame(F.concat(F.lit("7/snap_"), (F.col("event_id") % 1000).cast("string"), F.lit(".pdb")), "snap")
    return t("events").select("event_id", frame.alias("frame"), found.alias("side"), split.alias("split"))


def _atoms(t) -> DataFrame:
    """Atoms of the beads; serials past 99999 are too long for five digits."""
    text = {"record": F.when(F.col("label") == 0, "HETATM").otherwise("ATOM"), "name": F.when(F.col("label") < 5, "GL2").otherwise("C12A"), "alt_loc": F.lit(" "), "res_name": F.lit("POPC"), "chain": F.lit("A"), "res_seq": F.col("label").cast("string"), "icode": F.lit(" "), "occupancy": F.lit(""), "temp_factor": F.lit(""), "element": F.lit("C"), "charge": F.lit("")}
    return t("beads").select("frame", F.col("bead").cast("int").alias("serial"), "x", "y", "z", *[c.alias(k) for k, c in text.items()])


@query("""SELECT frame, bead AS serial, CASE WHEN label = 0 THEN 'HETATM' ELSE 'ATOM' END AS record, CASE WHEN label < 5 THEN 'GL2' ELSE 'C12A' END AS name, 'POPC' AS res_name, CAST(label AS VARCHAR) AS res_seq,
round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z, '1.00' AS occupancy, 'C' AS element FROM beads""", ("beads",))
def pdb_round_trip(spark, t):
    """Atoms written as lines of a trajectory and read back by their columns; CRYST1 and END lines are left out."""
    atoms = _atoms(t)
    box = atoms.groupBy("frame").agg(*[(F.max(c) - F.min(c)).alias(f"l{c}") for c in "xyz"])
    back = pdb.parse_lines(pdb.pdb_lines(atoms, box).select("frame", "line"))
    return back.select("frame", F.col("serial").cast("long").alias("serial"), "record", "name", "res_name", "res_seq", *[(F.col(c) + 0.0).alias(c) for c in "xyz"], "occupancy", "element")


@query("SELECT frame, round(lx, 3) AS lx, round(ly, 3) AS ly, round(lz, 3) AS lz, 90.0::DOUBLE AS alpha FROM box", ("box",))
def cryst1_round_trip(spark, t):
    """Boxes written as CRYST1 lines and read back."""
    lines = t("box").select("frame", pdb.format_cryst1(F.col("lx"), F.col("ly"), F.col("lz")).alias("line"))
    return lines.select("frame", *[c.alias(k) for k, c in pdb.cell_lengths(F.col("line")).items() if k in ("lx", "ly", "lz", "alpha")])


@query("SELECT frame, round(lx, 4) AS lx, round(ly, 4) AS ly, round(lz, 4) AS lz FROM box", ("box",))
def box_table(spark, t):
    """Boxes written as CSV lines at four decimals and read back."""
    return logs.parse_box_lines(logs.box_lines(t("box")))


@query("SELECT 'R' || p_size AS res_name, p_name AS atom_name, CASE WHEN p_size % 2 = 0 THEN 'h' ELSE 't' END AS flag, round(CAST(p_retailprice AS DOUBLE), 2) AS radius FROM part")
def atom_table(spark, t):
    """Atom tables written as CSV lines and read back; flags in lower case."""
    rows = t("part").select(F.concat(F.lit("R"), "p_size").alias("res_name"), F.col("p_name").alias("atom_name"), F.lit("C,1").alias("bead_type"), F.round(F.col("p_retailprice").cast("double"), 2).alias("radius"), F.when(F.col("p_size") % 2 == 0, "H ").otherwise("T").alias("flag"))
    return logs.parse_atom_lines(logs.atom_lines(rows))


@query("SELECT frame, side, CASE WHEN cluster % 11 <> 0 THEN round(area, 6) END AS area FROM clusters WHERE cluster % 7 <> 0", ("clusters",))
def cluster_file(spark, t):
    """Rows of a cluster file: sides by their labels, frames of fractions, rows without a frame left out."""
    rows = t("clusters").select(
        F.when(F.col("cluster") % 7 == 0, "?").otherwise(F.concat(F.col("frame").cast("string"), F.lit(".7"))).alias("frame"),
        F.concat(F.initcap("side"), F.lit(":"), F.col("cluster").cast("string")).alias("cluster"),
        F.when(F.col("cluster") % 11 == 0, "n/a").otherwise(F.col("area").cast("string")).alias("area_angstrom2"),
    )
    return _round(tables.parse_clusters(rows))


@query("SELECT region_type, round(area, 6) AS area FROM clusters WHERE cluster % 11 <> 0", ("clusters",))
def region_file(spark, t):
    """Rows of a layers file by region; unreadable areas are left out."""
    rows = t("clusters").select(F.concat(F.lit(" "), F.upper("region_type")).alias("region_type"), F.when(F.col("cluster") % 11 == 0, "n/a").otherwise(F.col("area").cast("string")).alias("area_angstrom2"))
    return _round(tables.parse_regions(rows))


@query("SELECT round(area, 6) AS area, round(h, 6) + 0.0 AS h FROM clusters WHERE cluster % 11 <> 0 AND cluster % 13 <> 0", ("clusters",))
def curvature_file(spark, t):
    """Rows of a curvature file with both numbers."""
    text = lambda c, n: F.when(F.col("cluster") % n == 0, "").otherwise(F.col(c).cast("string"))
    rows = t("clusters").select(text("area", 11).alias("area_angstrom2"), text("h", 13).alias("H"))
    return _round(tables.parse_curvature(rows)).withColumn("h", F.col("h") + 0.0)


def _lines(rows: DataFrame, parts: list) -> DataFrame:
    """path, line_no and line of files: each of the rows (path, start) gives the parts as lines from its start on."""
    return rows.select("path", "start", F.posexplode(F.array(*parts)).alias("at", "line")).select("path", (F.col("start") + F.col("at")).cast("int").alias("line_no"), "line")


_FILES = "SELECT *, 'f' || n_nationkey % 3 AS path, CAST(n_nationkey * 10 AS INTEGER) AS start FROM nation"


def _nations(t) -> DataFrame:
    return t("nation").withColumns({"path": F.concat(F.lit("f"), (F.col("n_nationkey") % 3).cast("string")), "start": F.col("n_nationkey") * 10})


def _with(df: DataFrame, forms: list[str]) -> DataFrame:
    """Lines by forms, in which {r} is the residue's name and {n} the nation's number."""
    parts = [F.replace(F.replace(F.lit(f), F.lit("{r}"), F.concat(F.lit("R"), F.col("n_nationkey").cast("string"))), F.lit("{n}"), F.col("n_nationkey").cast("string")) for f in forms]
    return _lines(df, parts)


def _types_sql(rows: list[tuple[int, str, str]], res: str = "'R' || n_nationkey") -> str:
    one = " UNION ALL ".join(f"SELECT path, CAST(start + {at} AS INTEGER) AS line_no, {res} AS res, {atom} AS atom, {kind} AS type FROM f" for at, atom, kind in rows)
    return f"WITH f AS ({_FILES}) {one}"


@query(_types_sql([(3, "'PO4'", "'Qa'"), (4, "'GL' || n_nationkey", "'Na'")]))
def itp_types(spark, t):
    """Bead types of molecules' sections; rows of fewer tokens, comments and other sections are left out."""
    return forcefield.itp_types(_with(_nations(t), ["[ moleculetype ]", "{r} 1 ; a name", "[ atoms ]", "1 Qa 1 {r} PO4 1 0 ; x", "2 Na 1 {r} GL{n} 2 0", "3 Na 1 {r} C1", "; 4 Na 1 {r} C2 2 0", "[ bonds ]", "1 Qa 1 {r} PO5 1 0"]))


@query(_types_sql([(1, "'N' || n_nationkey", "'nA'"), (2, "'C1'", "'cD'")]))
def lib_types(spark, t):
    """Atom types of library tables; rows of other entries are left out."""
    return forcefield.lib_types(_with(_nations(t), ["!entry.r{n}.unit.atoms table", '"N{n}" "nA" 0 1', '"C1" "cD" 0 1', "!entry.r{n}.unit.bonds", '"X" "y" 0 1']))


@query(_types_sql([(2, "'C' || n_nationkey", "'cA'"), (4, "'H1'", "'hA'")]))
def prepc_types(spark, t):
    """Atom types of numbered rows below their residue's header, without dummies."""
    return forcefield.prepc_types(_with(_nations(t), ["r{n} XYZ 0", "1 DUMM DU M", "4 C{n} cA M", "x C9 cA M", "5 H1 hA E", "DONE"]))


@query(f"WITH f AS ({_FILES}) SELECT path, CAST(start + 1 AS INTEGER) AS line_no, 'c' || n_nationkey AS type, n_nationkey + 0.5::DOUBLE AS radius FROM f")
def dat_radii(spark, t):
    """Radii of rows below the line that ends in RE; rows without a number are left out."""
    return forcefield.dat_radii(_with(_nations(t), ["MOD4 RE", "c{n} {n}.5 0.1", "d{n} none"]))


@query("""WITH f AS (SELECT n_nationkey AS n, n_nationkey % 2 AS v FROM nation)
SELECT 'f' || n AS path, CASE WHEN v = 0 THEN 3 ELSE 2 END AS version, 'Q' || n AS type, round(CASE WHEN v = 0 THEN 0.47::DOUBLE ELSE power(0.0025::DOUBLE / 0.2::DOUBLE, 1 / 6.0::DOUBLE) END, 9) AS sigma_nm,
round(5 * power(2, 1 / 6.0::DOUBLE) * CASE WHEN v = 0 THEN 0.47::DOUBLE ELSE power(0.0025::DOUBLE / 0.2::DOUBLE, 1 / 6.0::DOUBLE) END, 6) AS radius FROM f""")
def martini_radii(spark, t):
    """Versions of files, sigmas of self-pairs (given, or by C6 and C12) and radii."""
    files = t("nation").withColumns({"path": F.concat(F.lit("f"), F.col("n_nationkey").cast("string")), "start": F.lit(0)})
    rest = ["[ nonbond_params ]", "Q{n} P1 1 0.3 0.1", "", "; end"]
    three = _with(files.where("n_nationkey % 2 = 0"), ["; MARTINI 3 FORCE FIELD", *rest[:2], "Q{n} Q{n} 1 0.47 3.5"])
    two = _with(files.where("n_nationkey % 2 = 1"), ["; MARTINI FORCEFIELD V2.2", *rest[:2], "Q{n} Q{n} 1 0.2 0.0025"])
    lines = three.unionByName(two)
    sigma = forcefield.martini_sigmas(lines).join(forcefield.martini_version(lines), "path")
    return sigma.select("path", "version", "type", F.round("sigma_nm", 9).alias("sigma_nm"), F.round(forcefield.radius_from_sigma(F.col("sigma_nm")), 6).alias("radius"))


@query("SELECT p_partkey, CASE WHEN a <= 0 OR b <= 0 OR a <= b THEN 0 ELSE CAST(greatest(0, least(6, round_even(ln(a / b) / ln(4), 0))) AS INTEGER) END AS times FROM (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS a, CAST(p_size - 5 AS DOUBLE) * (1 + p_partkey % 7 * 90) AS b FROM part)")
def subdivision_count(spark, t):
    """Times to subdivide for a target area."""
    target = (F.col("p_size") - 5).cast("double") * (1 + F.col("p_partkey") % 7 * 90)
    return t("part").select("p_partkey", geo.subdivisions(F.col("p_retailprice").cast("double"), target).cast("int").alias("times"))


@query(""", e AS (SELECT frame, side, sqrt((ax - bx) ** 2 + (ay - by_) ** 2 + (az - bz) ** 2) AS d FROM facets UNION ALL SELECT frame, side, sqrt((bx - cx_) ** 2 + (by_ - cy_) ** 2 + (bz - cz_) ** 2) FROM facets UNION ALL SELECT frame, side, sqrt((cx_ - ax) ** 2 + (cy_ - ay) ** 2 + (cz_ - az) ** 2) FROM facets)
SELECT frame, side, CAST(count(*) / 3 AS BIGINT) AS n, round(avg(d), 6) AS mean_edge FROM e GROUP BY ALL""", ("facets",))
def mean_edge(spark, t):
    """Mean length of the triangles' edges."""
    return _round(trim.mean_edge_length(t("facets")))


@query(""", picked AS (SELECT frame, side, CASE WHEN tri_id % 11 = 0 THEN tri_id + 10000000 ELSE tri_id END AS tri_id, v0, v1, v2 FROM facets)
SELECT frame, side, count(*) AS n, count(*) FILTER (tri_id >= 10000000) AS lost_triangles, CAST(sum(CASE WHEN tri_id < 10000000 THEN CAST(v0 % 13 = 0 AS BIGINT) + CAST(v1 % 13 = 0 AS BIGINT) + CAST(v2 % 13 = 0 AS BIGINT) ELSE 0 END) AS BIGINT) AS lost_corners FROM picked GROUP BY ALL""", ("facets",))
def index_check(spark, t):
    """Picked triangles and corners that the mesh lacks."""
    facets = t("facets")
    picked = facets.select("frame", "side", F.when(F.col("tri_id") % 11 == 0, F.col("tri_id") + 10000000).otherwise(F.col("tri_id")).alias("tri_id"))
    vertices = facets.select("frame", "side", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct().where("vid % 13 <> 0")
    return trim.index_violations(picked, facets, vertices)


@query(""", c AS (SELECT frame, side, unnest([v0, v1, v2]) AS vid, defect_type FROM facets)
SELECT frame, side, vid, round(avg(CASE WHEN defect_type = 1 THEN 15 ELSE 242 END / 255), 6) AS red, round(avg(CASE WHEN defect_type = 1 THEN 15 ELSE 24 END / 255), 6) AS green, round(avg(CASE WHEN defect_type = 1 THEN 15 ELSE 188 END / 255), 6) AS blue FROM c GROUP BY ALL""", ("facets",))
def type_colors(spark, t):
    """Vertex colours by the types of their triangles."""
    return _round(colors.by_type(t("facets")))


@query(""", c AS (SELECT frame, side, unnest([v0, v1, v2]) AS vid, CAST(tri_id % 50 AS BIGINT) * 2654435761 AS m FROM facets WHERE defect)
SELECT frame, side, vid, round(avg((m & 255) / 255), 6) AS red, round(avg(((m >> 8) & 255) / 255), 6) AS green, round(avg(((m >> 16) & 255) / 255), 6) AS blue FROM c GROUP BY ALL""", ("facets",))
def cluster_colors(spark, t):
    """Vertex colours by the clusters of their triangles."""
    members = t("facets").where("defect").select("frame", "side", "tri_id", (F.col("tri_id") % 50).alias("cluster"))
    return _round(colors.by_cluster(t("facets"), members))


@query(""", c AS (SELECT frame, side, tri_id, unnest([1, 2, 3]) AS k, unnest([v0, v1, v2]) AS vid FROM facets WHERE defect), n AS (SELECT *, dense_rank() OVER (PARTITION BY frame, side ORDER BY vid) - 1 AS r FROM c)
SELECT frame, side, tri_id, max(r) FILTER (k = 1) AS v0, max(r) FILTER (k = 2) AS v1, max(r) FILTER (k = 3) AS v2 FROM n GROUP BY ALL""", ("facets",))
def remapped(spark, t):
    """The defects' mesh with vertices numbered anew."""
    return colors.remap(t("facets").where("defect"))


def _worn(t) -> tuple[DataFrame, DataFrame]:
    """The facets with repeated, turned and third triangles, and vertices of which some are double."""
    cols = ["frame", "side", "tri_id", "v0", "v1", "v2", "area"]
    facets = t("facets").select(*cols)
    again = facets.where("tri_id % 5 = 0").select("frame", "side", (F.col("tri_id") + 20000000).alias("tri_id"), F.col("v1").alias("v0"), F.col("v2").alias("v1"), F.col("v0").alias("v2"), "area")
    third = facets.where("tri_id % 7 = 0").select("frame", "side", (F.col("tri_id") + 40000000).alias("tri_id"), "v0", "v1", (F.col("v2") + 80000000).alias("v2"), (F.col("area") / 2).alias("area"))
    worn = facets.unionByName(again).unionByName(third)
    vertices = worn.select("frame", "side", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct().select("frame", "side", "vid", F.when(F.col("vid") % 3 == 0, F.col("vid") % 80000000).otherwise(F.col("vid")).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return worn, vertices


@query(""", w AS (SELECT frame, side, tri_id, v0, v1, v2, area FROM facets UNION ALL SELECT frame, side, tri_id + 20000000, v1, v2, v0, area FROM facets WHERE tri_id % 5 = 0 UNION ALL SELECT frame, side, tri_id + 40000000, v0, v1, v2 + 80000000, area / 2 FROM facets WHERE tri_id % 7 = 0),
u AS (SELECT DISTINCT frame, side, unnest([v0, v1, v2]) AS vid FROM w), p AS (SELECT *, min(vid) OVER (PARTITION BY frame, side, CASE WHEN vid % 3 = 0 THEN vid % 80000000 ELSE vid END) AS one FROM u),
m AS (SELECT frame, side, tri_id, a.one AS v0, b.one AS v1, c.one AS v2, area FROM w JOIN p a USING (frame, side) JOIN p b USING (frame, side) JOIN p c USING (frame, side) WHERE a.vid = v0 AND b.vid = v1 AND c.vid = v2),
s AS (SELECT * FROM m WHERE v0 <> v1 AND v1 <> v2 AND v0 <> v2 QUALIFY row_number() OVER (PARTITION BY frame, side, CASE least(v0, v1, v2) WHEN v0 THEN [v0, v1, v2] WHEN v1 THEN [v1, v2, v0] ELSE [v2, v0, v1] END ORDER BY tri_id) = 1),
e AS (SELECT frame, side, tri_id, area, unnest([[least(v0, v1), greatest(v0, v1)], [least(v1, v2), greatest(v1, v2)], [least(v2, v0), greatest(v2, v0)]]) AS e FROM s),
g AS (SELECT frame, side, tri_id FROM e QUALIFY row_number() OVER (PARTITION BY frame, side, e ORDER BY area DESC, tri_id) > 2)
SELECT frame, side, tri_id, v0, v1, v2 FROM s ANTI JOIN g USING (frame, side, tri_id)""", ("facets",))
def clean_mesh(spark, t):
    """A mesh without double vertices, repeated triangles and third triangles of an edge."""
    return trim.clean(*_worn(t))[0].select("frame", "side", "tri_id", "v0", "v1", "v2")


@query(""", a AS (SELECT DISTINCT frame, x, y FROM beads WHERE label < 7),
h AS (SELECT p.frame, p.x, p.y, q.x AS u, q.y AS v FROM a p JOIN a q ON q.frame = p.frame AND (p.x <> q.x OR p.y <> q.y) WHERE NOT EXISTS (SELECT 1 FROM a r WHERE r.frame = p.frame AND (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0)),
d AS (SELECT b.frame, b.bead, ((v - h.y) * (b.x - h.x) - (u - h.x) * (b.y - h.y)) / sqrt((u - h.x) ** 2 + (v - h.y) ** 2) AS off, least(1, greatest(0, ((b.x - h.x) * (u - h.x) + (b.y - h.y) * (v - h.y)) / ((u - h.x) ** 2 + (v - h.y) ** 2))) AS k, b.x - h.x AS dx, b.y - h.y AS dy, u - h.x AS du, v - h.y AS dv FROM beads b JOIN h USING (frame))
SELECT frame, bead, round(sqrt(min((dx - k * du) ** 2 + (dy - k * dv) ** 2)), 6) AS distance, bool_or(off > 1e-9) OR sqrt(min((dx - k * du) ** 2 + (dy - k * dv) ** 2)) <= 1.5 AS shell FROM d GROUP BY ALL""", ("beads",))
def hull_shell(spark, t):
    """Beads outside of the hull of some, or near its boundary."""
    return _round(trim.hull_shell(t("beads").select("frame", "bead", "x", "y"), t("beads").where("label < 7"), 1.5)).select("frame", "bead", "distance", "shell")


def _paired(t) -> DataFrame:
    return t("facets").withColumn("frame", F.floor(F.col("frame") / 2).cast("long"))


@query(""", f AS (SELECT * REPLACE (CAST(floor(frame / 2) AS BIGINT) AS frame) FROM facets), e AS (SELECT frame, side, tri_id, unnest([[least(v0, v1), greatest(v0, v1)], [least(v1, v2), greatest(v1, v2)], [least(v2, v0), greatest(v2, v0)]]) AS e FROM f),
b AS (SELECT DISTINCT frame, side, tri_id FROM (SELECT *, count(*) OVER (PARTITION BY frame, side, e) AS n FROM e) WHERE n = 1),
two AS (SELECT frame FROM f GROUP BY frame HAVING count(DISTINCT side) = 2),
g AS (SELECT f.frame, f.side, f.tri_id FROM f JOIN b USING (frame, side, tri_id) JOIN two USING (frame) WHERE f.tri_id % 3 <> 0)
SELECT frame, side, tri_id FROM f ANTI JOIN g USING (frame, side, tri_id) WHERE side = 'upper'""", ("facets",))
def edge_trim(spark, t):
    """Upper leaflets without the boundary triangles at which no atom lies between them; atoms at every third triangle, and a wide frame of some around them."""
    facets = _paired(t)
    atoms = facets.select("frame", F.col("cx").alias("x"), F.col("cy").alias("y"), F.when(F.col("tri_id") % 3 == 0, F.col("cz")).otherwise(F.lit(1e9)).alias("z"))
    ring = facets.select("frame").distinct().select("frame", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1e7, 1e7) for y in (-1e7, 1e7)])).alias("c")).select("frame", "c.x", "c.y", F.lit(0.0).alias("z"))
    return trim.trim(facets.where("side = 'upper'"), facets.where("side = 'lower'"), atoms.unionByName(ring)).select("frame", "side", "tri_id")


@query(""", p AS (SELECT f.frame, tri_id AS tri, bead, ((x - cx) * px + (y - cy) * py + (z - cz) * pz) / sqrt(px * px + py * py + pz * pz) AS d FROM facets f JOIN beads b ON b.frame = f.frame AND b.bead % 97 = f.tri_id % 97)
SELECT frame, tri, rpad(CAST(frame AS VARCHAR), 15, ' ') || rpad(CAST(tri AS VARCHAR), 20, ' ') || string_agg(bead || ':' || printf('%.1f', d), '/' ORDER BY bead) AS line FROM p GROUP BY frame, tri""", ("facets", "beads"))
def bead_map(spark, t):
    """Log lines of triangles' candidate beads and their distance from the plane."""
    f = t("facets").select("frame", F.col("tri_id").alias("tri"), "cx", "cy", "cz", F.col("px").alias("nx"), F.col("py").alias("ny"), F.col("pz").alias("nz"), (F.col("tri_id") % 97).alias("k"))
    b = t("beads").select("frame", F.col("bead").alias("serial"), "x", "y", "z", (F.col("bead") % 97).alias("k"))
    return logs.bead_map_lines(f.join(b, ["frame", "k"]))


@query("""SELECT frame, tri_id AS tri, 'frame=' || frame || ' tri=' || tri_id || ' side=' || side || ' local_tri=' || tri_id // 2 || ' head_frac=' || printf('%.5f', (tri_id % 8) / 16.0::DOUBLE) || ' other_frac=' || printf('%.5f', (tri_id % 4) / 8.0::DOUBLE) || ' total_frac=' || printf('%.5f', (tri_id % 8) / 16.0::DOUBLE + (tri_id % 4) / 8.0::DOUBLE)
|| ' ncand=' || tri_id % 48 || ' nused=' || tri_id % 5 || ' mode=' || CASE tri_id % 5 WHEN 0 THEN 'degenerate_triangle' WHEN 1 THEN 'head_above_override' WHEN 2 THEN 'below_min_total_coverage' WHEN 3 THEN 'classified' ELSE 'unknown' END || ' defect=' || CAST(defect AS INTEGER) AS line FROM facets""", ("facets",))
def coverage_log(spark, t):
    """Log lines of triangles' fractions and modes."""
    n = F.col("tri_id")
    head, other = (n % 8) / F.lit(16.0), (n % 4) / F.lit(8.0)
    rows = t("facets").select("frame", n.alias("tri"), "side", F.floor(n / 2).alias("local_tri"), head.alias("head_fraction"), other.alias("other_fraction"), (head + other).alias("total_fraction"), (n % 48).alias("n_candidates"), (n % 5).alias("n_used"), (n % 5).alias("mode_code"), F.col("defect").alias("is_defect"))
    return logs.coverage_lines(rows)
