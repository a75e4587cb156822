"""Views of membrane data over the star-schema tables, the same text for Spark and DuckDB.

Each view is SQL over named tables. DUCK has what differs: the first element of a list is 1 for element_at in either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.folders import bounded

VIEWS = {
    "clusters": """
        SELECT user_id % 20 AS frame, CASE WHEN event_id % 2 = 0 THEN 'upper' ELSE 'lower' END AS side, event_id AS cluster, value AS area,
               CASE WHEN event_type IN ('click', 'view') THEN 'bilayer' ELSE 'monolayer' END AS region_type,
               CAST(event_id % 97 AS DOUBLE) / CAST(97 AS DOUBLE) - CAST(0.5 AS DOUBLE) AS h
        FROM events""",
    "beads": """
        SELECT vec_id % 5 AS frame, vec_id AS bead, 100 * CAST({at}(embedding, 1) AS DOUBLE) AS x, 100 * CAST({at}(embedding, 2) AS DOUBLE) AS y, 100 * CAST({at}(embedding, 3) AS DOUBLE) AS z,
               CASE WHEN label < 3 THEN 'h' WHEN label < 7 THEN 't' ELSE 'n' END AS flag, CAST(2 AS DOUBLE) + CAST(label AS DOUBLE) / CAST(10 AS DOUBLE) AS radius, label
        FROM embeddings""",
    "box": "SELECT frame, max(x) - min(x) AS lx, max(y) - min(y) AS ly, max(z) - min(z) AS lz FROM beads GROUP BY frame",
    "vertices": """
        SELECT CAST(floor(CAST(p_partkey AS DOUBLE) / 400) AS BIGINT) AS band, p_partkey AS vid, CAST(p_partkey % 40 AS DOUBLE) AS x, floor(CAST(p_partkey AS DOUBLE) / 40) AS y,
               CAST(p_retailprice AS DOUBLE) / 500 AS z, p_size
        FROM part""",
    "grid_tris": """
        SELECT a.band AS frame, CASE WHEN a.band % 2 = 0 THEN 'upper' ELSE 'lower' END AS side, 2 * a.vid + a.h AS tri_id,
               CASE WHEN a.h = 0 THEN a.vid ELSE b.vid END AS v0, CASE WHEN a.h = 0 THEN b.vid ELSE d.vid END AS v1, c.vid AS v2,
               CASE WHEN a.h = 0 THEN a.x ELSE b.x END AS ax, CASE WHEN a.h = 0 THEN a.y ELSE b.y END AS ay, CASE WHEN a.h = 0 THEN a.z ELSE b.z END AS az,
               CASE WHEN a.h = 0 THEN b.x ELSE d.x END AS bx, CASE WHEN a.h = 0 THEN b.y ELSE d.y END AS by_, CASE WHEN a.h = 0 THEN b.z ELSE d.z END AS bz,
               c.x AS cx_, c.y AS cy_, c.z AS cz_, a.p_size <= 25 AS defect, CASE WHEN a.p_size % 3 = 0 THEN 1 ELSE 0 END AS defect_type
        FROM (SELECT *, 0 AS h FROM vertices UNION ALL SELECT *, 1 AS h FROM vertices) a JOIN vertices b ON b.vid = a.vid + 1 JOIN vertices c ON c.vid = a.vid + 40 JOIN vertices d ON d.vid = a.vid + 41
        WHERE a.vid % 40 < 39""",
    "facets": """
        SELECT *, 0.5 * sqrt(px * px + py * py + pz * pz) AS area FROM (
        SELECT frame, side, tri_id, v0, v1, v2, defect, defect_type, ax, ay, az, bx, by_, bz, cx_, cy_, cz_, (ax + bx + cx_) / 3 AS cx, (ay + by_ + cy_) / 3 AS cy, (az + bz + cz_) / 3 AS cz,
               (by_ - ay) * (cz_ - az) - (bz - az) * (cy_ - ay) AS px, (bz - az) * (cx_ - ax) - (bx - ax) * (cz_ - az) AS py, (bx - ax) * (cy_ - ay) - (by_ - ay) * (cx_ - ax) AS pz
        FROM grid_tris) t""",
}
#: What each view reads.
NEEDS = {"clusters": ("events",), "beads": ("embeddings",), "box": ("beads",), "vertices": ("part",), "grid_tris": ("vertices",), "facets": ("grid_tris",)}


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        if n in VIEWS:
            out += [x for x in _order(NEEDS[n]) if x not in out]
        if n not in out:
            out.append(n)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view (or table) as a DataFrame; nothing is registered in the session."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _named(VIEWS[name].replace("{at}", "element_at"), NEEDS[name])
    return spark.sql(text, **{n: bounded(view(spark, sf_dir, n)) if f"JOIN {n}" in VIEWS[name] else view(spark, sf_dir, n) for n in NEEDS[name]})


def _named(sql: str, needs: tuple[str, ...]) -> str:
    for n in needs:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return sql


def sql(names: tuple[str, ...], body: str) -> str:
    """DuckDB SQL: the views that body needs, and body."""
    parts = [f"{n} AS ({VIEWS[n].format(at='list_extract')})" for n in _order(names) if n in VIEWS]
    if not parts:
        return body
    glue = "" if body.lstrip().startswith(",") else " "
    return f"WITH RECURSIVE {', '.join(parts)}{glue}{body}"
