"""The jobs as queries: each runs twice over the whole tables into one new folder and returns what it wrote; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import defect_report, text_sizes
from jobs.common import config, read_report
from tessera.sources.folders import new_folder


def job1_defect_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defect report over events and embeddings."""
    folder, settings = new_folder(spark, "job1"), config(None, defect_report.__file__)
    for _ in range(2):
        defect_report.run(spark, f"{sf_dir}/events.parquet", f"{sf_dir}/embeddings.parquet", f"{folder}/report", settings)
    return read_report(spark, f"{folder}/report")


def job2_text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size statistics of the lines of documents."""
    folder, settings = new_folder(spark, "job2"), config(None, text_sizes.__file__)
    for _ in range(2):
        text_sizes.run(spark, f"{sf_dir}/documents.parquet", folder, f"{folder}/checkpoint", settings)
    return read_report(spark, f"{folder}/report")


QUERIES = {"job1_defect_report": job1_defect_report, "job2_text_sizes": job2_text_sizes}


def _long(rows: str, section: str, names: str, grp: str = "'all'", at: str = "NULL") -> str:
    cells = ", ".join(f"{{'n': '{n}', 'v': CAST({n} AS DOUBLE)}}" for n in names.split())
    return f"SELECT CAST({grp} AS VARCHAR) AS grp, CAST({at} AS DOUBLE) AS at, u.n AS name, round(u.v, 6) AS value, {section} AS section FROM {rows} q, unnest([{cells}]) t(u)"


#: Histograms of width 1 and their fits for all groups of vals (section, grp, v) at once.
_FITS = """m AS (SELECT section, grp, max(v) AS vmax, CAST(floor(max(v)) AS BIGINT) AS nb FROM vals GROUP BY ALL),
c AS (SELECT vals.section, vals.grp, vmax, nb, CASE WHEN nb = 0 THEN 0 ELSE least(CAST(floor(v - 0.5) AS BIGINT), nb - 1) END AS bin, count(*) AS n
      FROM vals JOIN m ON m.section = vals.section AND m.grp = vals.grp WHERE nb = 0 OR v >= 0.5 AND v <= nb + 0.5 GROUP BY ALL),
hist AS (SELECT section, grp, CASE WHEN nb = 0 THEN (vmax + 1) / 2 ELSE CAST(bin + 1 AS DOUBLE) END AS mid, n, n / sum(n) OVER (PARTITION BY section, grp) AS p FROM c),
g AS (SELECT section, grp, count(*) AS bins, regr_slope(ln(p), mid) AS slope, regr_intercept(ln(p), mid) AS intercept, regr_sxx(ln(p), mid) AS sxx, regr_syy(ln(p), mid) AS syy, regr_sxy(ln(p), mid) AS sxy
      FROM hist WHERE p >= {least} AND mid BETWEEN {low} AND {high} GROUP BY ALL HAVING count(*) >= 3),
fit AS (SELECT section, grp, bins, slope, intercept, 1 - greatest(syy - sxy * sxy / sxx, 0) / syy AS r2, sqrt(greatest(syy - sxy * sxy / sxx, 0) / greatest(bins - 2, 1)) AS rmse, abs(1 / slope) AS pi FROM g)"""
_FIT_NAMES = "bins slope intercept r2 rmse pi"

JOB1_SQL = f"""WITH clusters AS (
  SELECT user_id % 20 AS frame, CASE WHEN event_id % 2 = 0 THEN 'upper' ELSE 'lower' END AS side, CAST(value AS DOUBLE) AS area,
         CASE WHEN event_type IN ('click', 'view') THEN 'bilayer' ELSE 'monolayer' END AS region_type, CAST(event_id % 97 AS DOUBLE) / 97 - 0.5 AS h FROM events),
beads AS (SELECT vec_id % 20 AS frame, 100 * CAST(embedding[1] AS DOUBLE) AS x, 100 * CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
box AS (SELECT frame, (max(x) - min(x)) * (max(y) - min(y)) AS plane FROM beads GROUP BY frame),
real_ AS (SELECT * FROM clusters WHERE isfinite(area) AND area > 0),
ends AS (SELECT min(h) AS lo, max(h) AS hi FROM clusters WHERE isfinite(area) AND isfinite(h)),
vals AS (
  SELECT 'fit' AS section, 'all' AS grp, area AS v FROM real_
  UNION ALL SELECT 'fit_region', region_type, area FROM real_
  UNION ALL SELECT 'fit_segment', CAST(1 + {" + ".join(f"CASE WHEN h >= lo + (hi - lo) / 5 * {i} THEN 1 ELSE 0 END" for i in range(1, 5))} AS VARCHAR), area FROM real_, ends WHERE isfinite(h)),
{_FITS.format(least=0.0001, low=15.0, high=250.0)},
counts AS (SELECT frame, count(*) FILTER (side = 'upper') AS upper, count(*) FILTER (side = 'lower') AS lower, count(*) AS total FROM clusters GROUP BY frame),
sums AS (SELECT frame, sum(area) FILTER (side = 'upper') AS up, sum(area) FILTER (side = 'lower') AS lo, avg(area) FILTER (side = 'upper') AS mup, avg(area) FILTER (side = 'lower') AS mlo, avg(area) AS total FROM real_ GROUP BY frame),
covered AS (SELECT s.frame, 100 * coalesce(up, 0) / plane AS upper, 100 * coalesce(lo, 0) / plane AS lower, 100 * (coalesce(up, 0) + coalesce(lo, 0)) / (2 * plane) AS total FROM sums s JOIN box ON box.frame = s.frame),
sizes AS (SELECT frame, coalesce(mup, 0) AS upper, coalesce(mlo, 0) AS lower, total FROM sums)
{_long("counts", "'counts'", "upper lower total", at="frame")}
UNION ALL {_long("covered", "'coverage'", "upper lower total", at="frame")}
UNION ALL {_long("sizes", "'sizes'", "upper lower total", at="frame")}
UNION ALL {_long("(SELECT * FROM hist WHERE section = 'fit')", "'histogram'", "n p", at="mid")}
UNION ALL {_long("fit", "section", _FIT_NAMES, "grp")}
"""

JOB2_SQL = f"""WITH lines AS (SELECT coalesce(source, '(none)') AS grp, unnest(string_split(text, chr(10))) AS line FROM documents),
sized AS (SELECT grp, CAST(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS DOUBLE) AS v FROM lines),
vals AS (SELECT 'fit' AS section, grp, v FROM sized WHERE v > 0 UNION ALL SELECT 'fit', '(all)', v FROM sized WHERE v > 0),
{_FITS.format(least=0.0001, low=3.0, high=60.0)},
totals AS (SELECT grp, count(*) AS lines, sum(v) AS words, max(v) AS longest FROM vals GROUP BY grp)
{_long("totals", "'totals'", "lines words longest", "grp")}
UNION ALL {_long("hist", "'histogram'", "n p", "grp", "mid")}
UNION ALL {_long("fit", "section", _FIT_NAMES, "grp")}
"""

SQL = {"job1_defect_report": JOB1_SQL, "job2_text_sizes": JOB2_SQL}
