"""Both jobs: reruns, growing input, broken-off batches, odd tables, the command line; equal to their SQL."""

import json
import logging
import subprocess
import sys

import pytest

from jobs import defect_report, queries, text_sizes
from jobs.common import config, read_report

SMALL = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted(map(str, df.select("grp", "at", "name", "value", "section").collect()))


def same_rows(a, b):
    """Equal but for the last digit, which sums in another order may change."""
    key = lambda d: d.astype({"at": float}).fillna({"at": -1.0}).sort_values(["section", "grp", "at", "name"]).reset_index(drop=True)
    a, b = key(a), key(b)
    assert a[["section", "grp", "at", "name"]].equals(b[["section", "grp", "at", "name"]])
    assert (a["value"] - b["value"]).abs().max() < 2e-6


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SMALL).toPandas()[["grp", "at", "name", "value", "section"]], duck(queries.SQL[name])[["grp", "at", "name", "value", "section"]])


def test_report_is_replaced_as_a_whole(spark, tmp_path, caplog):
    out, settings = f"{tmp_path}/report", config(None, defect_report.__file__)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    with caplog.at_level(logging.INFO, "jobs"):
        wrote = defect_report.run(spark, f"{SMALL}/events.parquet", f"{SMALL}/embeddings.parquet", out, settings)
    first = rows(read_report(spark, out))
    assert sum(wrote.values()) == len(first) and "read 1000 clusters" in caplog.text and "wrote" in caplog.text
    assert set(wrote) == {"counts", "coverage", "sizes", "histogram", "fit", "fit_region", "fit_segment"}
    defect_report.run(spark, f"{SMALL}/events.parquet", f"{SMALL}/embeddings.parquet", out, settings)
    assert rows(read_report(spark, out)) == first
    # fewer clusters: no section keeps what it had
    spark.read.parquet(f"{SMALL}/events.parquet").where("event_id < 3").write.parquet(f"{tmp_path}/few")
    wrote = defect_report.run(spark, f"{tmp_path}/few", f"{SMALL}/embeddings.parquet", out, settings)
    assert "fit" not in wrote and read_report(spark, out).where("name = 'total' AND section = 'counts'").agg({"value": "sum"}).first()[0] == 3
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_growing_texts(spark, tmp_path, duck):
    whole = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, out, mark = f"{tmp_path}/documents.parquet", f"{tmp_path}/out", f"{tmp_path}/mark"
    settings = config(None, text_sizes.__file__) | {"max_files": 1}
    whole.where("doc_id < 80").repartition(2).write.parquet(docs)
    assert text_sizes.run(spark, docs, out, mark, settings) == 80
    assert spark.read.parquet(f"{out}/counts").select("batch").distinct().count() == 2  # a file a batch
    assert text_sizes.run(spark, docs, out, mark, settings) == 0
    whole.where("doc_id >= 80").coalesce(1).write.mode("append").parquet(docs)
    assert text_sizes.run(spark, docs, out, mark, settings) == whole.count() - 80
    same_rows(read_report(spark, f"{out}/report").toPandas()[["grp", "at", "name", "value", "section"]], duck(queries.JOB2_SQL)[["grp", "at", "name", "value", "section"]])


def test_broken_batch_counts_once(spark, tmp_path, monkeypatch):
    docs, out, mark = f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/mark"
    spark.createDataFrame([(k, "a b c\nd e\n\nf" * (k + 1), "en", f"s{k % 2}", 1) for k in range(20)], TEXTS).coalesce(1).write.parquet(docs)
    settings = config(None, text_sizes.__file__)
    real = text_sizes.stats.size_counts

    def falls(*a, **k):
        made = real(*a, **k)
        made.withColumn("batch", made.n * 0).write.mode("overwrite").partitionBy("batch").parquet(f"{out}/counts")
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(text_sizes.stats, "size_counts", falls)
    with pytest.raises(Exception, match="lost after the write"):
        text_sizes.run(spark, docs, out, mark, settings)
    monkeypatch.setattr(text_sizes.stats, "size_counts", real)
    assert text_sizes.run(spark, docs, out, mark, settings) == 20
    totals = {(r.grp, r.name): r.value for r in read_report(spark, f"{out}/report").where("section = 'totals'").collect()}
    want = [len(x.split()) for k in range(20) for x in ("a b c\nd e\n\nf" * (k + 1)).split("\n") if x.split()]
    assert (totals["(all)", "lines"], totals["(all)", "words"], totals["(all)", "longest"]) == (len(want), sum(want), max(want))


def test_odd_texts(spark, tmp_path):
    docs, out = f"{tmp_path}/docs", f"{tmp_path}/out"
    spark.createDataFrame([(1, None, "en", "s", 1), (2, "", "en", "s", 1), (3, " \t\n", None, None, None), (None, "one  two\r\nthree", "en", None, 1), (3, "w " * 50_000, "en", "s", 1), (3, "w " * 50_000, "en", "s", 1)], TEXTS).write.parquet(docs)
    text_sizes.run(spark, docs, out, f"{tmp_path}/mark", config(None, text_sizes.__file__))
    totals = {(r.grp, r.name): r.value for r in read_report(spark, f"{out}/report").where("section = 'totals'").collect()}
    assert totals["s", "words"] == 100_000 and totals["(none)", "words"] == 3 and totals["(none)", "lines"] == 2 and totals["(all)", "longest"] == 50_000
    spark.createDataFrame([], TEXTS).write.parquet(f"{tmp_path}/none")
    text_sizes.run(spark, f"{tmp_path}/none", f"{tmp_path}/out2", f"{tmp_path}/mark2", config(None, text_sizes.__file__))
    assert read_report(spark, f"{tmp_path}/out2/report").count() == 0


def test_command_line(tmp_path):
    (tmp_path / "own.json").write_text(json.dumps({"low": 20.0}))
    done = subprocess.run([sys.executable, defect_report.__file__, f"{SMALL}/events.parquet", f"{SMALL}/embeddings.parquet", f"{tmp_path}/report", "--config", f"{tmp_path}/own.json"], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert "wrote" in done.stderr and (tmp_path / "report" / "section=fit").is_dir()
