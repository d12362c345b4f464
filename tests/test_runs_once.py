"""Run files are many and small: they are opened once, and all tasks write some."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarch.plans import QUERIES
from scholarch.sources import files


def test_run_files_are_read_once(spark):
    """The query read every run file a second time to learn the page counts of the runs it had found."""
    df = QUERIES["scan_runs_latest"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] json") == 1


def test_latest_run_comes_with_its_own_columns(spark):
    runs = spark.createDataFrame([("/a/d.pdf", "d_1", 1, 5), ("/a/d.pdf", "d_2", 2, 7), ("/a/d.pdf", "e_3", 3, 9)], "file_path string, run_id string, t long, total_pages long")
    runs = runs.withColumn("mtime", F.timestamp_seconds("t"))
    uploads = spark.createDataFrame([(1, "/a/d.pdf", 2), (2, "/a/d.pdf", 3), (3, "/a/d.pdf", None)], "upload_id long, file_path string, t long").withColumn("started_at", F.timestamp_seconds("t"))
    found = files.scan_runs_latest(runs, uploads, "total_pages").select("upload_id", "run_id", "total_pages").orderBy("upload_id").collect()
    assert [tuple(r) for r in found] == [(1, "d_2", 7), (3, "d_2", 7)]


def test_many_run_files_are_listed_in_parts(spark, monkeypatch):
    """The driver listed and planned all run files at once, however many."""
    from scholarch.plans import table_queries as T

    whole = sorted(QUERIES["scan_runs_latest"](spark, "/root/testdata/sf0.001").collect())
    read, real = [], files.scan_runs
    monkeypatch.setattr(T, "RUN_FILES", 8)
    monkeypatch.setattr(files, "scan_runs", lambda s, path, after=None: read.append(len(s.read.option("recursiveFileLookup", True).text(path).inputFiles())) or real(s, path, after))
    assert sorted(QUERIES["scan_runs_latest"](spark, "/root/testdata/sf0.001").collect()) == whole
    assert len(read) > 1 and max(read) < sum(read) and len(whole) > 0
