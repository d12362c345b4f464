"""Grades from pages: one pass over the pages, values worked out once."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarch.operators import merge as M
from scholarch.plans import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_inscription_reads_the_pages_once(spark):
    """load_grades_inscription made and parsed every page twice, once to count the rows."""
    df = QUERIES["load_grades_inscription"](spark, "/root/testdata/sf0.001")
    assert _plan(df).count("from_json") == 1


def test_inscription_counts_rows_without_a_year(spark):
    students = spark.createDataFrame(
        [("m1", "a", "b", None, 2, 0, 1.0, 1.0), ("m1", "a", "b", None, 1, 0, None, 2.0), (None, "Émile", "Zo-la", "x", 1, 1, 3.0, 3.0)],
        "matricule string, nom string, prenom string, annee string, page_number long, student_index int, annual_avg double, annual_rank double",
    ).select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("avg_s1", "double"), ("avg_s2", "double"), ("final_decision", "string"))])
    cells = spark.createDataFrame([], "matricule string, nom string, prenom string, annee string, page_number long, student_index int, pos int, code string, s1 string, s2 string")
    found = M.load_grades(students, cells)["inscription"].select("etudiant", "annee", "moy", "rang", "n").collect()
    assert sorted(map(tuple, found)) == [("emile zo la", "x", 3.0, 3.0, 1), ("m1", None, None, 2.0, 2)]


def test_notes_are_read_once(spark):
    """The filters on a note repeated its pattern in every one of them."""
    students = spark.createDataFrame([], "matricule string, nom string, prenom string, annee string, page_number long, student_index int, avg_s1 double, avg_s2 double, annual_avg double, annual_rank double, final_decision string")
    cells = spark.createDataFrame([("m", "n", "p", "y", 1, 0, 0, "A", "12,5", "21"), ("m", "n", "p", "y", 1, 0, 1, "", "x", "7")], "matricule string, nom string, prenom string, annee string, page_number long, student_index int, pos int, code string, s1 string, s2 string")
    loaded = M.load_grades(students, cells.repartition(2))
    assert _plan(loaded["resultat"]).count("regexp_extract(") == 2
    assert [tuple(r) for r in loaded["resultat"].collect()] == [("m", "y", "S1", "A", 12.5)]
    reasons = loaded["rejected"].select("periode", "pos", "moy", "reason").orderBy("pos").collect()
    assert [tuple(r) for r in reasons] == [("S2", 0, 21.0, "note outside 0-20"), ("S2", 1, 7.0, "module without a code")]
