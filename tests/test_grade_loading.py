"""Grade sheets whose names are looked up."""

from scholarch.operators import grade_loading as G


def test_sheets_that_a_join_does_not_serve_have_keys_of_their_own(spark):
    sheets = spark.range(100).selectExpr("id AS sheet_id", "IF(id < 90, concat('7/', id), NULL) AS matricule", "'Ann' AS nom", "'Lee' AS prenom", "'P' AS programme", "'2000-2001' AS annee", "'g' AS groupe")
    keys = G.with_join_keys(sheets).select("_number", "_name").collect()
    assert all(k._number and k._name for k in keys)
    assert len({k._number for k in keys}) == 100  # null for ten sheets before
    assert len({k._name for k in keys}) == 91 and sum(k._name == "ann lee" for k in keys) == 10  # null for ninety before
