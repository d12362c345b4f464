"""Grade sheets loaded twice into the standing tables: first the sheets of early years, then all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarch.operators import grade_loading as G
from scholarch.plans import sqlbase as S
from scholarch.plans.catalog import register
from scholarch.session import new_location
from scholarch.sources.versions import TableSet

FIRST, SECOND = "2026-01-01T00:00:00", "2026-02-01T00:00:00"
SPLIT = "1995-01-01"

RESOLVED = f"""
  SELECT s.sheet_id, s.dated, s.moy, s.rang, s.decisionJury, p.id AS programme_id, f.id AS formation_id, g.id AS groupe_id, coalesce(n.id, CASE WHEN a.same = 1 THEN a.id END) AS etudiant_id,
         CASE WHEN s.matricule IS NULL AND a.same > 1 THEN 'ambiguous name' WHEN coalesce(n.id, a.id) IS NULL THEN 'unknown student' WHEN p.id IS NULL THEN 'unknown programme'
              WHEN f.id IS NULL THEN 'unknown formation' WHEN g.id IS NULL THEN 'unknown group' END AS reason
  FROM grade_sheet s LEFT JOIN etudiant n ON n.matricule = s.matricule
       LEFT JOIN (SELECT name, min(id) AS id, count(*) AS same FROM (SELECT id, {S.norm("nom || ' ' || prenom")} AS name FROM etudiant) GROUP BY name) a ON s.matricule IS NULL AND a.name = {S.norm("s.nom || ' ' || s.prenom")}
       LEFT JOIN programme p ON p.code = upper(trim(s.programme)) LEFT JOIN annee_universitaire y ON y.annee = replace(s.annee, ' / ', '-')
       LEFT JOIN formation f ON f.programme_id = p.id AND f.annee_univ_id = y.id LEFT JOIN groupe g ON g.formation_id = f.id AND lower(g.code) = s.groupe"""
PLACED = f"""
  SELECT c.sheet_id, c.pos, c.dated, r.etudiant_id, r.formation_id, r.groupe_id, q.id AS periodepgm_id, m.id AS module_id, {S.coerce_number('c.note')} AS moy,
         CASE WHEN q.id IS NULL THEN 'unknown period' WHEN t.id IS NULL THEN 'unknown subject' WHEN m.id IS NULL THEN 'subject not taught in the period'
              WHEN {S.coerce_number('c.note')} IS NULL THEN 'unreadable note' WHEN {S.coerce_number('c.note')} NOT BETWEEN 0 AND 20 THEN 'note outside 0-20' END AS reason
  FROM grade_cell c JOIN resolved r ON r.sheet_id = c.sheet_id AND r.reason IS NULL LEFT JOIN periode_programme q ON q.programme_id = r.programme_id AND q.libelle = upper(c.periode)
       LEFT JOIN matiere t ON lower(t.code) = c.code LEFT JOIN module m ON m.matiere_id = t.id AND m.periode_id = q.id"""
# values of both loads per key (1: early sheets only, 2: all), ids in the order of the load that brought the key
HEADS = f"""
  SELECT etudiant_id, formation_id, arg_max(v, sheet_id) FILTER (dated < DATE '{SPLIT}') AS v1, arg_max(v, sheet_id) AS v2
  FROM (SELECT *, struct_pack(groupe_id := groupe_id, moy := moy, rang := rang, decisionJury := decisionJury) AS v FROM resolved WHERE reason IS NULL) GROUP BY ALL"""
INSCRIBED = f"""
  SELECT row_number() OVER (ORDER BY v1 IS NULL, etudiant_id, formation_id) AS id, etudiant_id, formation_id, v2.groupe_id, v2.moy, v2.rang, v2.decisionJury,
         CASE WHEN v1 IS NULL OR v1 IS DISTINCT FROM v2 THEN '{SECOND}' ELSE '{FIRST}' END AS updated_at FROM heads"""
NOTES = f"""
  SELECT etudiant_id, formation_id, periodepgm_id, module_id, max(v) FILTER (dated < DATE '{SPLIT}') AS v1, max(v) AS v2
  FROM (SELECT *, struct_pack(sheet_id := sheet_id, pos := pos, moy := moy, groupe_id := groupe_id) AS v FROM placed WHERE reason IS NULL) GROUP BY ALL"""
PERIODS = """
  SELECT i.id AS inscription_id, periodepgm_id, max(v1).groupe_id AS g1, max(v2).groupe_id AS g2, sum(round(v1.moy * 100)::BIGINT) / (100.0 * count(v1.moy)) AS m1, sum(round(v2.moy * 100)::BIGINT) / (100.0 * count(*)) AS m2
  FROM notes n JOIN inscribed i ON i.etudiant_id = n.etudiant_id AND i.formation_id = n.formation_id GROUP BY ALL"""
PERIOD_ROWS = f"""
  SELECT row_number() OVER (ORDER BY g1 IS NULL, inscription_id, periodepgm_id) AS id, inscription_id, periodepgm_id, g2 AS groupe_id, m2 AS moy,
         CASE WHEN g1 IS NULL OR g1 <> g2 OR m1 <> m2 THEN '{SECOND}' ELSE '{FIRST}' END AS updated_at FROM periods"""
RESULTS = f"""
  SELECT row_number() OVER (ORDER BY n.v1 IS NULL, p.id, n.module_id) AS id, p.id AS inscriptionPer_id, n.module_id, n.v2.moy AS moy,
         CASE WHEN n.v1 IS NULL OR n.v1.moy <> n.v2.moy THEN '{SECOND}' ELSE '{FIRST}' END AS updated_at
  FROM notes n JOIN inscribed i ON i.etudiant_id = n.etudiant_id AND i.formation_id = n.formation_id JOIN period_rows p ON p.inscription_id = i.id AND p.periodepgm_id = n.periodepgm_id"""
PARTS = {"resolved": RESOLVED, "placed": PLACED, "heads": HEADS, "inscribed": INSCRIBED, "notes": NOTES, "periods": PERIODS, "period_rows": PERIOD_ROWS}


def loaded(a) -> TableSet:
    """The standing tables after both loads."""
    tables = TableSet(a.spark, new_location(a.spark, "grades")).create(G.STANDING)
    ref = {n: getattr(a, n)() for n in ("etudiant", "programme", "annee_universitaire", "formation", "groupe", "periode_programme", "matiere", "module")}
    early = F.col("dated") < F.lit(SPLIT).cast("date")
    G.load_grade_tables(a.grade_sheet().where(early), a.grade_cell().where(early), ref, tables, FIRST)
    G.load_grade_tables(a.grade_sheet(), a.grade_cell(), ref, tables, SECOND)
    return tables


@register("load_grades_tables_inscription", "SELECT id, etudiant_id, formation_id, groupe_id, moy, rang, decisionJury, updated_at FROM inscribed", **PARTS)
def load_grades_tables_inscription(a):
    return loaded(a).read("inscription")


@register("load_grades_tables_period", "SELECT id, inscription_id, periodepgm_id, groupe_id, moy, updated_at FROM period_rows", **PARTS)
def load_grades_tables_period(a):
    return loaded(a).read("inscription_periode")


@register("load_grades_tables_result", RESULTS, **PARTS)
def load_grades_tables_result(a):
    return loaded(a).read("resultat")


@register(
    "load_grades_tables_rejected",
    "SELECT sheet_id, NULL::INTEGER AS pos, reason FROM resolved WHERE reason IS NOT NULL UNION ALL SELECT sheet_id, pos, reason FROM placed WHERE reason IS NOT NULL",
    **PARTS,
)
def load_grades_tables_rejected(a):
    return loaded(a).read("rejected")
