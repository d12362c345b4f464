"""Record linkage and learning: every search of the archive against every student."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarch.operators import learning as Le
from scholarch.operators import linkage as L
from scholarch.plans import sqlbase as S
from scholarch.plans.catalog import register

QF = f"""
  SELECT query_id, qn, qp, qm, trim(concat_ws(' ', nullif(qn, ''), nullif(qp, ''))) AS "full", {S.soundex('qn')} AS qsn, {S.soundex('qp')} AS qsp, {S.trigrams('qn')} AS qgn, {S.trigrams('qp')} AS qgp
  FROM (SELECT query_id, {S.norm('nom')} AS qn, {S.norm('prenom')} AS qp, {S.norm('matricule')} AS qm FROM requete)"""
SF = f"""
  SELECT id, sn, sp, sm, {S.soundex('sn')} AS ssn, {S.soundex('sp')} AS ssp, {S.trigrams('sn')} AS sgn, {S.trigrams('sp')} AS sgp, v.variation, least(v.frequence, 5) AS freq
  FROM (SELECT id, {S.norm('nom')} AS sn, {S.norm('prenom')} AS sp, {S.norm('matricule')} AS sm FROM etudiant) e LEFT JOIN variation_nom v ON v.etudiant_id = e.id"""
HIST = "SELECT terme_normalise AS term, etudiant_id AS sid, count(*) AS n FROM recherche_log_named WHERE correction_utilisateur = 1 AND etudiant_id IS NOT NULL GROUP BY ALL"
_NAME_HIT = """((qsn <> '' AND qsn = ssn) OR (qsp <> '' AND qsp = ssp) OR (qn <> '' AND contains(sn, qn)) OR (qp <> '' AND contains(sp, qp))
  OR (qn <> '' AND contains(coalesce(variation, ''), qn)) OR (qp <> '' AND contains(coalesce(variation, ''), qp)))"""
_MAT_HIT = "(qm <> '' AND contains(sm, qm))"
BONUS = """CASE WHEN variation IS NULL OR variation = '' THEN 0.0 WHEN "full" <> '' AND variation = "full" THEN 18.0 + freq WHEN "full" <> '' AND contains(variation, "full") THEN 10.0 + freq
  WHEN qn <> '' AND qp <> '' AND (contains(variation, qn) OR contains(variation, qp)) THEN 7.0 + freq ELSE 0.0 END"""
LONELY = f"SELECT query_id FROM qf WHERE query_id NOT IN (SELECT DISTINCT query_id FROM qf JOIN sf ON ({_NAME_HIT} OR {_MAT_HIT}))"
SCORED = f"""
  SELECT query_id, id, names, mat, sxn, sxp, dn, dp, bonus, hist, variation, "full", qn, qp, sn, sp,
         round((((((((names + mat) + sxn) + sxp) + dn * 12.0::DOUBLE) + dp * 12.0::DOUBLE) + bonus) + hist)::DOUBLE, 2) AS score
  FROM (SELECT query_id, id, qn, qp, sn, sp, variation, "full",
    CASE WHEN qn <> '' AND qp <> '' AND qn = sn AND qp = sp THEN 35.0 ELSE CASE WHEN qn <> '' AND qn = sn THEN 15.0 ELSE 0.0 END + CASE WHEN qp <> '' AND qp = sp THEN 15.0 ELSE 0.0 END END::DOUBLE AS names,
    CASE WHEN qm = '' OR sm = '' THEN 0.0 WHEN qm = sm THEN 22.0 WHEN contains(sm, qm) THEN 10.0 ELSE 0.0 END::DOUBLE AS mat,
    CASE WHEN qsn <> '' AND qsn = ssn THEN 8.0 ELSE 0.0 END::DOUBLE AS sxn, CASE WHEN qsp <> '' AND qsp = ssp THEN 8.0 ELSE 0.0 END::DOUBLE AS sxp,
    ({S.dice('qgn', 'sgn')})::DOUBLE AS dn, ({S.dice('qgp', 'sgp')})::DOUBLE AS dp, ({BONUS})::DOUBLE AS bonus, CASE WHEN query_id IN (SELECT query_id FROM lonely) THEN 0.0 ELSE least(coalesce(h.n, 0) * 3.0, 9.0) END::DOUBLE AS hist
    FROM (SELECT qf.*, sf.* FROM qf JOIN sf ON ({_NAME_HIT} OR {_MAT_HIT}) UNION ALL SELECT qf.*, sf.* FROM lonely JOIN qf USING (query_id) JOIN sf ON true) LEFT JOIN hist h ON h.term = "full" AND h.sid = id)"""
_REASONS = """array_to_string(list_filter([
  CASE WHEN qn <> '' AND qn = sn AND qp <> '' AND qp = sp THEN 'exact nom+prenom' WHEN qn <> '' AND qn = sn THEN 'exact nom' END,
  CASE WHEN NOT (qn <> '' AND qn = sn) AND qp <> '' AND qp = sp THEN 'exact prenom' END,
  CASE mat WHEN 22.0 THEN 'exact matricule' WHEN 10.0 THEN 'partial matricule' END,
  CASE WHEN sxn > 0 THEN 'nom soundex' END, CASE WHEN sxp > 0 THEN 'prenom soundex' END,
  CASE WHEN dn >= 0.45 THEN 'nom trigram ' || printf('%.2f', dn) END, CASE WHEN dp >= 0.45 THEN 'prenom trigram ' || printf('%.2f', dp) END,
  CASE WHEN bonus > 0 THEN CASE WHEN variation = "full" THEN 'historical variation exact match' WHEN contains(variation, "full") THEN 'historical variation partial match' ELSE 'historical variation token match' END END,
  CASE WHEN hist > 0 THEN 'historical user correction' END], lambda r: r IS NOT NULL)[1:8], '; ')"""
TOP = f"SELECT query_id, id AS student_id, rank, score, {_REASONS} AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 5"
LINK = {"qf": QF, "sf": SF, "hist": HIST, "lonely": LONELY, "scored": SCORED}


def _suggest(a, **kw):
    return L.suggest(a.requete(), a.etudiant(), a.variation_nom(), a.recherche_log_named(), **kw)


_KEYS = f"""SELECT id, {S.soundex('n')} AS nom_soundex, {S.soundex('p')} AS prenom_soundex,
  coalesce(array_to_string(list_sort({S.trigrams('n')}), '|'), '') AS nom_trigram, coalesce(array_to_string(list_sort({S.trigrams('p')}), '|'), '') AS prenom_trigram
  FROM (SELECT id, {S.norm('nom')} AS n, {S.norm('prenom')} AS p FROM etudiant)"""
_KEY_COLS = ["id", "nom_soundex", "prenom_soundex", "nom_trigram", "prenom_trigram"]


@register("build_search_keys", _KEYS)
def build_search_keys(a):
    return L.build_search_keys(a.etudiant()).select(_KEY_COLS)


@register("rebuild_search_keys", _KEYS)
def rebuild_search_keys(a):
    stale = a.etudiant().withColumns({c: F.lit("?") for c in _KEY_COLS[1:]})
    return L.rebuild_search_keys(stale).select(_KEY_COLS)


@register(
    "candidates_substring",
    """SELECT 'nom' AS field, q.v AS searched, s.v AS stored, n AS n_students FROM (SELECT DISTINCT qn AS v FROM qf WHERE qn <> '') q JOIN (SELECT sn AS v, count(*) AS n FROM sf WHERE sn <> '' GROUP BY 1) s ON contains(s.v, q.v)
       UNION ALL SELECT 'prenom', q.v, s.v, n FROM (SELECT DISTINCT qp AS v FROM qf WHERE qp <> '') q JOIN (SELECT sp AS v, count(*) AS n FROM sf WHERE sp <> '' GROUP BY 1) s ON contains(s.v, q.v)
       UNION ALL SELECT 'matricule', q.v, s.v, n FROM (SELECT DISTINCT qm AS v FROM qf WHERE qm <> '') q JOIN (SELECT sm AS v, count(*) AS n FROM sf WHERE sm <> '' GROUP BY 1) s ON contains(s.v, q.v)""",
    qf=QF,
    sf=SF,
)
def candidates_substring(a):
    return L.candidates_substring(a.requete(), a.etudiant())


@register(
    "candidates_phonetic",
    """SELECT 'nom' AS field, q.v AS searched, s.v AS stored, n AS n_students FROM (SELECT DISTINCT qn AS v, qsn AS x FROM qf WHERE qn <> '') q JOIN (SELECT sn AS v, ssn AS x, count(*) AS n FROM sf WHERE sn <> '' GROUP BY ALL) s ON s.x = q.x
       UNION ALL SELECT 'prenom', q.v, s.v, n FROM (SELECT DISTINCT qp AS v, qsp AS x FROM qf WHERE qp <> '') q JOIN (SELECT sp AS v, ssp AS x, count(*) AS n FROM sf WHERE sp <> '' GROUP BY ALL) s ON s.x = q.x""",
    qf=QF,
    sf=SF,
)
def candidates_phonetic(a):
    return L.candidates_phonetic(a.requete(), a.etudiant())


@register(
    "candidates_variation",
    """SELECT q.v AS searched, s.variation, n AS n_students FROM (SELECT qn AS v FROM qf WHERE qn <> '' UNION SELECT qp FROM qf WHERE qp <> '') q
       JOIN (SELECT variation, count(*) AS n FROM variation_nom WHERE variation <> '' GROUP BY ALL) s ON contains(s.variation, q.v)""",
    qf=QF,
)
def candidates_variation(a):
    return L.candidates_variation(a.requete(), a.variation_nom())


@register("candidates_union", f"SELECT query_id, count(*) AS n_candidates FROM qf JOIN sf ON ({_NAME_HIT} OR {_MAT_HIT}) GROUP BY query_id UNION ALL SELECT query_id, (SELECT count(*) FROM etudiant) FROM lonely", qf=QF, sf=SF, lonely=LONELY)
def candidates_union(a):
    return L.candidate_counts(a.requete(), a.etudiant(), a.variation_nom())


@register("history_boost", 'SELECT h.term AS "full", h.sid AS student_id, h.n AS n_history FROM hist h WHERE h.term IN (SELECT "full" FROM qf)', qf=QF, hist=HIST)
def history_boost(a):
    return L.history_boost(L.distinct_searches(L.folded_queries(a.requete())), a.recherche_log_named())


@register(
    "variation_bonus",
    f"SELECT qn, qp, count(*) AS n, max(b) AS best FROM (SELECT DISTINCT qn, qp, id, {BONUS} AS b FROM qf JOIN sf ON variation IS NOT NULL) WHERE b > 0 GROUP BY ALL",
    qf=QF,
    sf=SF,
)
def variation_bonus(a):
    """Per search: how many students earn a variation bonus, and the best one."""
    found = L.name_totals(a.requete(), a.etudiant(), a.variation_nom(), learned=True).filter("n_bonus > 0")
    return found.select("qn", "qp", F.col("n_bonus").alias("n"), F.col("best_bonus").alias("best"))


@register(
    "score_candidates",
    """SELECT query_id, count(*) AS n_students, max(score) AS best, sum(round(score * 100))::BIGINT AS total_cents
       FROM (SELECT query_id, id, max(score) AS score FROM scored GROUP BY query_id, id) GROUP BY query_id""",
    **LINK,
)
def score_candidates(a):
    """Per query: all candidates scored in full (names, number, sound, trigrams, variation, history), the best score and the total."""
    return L.candidate_totals(a.requete(), a.etudiant(), a.variation_nom(), a.recherche_log_named())


@register("suggest_topk", "SELECT query_id, student_id, rank, score, reasons FROM top", **LINK, top=TOP)
def suggest_topk(a):
    return _suggest(a).withColumn("reasons", F.array_join("reasons", "; "))


@register("top_k_per_query", "SELECT query_id, student_id, score FROM top WHERE rank = 1", **LINK, top=TOP)
def top_k_per_query(a):
    return _suggest(a, limit=1).select("query_id", "student_id", "score")


@register(
    "log_searches",
    f"""SELECT r.query_id, concat_ws(' ', r.nom, r.prenom, r.matricule) AS terme_recherche, {S.norm("concat_ws(' ', r.nom, r.prenom, r.matricule)")} AS terme_normalise, 'fuzzy_suggestion' AS type_recherche, coalesce(t.n, 0) AS resultats_trouves, 0 AS correction_utilisateur
        FROM requete r LEFT JOIN (SELECT query_id, count(*) AS n FROM top GROUP BY 1) t ON t.query_id = r.query_id""",
    **LINK,
    top=TOP,
)
def log_searches(a):
    return L.log_searches(a.requete(), _suggest(a)).drop("etudiant_id")


_UP = "upper(replace(trim(strip_accents({0})), 'ß', 'SS'))"


@register(
    "name_presence_check",
    f"""SELECT r.query_id, coalesce(bool_or({_UP.format('e.nom')} = {_UP.format('r.nom')} AND {_UP.format('e.prenom')} = {_UP.format('r.prenom')}), false) AS valid
        FROM requete r LEFT JOIN top t ON t.query_id = r.query_id LEFT JOIN etudiant e ON e.id = t.student_id GROUP BY 1""",
    **LINK,
    top=TOP,
)
def name_presence_check(a):
    return L.name_presence_check(a.requete(), _suggest(a), a.etudiant())


SIMPLE = """
  SELECT r.query_id, e.id AS student_id, row_number() OVER (PARTITION BY r.query_id ORDER BY e.nom, e.prenom, e.id) AS rank FROM requete r JOIN etudiant e
  ON contains(lower(e.nom), lower(r.nom)) OR contains(lower(e.prenom), lower(r.prenom)) OR contains(lower(e.matricule), lower(r.matricule))"""


@register("simple_suggestions", "SELECT query_id, student_id, rank, 0.0 AS score FROM simple WHERE rank <= 5", simple=SIMPLE)
def simple_suggestions(a):
    return L.simple_suggestions(a.requete(), a.etudiant()).drop("reasons")


@register("suggest_with_fallback", "SELECT query_id, student_id, rank, score, 'advanced' AS mode FROM top", **LINK, top=TOP)
def suggest_with_fallback(a):
    rows = L.suggest_with_fallback(a.requete(), _suggest(a), L.simple_suggestions(a.requete(), a.etudiant()))
    return rows.drop("reasons")


@register(
    "fulltext_search",
    f"""SELECT q.token, coalesce(count(DISTINCT s.id), 0) AS n_students, min(s.id) AS first_id FROM (SELECT DISTINCT unnest(string_split({S.norm("concat_ws(' ', nom, prenom, matricule)")}, ' ')) AS token FROM requete) q
        LEFT JOIN (SELECT id, unnest(string_split({S.norm("concat_ws(' ', nom, prenom, matricule)")}, ' ')) AS token FROM etudiant) s ON s.token = q.token WHERE q.token <> '' GROUP BY 1""",
)
def fulltext_search(a):
    return L.fulltext_search(a.requete(), a.etudiant())


# --- learning ---------------------------------------------------------------------------------
CONF = f"""
  SELECT c.conf_id, c.selected_student_id AS sid, concat_ws(' ', nullif(trim(c.searched_nom), ''), nullif(trim(c.searched_prenom), ''), nullif(trim(c.searched_matricule), '')) AS raw,
         {S.norm("concat_ws(' ', c.searched_nom, c.searched_prenom, c.searched_matricule)")} AS normed, e.nom || ' ' || e.prenom AS canonical, c.result_count
  FROM confirmation c JOIN etudiant e ON e.id = c.selected_student_id"""


def _learned(term: str, canonical: str, first: str) -> str:
    return f"""SELECT coalesce(v.etudiant_id, k.sid) AS etudiant_id, coalesce(v.variation, k.term) AS variation, CASE WHEN v.frequence IS NULL THEN {first} ELSE v.frequence + coalesce(k.n, 0) END AS frequence,
      k.n IS NOT NULL AS changed, k.canonical AS nom_canonique FROM variation_nom v FULL JOIN (SELECT sid, {term} AS term, count(*) AS n, any_value({canonical}) AS canonical FROM conf GROUP BY ALL) k ON k.sid = v.etudiant_id AND k.term = v.variation"""


@register("confirm_selection", _learned("normed", S.norm("canonical"), "k.n"), conf=CONF)
def confirm_selection(a):
    return Le.confirm_selection(a.confirmation(), a.etudiant(), a.variation_nom()).drop("last_used")


@register("variation_trigger", _learned("raw", "canonical", "k.n + 1"), conf=CONF)
def variation_trigger(a):
    return Le.confirm_selection(a.confirmation(), a.etudiant(), a.variation_nom(), trigger=True).drop("last_used")


@register("confirmation_log", "SELECT conf_id, sid AS etudiant_id, raw AS terme_recherche, normed AS terme_normalise, 'fuzzy_suggestion_selection' AS type_recherche, greatest(result_count, 0) AS resultats_trouves, 1 AS correction_utilisateur FROM conf", conf=CONF)
def confirmation_log(a):
    return Le.confirmation_log(a.confirmation(), a.etudiant())


@register("confirmation_errors", "SELECT conf_id, selected_student_id, 'Student with id=' || selected_student_id::VARCHAR || ' was not found' AS error FROM confirmation WHERE selected_student_id NOT IN (SELECT id FROM etudiant)")
def confirmation_errors(a):
    return Le.confirmation_errors(a.confirmation(), a.etudiant())
