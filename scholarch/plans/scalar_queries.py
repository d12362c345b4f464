"""Column rules over whole tables (text rules over whole document texts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarch.functions import json_text, labels, numbers, text
from scholarch.operators import pages as P
from scholarch.plans import sqlbase as S
from scholarch.plans.catalog import register


def _digest(col):
    return F.md5(col.cast("binary"))


@register("normalize_text", f"SELECT doc_id, md5({S.norm('text')}) AS digest, length({S.norm('text')}) AS n FROM documents")
def normalize_text(a):
    out = text.normalize_text(F.col("text"))
    return a.table("documents").select("doc_id", out.alias("t")).select("doc_id", _digest(F.col("t")).alias("digest"), F.length("t").alias("n"))


@register("normalize_text_exact", f"SELECT doc_id, md5({S.norm('text')}) AS digest FROM documents")
def normalize_text_exact(a):
    return a.table("documents").select("doc_id", _digest(text.normalize_text_exact("text")).alias("digest"))


@register(
    "normalize_text_upper",
    f"SELECT doc_id, md5(upper(replace({S.trim_ws('strip_accents(text)')}, 'ß', 'SS'))) AS digest FROM documents",
)
def normalize_text_upper(a):
    return a.table("documents").select("doc_id", _digest(text.normalize_text_upper(F.col("text"))).alias("digest"))


@register(
    "normalize_ws_lower",
    f"SELECT doc_id, md5(lower(trim(regexp_replace(text, '{S.WS_RE}+', ' ', 'g')))) AS digest FROM documents",
)
def normalize_ws_lower(a):
    return a.table("documents").select("doc_id", _digest(text.normalize_ws_lower(F.col("text"))).alias("digest"))


@register(
    "normalize_code",
    f"SELECT doc_id, md5(upper(replace(regexp_replace(text, '{S.WS_RE}+', '', 'g'), 'ß', 'SS'))) AS digest FROM documents",
)
def normalize_code(a):
    return a.table("documents").select("doc_id", _digest(text.normalize_code(F.col("text"))).alias("digest"))


@register(
    "soundex_key",
    f"SELECT id, {S.soundex('n1')} AS nom_key, {S.soundex('n2')} AS prenom_key FROM (SELECT id, {S.norm('nom')} AS n1, {S.norm('prenom')} AS n2 FROM etudiant)",
)
def soundex_key(a):
    return a.etudiant().select("id", text.soundex_key(F.col("nom")).alias("nom_key"), text.soundex_key(F.col("prenom")).alias("prenom_key"))


@register(
    "trigram_set",
    f"SELECT id, unnest({S.trigrams('n')}) AS gram FROM (SELECT id, {S.norm('nom')} AS n FROM etudiant)",
)
def trigram_set(a):
    return a.etudiant().select("id", F.explode(text.trigram_set(F.col("nom"))).alias("gram"))


@register(
    "trigram_serialize",
    f"SELECT id, coalesce(array_to_string(list_sort({S.trigrams('n')}), '|'), '') AS stored FROM (SELECT id, {S.norm('nom')} AS n FROM etudiant)",
)
def trigram_serialize(a):
    return a.etudiant().select("id", text.trigram_serialize(text.trigram_set(F.col("nom"))).alias("stored"))


@register(
    "trigram_deserialize",
    f"SELECT id, len({S.trigrams('n')}) AS n_grams, list_min({S.trigrams('n')}) AS first_gram FROM (SELECT id, {S.norm('nom')} AS n FROM etudiant)",
)
def trigram_deserialize(a):
    back = text.trigram_deserialize(text.trigram_serialize(text.trigram_set(F.col("nom"))))
    return a.etudiant().select("id", back.alias("g")).select("id", F.size("g").alias("n_grams"), F.array_min("g").alias("first_gram"))


@register(
    "trigram_similarity",
    f"SELECT id, round({S.dice('a', 'b')}, 4) AS dice FROM (SELECT id, {S.trigrams('n1')} AS a, {S.trigrams('n2')} AS b FROM (SELECT id, {S.norm('nom')} AS n1, {S.norm('prenom')} AS n2 FROM etudiant))",
)
def trigram_similarity(a):
    pair = text.trigram_similarity(text.trigram_set(F.col("nom")), text.trigram_set(F.col("prenom")))
    return a.etudiant().select("id", F.round(pair, 4).alias("dice"))


@register(
    "split_name",
    f"""SELECT k, w[1] AS nom, coalesce(array_to_string(w[2:], ' '), '') AS prenom
        FROM (SELECT k, string_split_regex({S.trim_ws('name')}, '\\s+') AS w FROM single)""",
)
def split_name(a):
    parts = text.split_name(F.col("result.student.name"))
    return a.page().filter("result.type = 'single_student'").select("k", parts.alias("p")).select("k", "p.nom", "p.prenom")


@register(
    "full_search_term",
    f"SELECT query_id, concat_ws(' ', nullif({S.trim_ws('nom')}, ''), nullif({S.trim_ws('prenom')}, ''), nullif({S.trim_ws('matricule')}, '')) AS term FROM requete",
)
def full_search_term(a):
    return a.requete().select("query_id", text.full_search_term(F.col("nom"), F.col("prenom"), F.col("matricule")).alias("term"))


@register("first_non_empty", f"SELECT k, {S.fne('df', 'dj', 'observation')} AS decision FROM single")
def first_non_empty(a):
    r = F.col("result")
    picked = text.first_non_empty(r["student"]["decisionFinaleDuConseil"], r["student"]["decisionDeJuin"], r["summary"]["observation"])
    return a.page().filter("result.type = 'single_student'").select("k", picked.alias("decision"))


@register(
    "normalize_matricule",
    "SELECT id, lower(replace(replace(replace(matricule, '-', ''), '_', ''), ' ', '')) AS m FROM (SELECT id, replace(matricule, '/', '-') AS matricule FROM etudiant)",
)
def normalize_matricule(a):
    return a.etudiant().select("id", text.normalize_matricule(F.translate("matricule", "/", "-")).alias("m"))


@register("matricule_suffix4", "SELECT id, substr(matricule, -4) AS suffix FROM etudiant")
def matricule_suffix4(a):
    return a.etudiant().select("id", text.matricule_suffix4(F.col("matricule")).alias("suffix"))


@register(
    "matricule_numeric",
    "SELECT case_id, CASE WHEN generated_matricule GLOB '[0-9]*' THEN regexp_extract(generated_matricule, '^[0-9]+')::BIGINT END AS number FROM pending_case",
)
def matricule_numeric(a):
    return a.pending_case().select("case_id", text.matricule_numeric(F.col("generated_matricule")).alias("number"))


@register(
    "safe_token",
    "SELECT id, rpad(substr(upper(regexp_replace(nom, '[^A-Za-z0-9]', '', 'g')), 1, 3), 3, 'X') AS nom_token, rpad(substr(upper(regexp_replace(prenom, '[^A-Za-z0-9]', '', 'g')), 1, 2), 2, 'X') AS prenom_token FROM etudiant",
)
def safe_token(a):
    return a.etudiant().select("id", text.safe_token(F.col("nom"), 3).alias("nom_token"), text.safe_token(F.col("prenom"), 2).alias("prenom_token"))


@register(
    "year_token",
    "SELECT k, CASE WHEN regexp_extract(coalesce(annee,''), '[0-9]{4}') <> '' THEN right(regexp_extract(annee, '[0-9]{4}'), 2) ELSE '26' END AS token FROM page",
)
def year_token(a):
    return a.page().select("k", text.year_token(F.col("result.annee"), "2026").alias("token"))


@register(
    "strict_academic_year",
    "SELECT k, CASE WHEN try_cast(split_part(year, '/', 2) AS INTEGER) = try_cast(split_part(year, '/', 1) AS INTEGER) + 1 THEN year END AS year FROM single",
)
def strict_academic_year(a):
    return a.page().filter("result.type = 'single_student'").select("k", text.strict_academic_year(F.col("result.student.year")).alias("year"))


@register("image_relative_path", "SELECT k, '/Tmp/p' || k::VARCHAR || '.png' AS path FROM page")
def image_relative_path(a):
    return a.page().select("k", text.image_relative_path(F.col("image_path")).alias("path"))


# --- numbers: every noisy reading of the student pages ---------------------------------
_NOTES = "SELECT s, j, s1 AS x FROM student_module UNION ALL SELECT s, -1, stage FROM student UNION ALL SELECT s, -2, ra FROM student"


def _readings(a):
    rows = P.unnest(a.page(), "result.students", "k", pos="i", item="st")
    base = rows.select((F.col("k") * 3 + F.col("i")).alias("s"), "st")
    extra = F.array(
        F.struct(F.lit(-1).alias("j"), F.col("st.noteDeStage").alias("x")),
        F.struct(F.lit(-2).alias("j"), F.col("st.rang.annuel").alias("x")),
    )
    notes = F.transform("st.modules", lambda m, i: F.struct(i.alias("j"), m["noteS1"].alias("x")))
    return P.unnest(base, F.concat(notes, extra), "s", item="r").select("s", "r.j", "r.x")


@register("coerce_number", f"SELECT s, j, {S.coerce_number('x')} AS value FROM readings", readings=_NOTES)
def coerce_number(a):
    return _readings(a).select("s", "j", numbers.coerce_number(F.col("x")).alias("value"))


@register("coerce_rank", f"SELECT s, j, {S.coerce_rank('x')} AS value FROM readings", readings=_NOTES)
def coerce_rank(a):
    return _readings(a).select("s", "j", numbers.coerce_rank(F.col("x")).alias("value"))


@register("finite_or_null", f"SELECT s, j, {S.finite('x')} AS value FROM readings", readings=_NOTES)
def finite_or_null(a):
    return _readings(a).select("s", "j", numbers.finite_or_null(F.col("x")).alias("value"))


@register("number_or_uncertain", f"SELECT s, j, {S.number_value('x')} AS value, {S.number_unc('x')} AS uncertain FROM readings", readings=_NOTES)
def number_or_uncertain(a):
    return _readings(a).select("s", "j", numbers.number_or_uncertain(F.col("x")).alias("n")).select("s", "j", "n.*")


@register("natural_or_uncertain", f"SELECT s, j, {S.natural_value('x')} AS value, {S.natural_unc('x')} AS uncertain FROM readings", readings=_NOTES)
def natural_or_uncertain(a):
    return _readings(a).select("s", "j", numbers.natural_or_uncertain(F.col("x")).alias("n")).select("s", "j", "n.*")


@register("decimal_avg_or_uncertain", f"SELECT s, j, {S.decimal_value('x')} AS value, {S.decimal_unc('x')} AS uncertain FROM readings", readings=_NOTES)
def decimal_avg_or_uncertain(a):
    return _readings(a).select("s", "j", numbers.decimal_avg_or_uncertain(F.col("x")).alias("n")).select("s", "j", "n.*")


@register("format_academic", f"SELECT s, j, coalesce(printf('%.2f', round({S.finite('x')}, 2)), '') AS shown FROM readings", readings=_NOTES)
def format_academic(a):
    return _readings(a).select("s", "j", numbers.format_academic(numbers.finite_or_null(F.col("x"))).alias("shown"))


# --- vocabulary ---------------------------------------------------------------------------
@register(
    "normalize_decision",
    f"""SELECT s, CASE {S.norm('decision')} WHEN 'admis' THEN 'admis' WHEN 'elimine' THEN 'elimine' WHEN 'elimine e' THEN 'elimine'
        WHEN 'non admis' THEN 'non_admis' WHEN 'provisoirement elimine' THEN 'provisoirement_elimine'
        WHEN 'passage conditionnel' THEN 'passage_conditionnel' WHEN 'ajourne' THEN 'ajourne' END AS code FROM student""",
)
def normalize_decision(a):
    rows = P.merged_students(a.page())
    s = F.col("page_number") * 3 + F.col("pos")
    return rows.select(s.alias("s"), labels.normalize_decision(F.col("decision")).alias("code"))


@register(
    "normalize_section_code",
    "SELECT k, CASE sectionCode WHEN '2_I. TRC' THEN '2-I-TRC' WHEN '2 I TRC' THEN '2-I-TRC' WHEN '77-1I-TRC' THEN '77-1I-TRC' END AS code FROM page",
)
def normalize_section_code(a):
    return a.page().select("k", labels.normalize_section_code(F.col("result.sectionCode")).alias("code"))


@register(
    "module_label",
    "SELECT s, j, trim(regexp_replace(coalesce(nullif(code,''), nullif(name,''), 'Module ' || (j+1)::VARCHAR), '\\s+', ' ', 'g')) AS label FROM student_module",
)
def module_label(a):
    mods = P.unnest(P.merged_students(a.page()), "modules", "page_number", F.col("pos").alias("i"), pos="j")
    label = labels.module_label(F.col("j"), F.col("m.code"), F.col("m.name"), F.col("m.module"), F.col("m.libelle"))
    return mods.select((F.col("page_number") * 3 + F.col("i")).alias("s"), "j", label.alias("label"))


@register("module_coefficient", "SELECT s, j, coef FROM student_module")
def module_coefficient(a):
    mods = P.unnest(P.merged_students(a.page()), "modules", "page_number", F.col("pos").alias("i"), pos="j")
    coef = labels.module_coefficient(F.col("m.coef"), F.col("m.coefficient"), F.col("m.credit"), F.col("m.credits"))
    return mods.select((F.col("page_number") * 3 + F.col("i")).alias("s"), "j", coef.alias("coef"))


_STATUS = """CASE WHEN lower(trim(x)) IN ('completed','complete','done','success','ok') THEN 'completed'
  WHEN lower(trim(x)) IN ('processing','running','in_progress','in-progress') THEN 'processing'
  WHEN lower(trim(x)) IN ('cancelled','canceled') THEN 'cancelled' WHEN lower(trim(x)) IN ('failed','error') THEN 'failed' ELSE 'pending' END"""


@register("normalize_status", f"SELECT event_id, {_STATUS} AS status FROM (SELECT event_id, upper(event_type) || ' ' AS x FROM events)")
def normalize_status(a):
    raw = F.concat(F.upper("event_type"), F.lit(" "))
    return a.table("events").select("event_id", labels.normalize_status(raw).alias("status"))


@register(
    "record_status_label",
    "SELECT k, CASE WHEN status = 'ok' THEN 'Completed' WHEN status = 'failed' THEN 'Failed' WHEN status = 'processing' THEN 'Processing' ELSE 'Unknown' END AS label FROM record",
)
def record_status_label(a):
    return a.record().select("k", labels.record_status_label(F.col("status")).alias("label"))


@register(
    "effective_status",
    f"SELECT k, CASE WHEN s = 'failed' AND total_pages > 0 AND failed_pages = 0 AND ok_pages >= total_pages THEN 'completed' ELSE s END AS status FROM (SELECT *, {_STATUS} AS s FROM (SELECT *, status AS x FROM record))",
)
def effective_status(a):
    c = F.col
    return a.record().select("k", labels.effective_status(c("status"), c("total_pages"), c("ok_pages"), c("failed_pages")).alias("status"))


@register(
    "parse_upload_time",
    """SELECT event_id, strftime(CASE event_id % 3 WHEN 0 THEN date_trunc('day', ts) + INTERVAL '23:59:59' WHEN 1 THEN date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS uploaded FROM events""",
)
def parse_upload_time(a):
    n = F.col("event_id") % 3
    raw = F.when(n == 0, F.date_format("ts", "yyyy-MM-dd")).when(n == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("hier")
    parsed = labels.parse_upload_time(raw)
    return a.table("events").select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("uploaded"))


@register(
    "parse_birth_date",
    "SELECT index, try_cast(date_naissance AS DATE)::VARCHAR AS value, CASE WHEN date_naissance <> '' AND try_cast(date_naissance AS DATE) IS NULL THEN 'bad date: ' || date_naissance END AS error FROM save_row",
)
def parse_birth_date(a):
    rows = a.save_row().select("index", labels.parse_birth_date(F.col("date_naissance")).alias("d"))
    return rows.select("index", F.col("d.value").cast("string").alias("value"), "d.error")


@register(
    "is_transient_error",
    "SELECT k, regexp_matches(lower(error), '429|503|busy|resource exhausted|rate|quota|timeout|temporarily unavailable|try again') AS transient FROM page WHERE error IS NOT NULL",
)
def is_transient_error(a):
    return a.page().filter("error is not null").select("k", labels.is_transient_error(F.col("error")).alias("transient"))


# --- JSON inside answers ------------------------------------------------------------------
@register("extract_json_greedy", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN good END AS found FROM raw_answer")
def extract_json_greedy(a):
    return a.raw_answer().select("doc_id", json_text.json_greedy(F.col("answer")).alias("found"))


@register("extract_json_last_balanced", "SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN good END AS found FROM raw_answer")
def extract_json_last_balanced(a):
    return a.raw_answer().select("doc_id", json_text.json_last_balanced("answer").alias("found"))
