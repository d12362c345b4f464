"""Lookups, audits, identity, merging, views, aggregates and rankings over whole tables."""

from __future__ import annotations

import datetime
import math
import time

from pyspark.sql import functions as F

from scholarch import schemas
from scholarch.operators import identity as I
from scholarch.operators import lookups as K
from scholarch.operators import merge as M
from scholarch.operators import pages as P
from scholarch.operators import quality as Q
from scholarch.operators import reporting as R
from scholarch.plans import sqlbase as S
from scholarch.plans.catalog import register
from scholarch.plans.page_queries import CELLS, SUMMARY, UNIFIED
from scholarch.session import new_location, spread
from scholarch.sources import files

NOW = "2026-01-01T00:00:00"
RUN_FILES = 20_000  # run files that the driver lists at a time


def _records(a):
    return K.project_completed_record(a.record())


REC = "SELECT k, batch_id || '::Doc_' || k::VARCHAR || '.pdf' AS id, batch_id, 'Doc_' || k::VARCHAR || '.pdf' AS file_name, status, processed_s, total_pages, ok_pages, failed_pages, NULL::VARCHAR AS error FROM record"


# --- scans, sinks' row logic, projections -------------------------------------------------
@register("scan_table", "SELECT id, nom, prenom, matricule FROM etudiant ORDER BY id LIMIT 50 OFFSET 20")
def scan_table(a):
    """The student table written, then read back in part by the operator."""
    path = new_location(a.spark, "etudiant")
    a.etudiant().write.parquet(path)
    return files.scan_table(a.spark, path, "id", offset=20, limit=50).select("id", "nom", "prenom", "matricule")


@register(
    "document_manifest_filter",
    """SELECT upload_id, CASE WHEN file_name = '' THEN 'Missing filename' WHEN NOT (mime_type = 'application/pdf' OR lower(file_name) LIKE '%.pdf') THEN 'Only PDF files are supported'
       WHEN bytes <= 0 THEN 'Uploaded file is empty' WHEN bytes > 104857600 THEN 'File is too large' END AS reason FROM upload""",
)
def document_manifest_filter(a):
    return K.document_manifest(a.upload()).select("upload_id", "reason")


@register("project_completed_record", "SELECT r.id, r.batch_id, r.file_name, r.status, r.total_pages, r.ok_pages, r.failed_pages, r.total_pages AS n_pages FROM rec r", rec=REC)
def project_completed_record(a):
    return _records(a).select("id", "batch_id", "file_name", "status", "total_pages", "ok_pages", "failed_pages", F.size("pages").cast("long").alias("n_pages"))


@register(
    "write_completed",
    "SELECT batch_id, batch_id || '::Doc_' || k::VARCHAR || '.pdf' AS id, record_status AS status, page_number, status AS page_status, kind FROM record_page WHERE record_status IN ('ok', 'failed')",
)
def write_completed(a):
    """Written twice (the second time one batch is replaced), then read back with the nested pages."""
    path = new_location(a.spark, "completed")
    rows = _records(a).drop("k")
    files.write_completed(rows, path)
    files.write_completed(rows.filter("batch_id = 'batch_3'"), path)
    pages = a.spark.read.parquet(path).select("batch_id", "id", "status", F.explode("pages").alias("p"))
    return pages.select("batch_id", "id", "status", F.col("p.page_number").alias("page_number"), F.col("p.status").alias("page_status"), F.col("p.kind").alias("kind"))


@register("scan_completed", "SELECT id, batch_id, file_name, status, total_pages, total_pages AS n_pages FROM rec", rec=REC)
def scan_completed(a):
    """Files of several pretty-printed batch documents, one of them broken, read back as records."""
    path = new_location(a.spark, "batches")
    rec = _records(a).withColumn("processed_at", F.col("processed_at").cast("string")).withColumn("error", F.lit(None).cast("string"))
    pages = F.transform("pages", lambda p: F.struct(p["page_number"].alias("page_number"), p["status"].alias("status"), p["image_path"].alias("image_path"), p["error"].alias("error")))
    record = F.struct("id", "batch_id", "file_name", "processed_at", "status", "error", "total_pages", "ok_pages", "failed_pages", "pages")
    batch = F.struct("batch_id", "processed_at", F.lit(1).alias("count"), F.array(record).alias("records"))
    docs = rec.withColumn("pages", pages).select((F.col("k") / 2000).cast("long").alias("part"), F.to_json(batch, {"pretty": "true"}).alias("doc"))
    # about five hundred orders a file, so files grow in number and not in size
    whole = docs.groupBy("part").agg(F.concat(F.lit("[\n"), F.concat_ws(",\n", F.collect_list("doc")), F.lit("\n]")).alias("value"))
    whole.write.partitionBy("part").text(path)
    a.spark.createDataFrame([("{\n broken",)], "value string").write.text(f"{path}/part=-1")
    found = files.scan_completed(a.spark, path)
    return found.select("id", "batch_id", "file_name", "status", "total_pages", F.size("pages").cast("long").alias("n_pages"))


@register(
    "scan_runs_latest",
    """SELECT upload_id, 'doc_' || (upload_id // 20)::VARCHAR || '_new' AS run_id, pages FROM (
         SELECT o_custkey AS upload_id, max(o_orderkey) AS k, max(o_orderkey) % 9 + 1 AS pages FROM orders GROUP BY o_custkey) WHERE k % 3 > 0""",
)
def scan_runs_latest(a):
    """Runs written to disk in two waves; uploads that began between them look for the newer one.

    The last order of a customer is a run of the second wave, unless its key is a multiple of three;
    such a customer's run lies in a folder under another name.
    """
    folder = new_location(a.spark, "runs")
    o = a.table("orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"))
    stem = F.concat(F.lit("doc_"), F.expr("c div 20").cast("string"))  # a folder holds the runs of twenty customers
    path = F.concat(F.lit("/up/"), F.col("c").cast("string"), F.lit("/"), stem, F.lit(".pdf"))
    last = o.groupBy("c").agg(F.max("k").alias("k"))
    # up to three files of each stem, in parts that the driver can list one at a time
    parts = math.ceil(3 * o.select(stem.alias("s")).distinct().count() / RUN_FILES) or 1
    part = F.pmod(F.xxhash64(stem), F.lit(parts)).alias("part")
    fields = [part, path.alias("file_path"), (F.col("k") % 9 + 1).cast("long").alias("total_pages")]

    def write(rows, place):
        # a file takes long for its few bytes, so all tasks write some
        listed = spread(rows, "run").groupBy("part", "run").agg(F.to_json(F.collect_list(F.struct("file_path", "total_pages"))).alias("value"))
        listed.write.partitionBy("part", "run").text(f"{folder}/{place}")

    write(o.select(*fields, F.concat(stem, F.lit("_old")).alias("run")), "first")
    time.sleep(1.1)  # file times may be whole seconds
    began = datetime.datetime.now(datetime.UTC)
    time.sleep(1.1)
    fresh = last.where("k % 3 > 0").select(*fields, F.concat(stem, F.lit("_new")).alias("run"))
    elsewhere = last.where("k % 3 = 0").select(*fields, F.concat(F.lit("other_"), stem).alias("run"))
    write(fresh.union(elsewhere), "second")
    folders = [f"{folder}/*/part={r.part}" for r in o.select(part).distinct().collect()] if parts > 1 else [folder]
    runs = files.scan_runs_in_parts(a.spark, folders, began.strftime("%Y-%m-%dT%H:%M:%S"))
    uploads = last.select(F.col("c").alias("upload_id"), path.alias("file_path"), F.lit(began).cast("timestamp").alias("started_at"))
    found = files.scan_runs_latest(runs.withColumn("run_id", F.regexp_replace("run_id", "^run=", "")), uploads, "total_pages")
    return found.select("upload_id", "run_id", F.col("total_pages").alias("pages"))


@register("append_pending", "SELECT case_id::VARCHAR AS case_id, status, nom, prenom FROM (SELECT * FROM pending_case UNION ALL SELECT * FROM pending_case)")
def append_pending(a):
    """The queue appended twice as JSON lines and scanned back."""
    path = new_location(a.spark, "queue")
    cases = a.pending_case().withColumn("case_id", F.col("case_id").cast("string"))
    files.append_pending(cases, path)
    files.append_pending(cases, path)
    return files.scan_pending(a.spark, path).select("case_id", "status", "nom", "prenom")


@register("scan_pending", "SELECT case_id::VARCHAR AS case_id, nom, prenom, generated_matricule FROM pending_case")
def scan_pending(a):
    path = new_location(a.spark, "queue")
    lines = a.pending_case().withColumn("case_id", F.col("case_id").cast("string"))
    good = lines.select(F.to_json(F.struct(*lines.columns)).alias("value"))
    noise = lines.limit(3).select(F.lit("not json").alias("value"))
    good.union(noise).write.text(path)
    return files.scan_pending(a.spark, path).select("case_id", "nom", "prenom", "generated_matricule")


@register(
    "rewrite_pending",
    f"""SELECT case_id::VARCHAR AS case_id, nom, CASE WHEN status = 'pending' AND case_id % 2 = 0 THEN 'resolved' ELSE status END AS status,
        CASE WHEN status = 'pending' AND case_id % 2 = 0 THEN '{NOW}' END AS resolved_at FROM pending_case""",
)
def rewrite_pending(a):
    """A queue on disk, read, the even cases closed, and the new version read back."""
    path = new_location(a.spark, "queue")
    files.append_pending(a.pending_case().withColumn("case_id", F.col("case_id").cast("string")), path)
    even = a.pending_case().filter("case_id % 2 = 0").select("case_id")
    version = files.rewrite_pending(a.spark, path, even, NOW)
    return files.scan_pending(a.spark, version or path).select("case_id", "nom", "status", "resolved_at")


@register(
    "delete_completed",
    "SELECT id, CASE status WHEN 'ok' THEN 'kept' ELSE 'deleted' END AS outcome FROM rec WHERE status IN ('ok', 'failed') UNION ALL SELECT 'batch_0::none.pdf', 'not found'",
    rec=REC,
)
def delete_completed(a):
    """A store on disk without its failed records, read back beside the report of the wanted ids."""
    path = new_location(a.spark, "completed")
    rows = _records(a).drop("k")
    files.write_completed(rows, path)
    missing = a.spark.createDataFrame([("batch_0::none.pdf",)], "id string")
    version, report = files.delete_completed(a.spark, path, rows.filter("status = 'failed'").select("id").union(missing))
    kept = a.spark.read.parquet(version).select("id", F.lit("kept").alias("outcome"))
    return kept.union(report.select("id", F.when(F.col("found"), "deleted").otherwise("not found").alias("outcome")))


@register(
    "export_combined",
    """SELECT 'student' AS kind, k, nom, prenom, NULL::VARCHAR AS abrev, NULL::VARCHAR AS libelle, nm::BIGINT AS n_modules, '1978-1979' AS annee FROM unified
       UNION ALL SELECT 'module', k, NULL, NULL, abrev, libelle, NULL, '1978-1979' FROM matiere_row""",
    unified=UNIFIED,
)
def export_combined(a):
    """Students with their modules and subject rows in one result, read back."""
    path, pages = new_location(a.spark, "export"), a.page()
    files.export_combined(P.parse_students(pages), P.parse_matieres(pages), path, "1978-1979")
    schema = "kind string, page_number long, nom string, prenom string, abrev string, libelle string, modules array<struct<code: string>>, annee string"
    back = a.spark.read.schema(schema).json(path)
    modules = F.when(F.col("kind") == "student", F.coalesce(F.when(F.col("modules").isNotNull(), F.size("modules")), F.lit(0)).cast("long"))
    return back.select("kind", F.col("page_number").alias("k"), "nom", "prenom", "abrev", "libelle", modules.alias("n_modules"), "annee")


@register("lookup_by_key", "SELECT id, matricule FROM etudiant WHERE matricule IN (SELECT generated_matricule FROM pending_case)")
def lookup_by_key(a):
    return K.lookup_by_key(a.etudiant(), a.pending_case().withColumnRenamed("generated_matricule", "matricule"), "matricule").select("id", "matricule")


@register("search_by_name", "SELECT id, nom, prenom FROM etudiant WHERE contains(lower(nom), 'an') OR contains(lower(prenom), 'an') OR contains(lower(matricule), 'an') ORDER BY nom, prenom, id LIMIT 20")
def search_by_name(a):
    return K.search_by_name(a.etudiant(), " AN ").select("id", "nom", "prenom")


@register(
    "find_completed_record",
    """SELECT o.k AS operation_id, r.id AS record_id FROM record o JOIN rec r ON r.batch_id = o.batch_id AND lower(r.file_name) = lower('Doc_' || o.k::VARCHAR || '.pdf') WHERE o.k % 2 = 0
       UNION ALL SELECT o.k, r.id FROM record o JOIN rec r ON lower(r.file_name) = lower('Doc_' || o.k::VARCHAR || '.pdf') WHERE o.k % 2 = 1""",
    rec=REC,
)
def find_completed_record(a):
    ops = a.record().select(F.col("k").alias("operation_id"), F.when(F.col("k") % 2 == 0, F.col("batch_id")).alias("batch_id"), F.upper("file_path").alias("saved_path"))
    return K.find_completed_record(ops, _records(a).withColumn("pos", F.col("k")))


@register(
    "find_source_document",
    """SELECT r.id, coalesce(b.upload_id, w.upload_id) AS upload_id FROM (SELECT k || 'r' AS id, 'batch_' || (k % 20)::VARCHAR AS batch_id, 'Doc_' || (k % 100)::VARCHAR || '.pdf' AS file_name FROM record) r
       JOIN (SELECT substr(file_name, 5) AS f, arg_max(upload_id, mtime_s) AS upload_id FROM upload WHERE file_name <> '' GROUP BY 1) w ON w.f = r.file_name
       LEFT JOIN (SELECT substr(file_name, 5) AS f, batch_id, arg_max(upload_id, mtime_s) AS upload_id FROM upload WHERE file_name <> '' GROUP BY 1, 2) b ON b.f = r.file_name AND b.batch_id = r.batch_id""",
)
def find_source_document(a):
    k = F.col("k")
    recs = a.record().select(F.concat(k.cast("string"), F.lit("r")).alias("id"), F.concat(F.lit("batch_"), (k % 20).cast("string")).alias("batch_id"), F.concat(F.lit("Doc_"), (k % 100).cast("string"), F.lit(".pdf")).alias("file_name"))
    return K.find_source_document(recs, a.upload())


@register(
    "match_record_selection",
    """SELECT s.k AS selection_id, arg_min(r.id, r.k) AS matched_id FROM record s JOIN rec r ON r.id = CASE WHEN s.k % 3 = 0 THEN s.batch_id || '::Doc_' || s.k::VARCHAR || '.pdf' ELSE 'none' END
       OR lower(r.file_name) = lower(CASE WHEN s.k % 2 = 0 THEN 'Doc_' || (s.k // 2)::VARCHAR || '.PDF' ELSE '' END) GROUP BY 1""",
    rec=REC,
)
def match_record_selection(a):
    k = F.col("k")
    sel = a.record().select(
        k.alias("selection_id"),
        F.when(k % 3 == 0, F.concat("batch_id", F.lit("::Doc_"), k.cast("string"), F.lit(".pdf"))).otherwise("none").alias("record_id"),
        F.when(k % 2 == 0, F.concat(F.lit("Doc_"), F.floor(k / 2).cast("string"), F.lit(".PDF"))).otherwise("").alias("file_name"),
    )
    return K.match_record_selection(sel, _records(a).withColumn("pos", k))


def _browse_rows(a):
    i = a.inscription().select("id", "etudiant_id", F.round("moy", 2).alias("avg"), F.col("decisionJury").alias("status"), F.year("date_inscription").cast("string").alias("promo"))
    e = a.etudiant().select(F.col("id").alias("etudiant_id"), F.concat_ws(" ", "nom", "prenom").alias("name"), F.col("matricule").alias("mat"))
    return i.join(e, "etudiant_id")


BROWSE = "SELECT i.id, i.moy AS avg, i.decisionJury AS status, year(i.date_inscription)::VARCHAR AS promo, e.nom || ' ' || e.prenom AS name, e.matricule AS mat FROM inscription i JOIN etudiant e ON e.id = i.etudiant_id"


@register("browse_filter", "SELECT id, name FROM browse WHERE (contains(lower(name), 'th') OR contains(mat, 'th')) AND promo = '1997' AND status = 'Admis'", browse=BROWSE)
def browse_filter(a):
    return K.browse_filter(_browse_rows(a), " TH ", "1997", "Admis").select("id", "name")


@register("dashboard_search", "SELECT id, name FROM browse WHERE contains(lower(name), 'un') OR contains(mat, 'Un') ORDER BY id LIMIT 20", browse=BROWSE)
def dashboard_search(a):
    return K.dashboard_search(_browse_rows(a), "Un", "id").select("id", "name")


@register("browse_page", "SELECT id, name FROM browse ORDER BY name, id LIMIT 10 OFFSET 30", browse=BROWSE)
def browse_page(a):
    return K.browse_page(_browse_rows(a), ["name", "id"], 4)[0].select("id", "name")


@register("student_summary", "SELECT id, nom, prenom, nom || ' ' || prenom AS full_name, matricule, date_naissance, sexe FROM etudiant")
def student_summary(a):
    return K.student_summary(a.etudiant())


@register("latest_per_key", "SELECT operation_id, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY operation_id ORDER BY updated_at DESC, event_id DESC) AS rn FROM operation_event) WHERE rn = 1")
def latest_per_key(a):
    return K.latest_per_key(a.operation_event(), ["operation_id"], F.struct("updated_at", "event_id")).select("operation_id", "event_id", "status")


# --- audits -------------------------------------------------------------------------------
_PARENTS = {t: t for t in ("annee_universitaire", "programme", "etudiant", "formation", "groupe", "matiere", "periode_programme", "module", "inscription", "inscription_periode", "resultat", "variation_nom")}


@register(
    "audit_checks",
    """SELECT 'etudiant' AS "table", id AS row_key, 'sexe' AS rule FROM etudiant WHERE sexe NOT IN ('M','F','Autre')
       UNION ALL SELECT 'resultat', inscriptionPer_id, 'moy' FROM resultat WHERE moy NOT BETWEEN 0 AND 20 UNION ALL SELECT 'resultat', inscriptionPer_id, 'note_cc' FROM resultat WHERE note_cc NOT BETWEEN 0 AND 20
       UNION ALL SELECT 'resultat', inscriptionPer_id, 'note_exam' FROM resultat WHERE note_exam NOT BETWEEN 0 AND 20 UNION ALL SELECT 'inscription', id, 'moy' FROM inscription WHERE moy NOT BETWEEN 0 AND 20
       UNION ALL SELECT 'matiere', id, 'coefficient' FROM matiere WHERE coefficient <= 0 UNION ALL SELECT 'annee_universitaire', id, 'dates' FROM annee_universitaire WHERE date_fin <= date_debut
       UNION ALL SELECT 'variation_nom', etudiant_id, 'frequence' FROM variation_nom WHERE frequence < 1""",
)
def audit_checks(a):
    return Q.audit_checks(a.relational())


_UNIQUE = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{','.join(c)}' AS key, concat_ws('|', {', '.join(f'{x}::VARCHAR' for x in c)}) AS value, count(*) AS n FROM {t} GROUP BY {', '.join(c)} HAVING count(*) > 1"
    for t, c in schemas.UNIQUE_KEYS
)


@register("audit_unique", _UNIQUE)
def audit_unique(a):
    return Q.audit_unique(a.relational())


_FK = " UNION ALL ".join(
    f"SELECT '{c}' AS child, '{col}' AS \"column\", {col}::BIGINT AS value, count(*) AS n FROM {'recherche_log' if c == 'recherche_name_log' else c} WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT id FROM {p}) GROUP BY {col}"
    for c, col, p, _ in schemas.FOREIGN_KEYS
)


@register("audit_foreign_keys", _FK)
def audit_foreign_keys(a):
    return Q.audit_foreign_keys(a.relational())


_DELETED_COUNTS = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS n FROM {'recherche_log' if t == 'recherche_name_log' else t}"
    for t in ("annee_universitaire", "programme", "formation", "groupe", "matiere", "periode_programme", "module", "recherche_name_log")
)


@register(
    "cascade_delete",
    f"""{_DELETED_COUNTS}
       UNION ALL SELECT 'etudiant', count(*) FROM etudiant WHERE id NOT IN (SELECT id FROM gone)
       UNION ALL SELECT 'variation_nom', count(*) FROM variation_nom WHERE etudiant_id NOT IN (SELECT id FROM gone)
       UNION ALL SELECT 'inscription', count(*) FROM left_inscription UNION ALL SELECT 'inscription_periode', count(*) FROM left_period UNION ALL SELECT 'resultat', count(*) FROM left_result
       UNION ALL SELECT 'references to students in the log', count(*) FROM recherche_log WHERE etudiant_id IS NOT NULL AND etudiant_id NOT IN (SELECT id FROM gone)
       UNION ALL SELECT 'refused students', 0
       UNION ALL SELECT 'refused programmes', count(*) FROM programme p WHERE p.id IN (SELECT programme_id FROM formation)
         OR p.id IN (SELECT pp.programme_id FROM periode_programme pp JOIN left_period lp ON lp.periodepgm_id = pp.id)
         OR p.id IN (SELECT pp.programme_id FROM periode_programme pp JOIN module m ON m.periode_id = pp.id JOIN left_result r ON r.module_id = m.id)""",
    gone="SELECT id FROM etudiant WHERE contains(nom, 'a')",
    left_inscription="SELECT * FROM inscription WHERE etudiant_id NOT IN (SELECT id FROM gone)",
    left_period="SELECT ip.* FROM inscription_periode ip JOIN left_inscription li ON li.id = ip.inscription_id",
    left_result="SELECT r.* FROM resultat r WHERE r.inscriptionPer_id NOT IN (SELECT ip.id FROM inscription_periode ip JOIN inscription i ON i.id = ip.inscription_id WHERE i.etudiant_id IN (SELECT id FROM gone))",
)
def cascade_delete(a):
    """Students whose name holds an 'a' are removed with all that hangs on them; then all programmes, which is refused."""
    t = a.relational()
    free, none = Q.cascade_delete(t, "etudiant", t["etudiant"].filter(F.contains("nom", F.lit("a"))).select("id"))
    out, refused = Q.cascade_delete(free, "programme", t["programme"].select("id"))
    parts = [out[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n") for n in t]
    parts.append(out["recherche_name_log"].agg(F.count("etudiant_id").alias("n")).select(F.lit("references to students in the log").alias("table"), "n"))
    for label, ids in (("refused students", none), ("refused programmes", refused)):
        parts.append(ids.agg(F.count("*").alias("n")).select(F.lit(label).alias("table"), "n"))
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result


@register("validate_required_names", "SELECT index, 'failed' AS status, 'nom and prenom are required' AS error FROM save_row WHERE trim(nom) = '' OR trim(prenom) = ''")
def validate_required_names(a):
    return Q.validate_required_names(a.save_row())[1]


# --- identity -------------------------------------------------------------------------------
_KNOWN = """SELECT lower(trim(nom)) AS nk, lower(trim(prenom)) AS pk, arg_min(matricule, id) AS found FROM etudiant GROUP BY 1, 2"""


@register("find_existing_matricule", "SELECT c.case_id, k.found FROM pending_case c LEFT JOIN known k ON k.nk = lower(c.nom) AND k.pk = lower(c.prenom)", known=_KNOWN)
def find_existing_matricule(a):
    return I.find_existing_matricule(a.pending_case(), a.etudiant()).select("case_id", "found")


GOOD = """
  SELECT s.*, nullif(trim(s.matricule), '') AS given, try_cast(s.date_naissance AS DATE) AS birth, lower(trim(s.nom)) AS nk, lower(trim(s.prenom)) AS pk
  FROM save_row s WHERE trim(nom) <> '' AND trim(prenom) <> '' AND NOT coalesce(date_naissance <> '' AND try_cast(date_naissance AS DATE) IS NULL, false)"""
RESOLVED = r"""
  SELECT g.index, g.nk, g.pk, trim(g.nom) AS nom, trim(g.prenom) AS prenom, g.sexe, g.lieu_naissance, g.birth, CASE WHEN given IS NOT NULL THEN 'provided' WHEN is_first_year THEN 'generated_first_year' WHEN found IS NOT NULL OR lead < index THEN 'history' ELSE 'generated_temporary' END AS source,
         given, found, lead, CASE WHEN is_first_year THEN 'ETU' ELSE 'TMP' END || '-' || right(regexp_extract(annee_univ, '[0-9]{4}'), 2) || '-' || rpad(substr(upper(regexp_replace(nom, '[^A-Za-z0-9]', '', 'g')), 1, 3), 3, 'X') || rpad(substr(upper(regexp_replace(prenom, '[^A-Za-z0-9]', '', 'g')), 1, 2), 2, 'X') AS stem
  FROM (SELECT g.*, CASE WHEN g.birth IS NULL THEN k.found ELSE kd.found END AS found,
               CASE WHEN g.birth IS NULL THEN min(index) OVER (PARTITION BY g.nk, g.pk) ELSE min(index) OVER (PARTITION BY g.nk, g.pk, g.birth) END AS lead
        FROM good g LEFT JOIN known k ON k.nk = g.nk AND k.pk = g.pk
        LEFT JOIN (SELECT lower(trim(nom)) AS nk, lower(trim(prenom)) AS pk, date_naissance AS birth, arg_min(matricule, id) AS found FROM etudiant GROUP BY 1, 2, 3) kd ON kd.nk = g.nk AND kd.pk = g.pk AND kd.birth = g.birth) g"""
MASKED = "SELECT r.index, r.source, r.nom, r.prenom, r.sexe, r.lieu_naissance, r.birth, r.source = 'generated_temporary' AS needs_review, CASE r.source WHEN 'provided' THEN r.given WHEN 'history' THEN coalesce(r.found, l.given, l.stem || '-' || l.index::VARCHAR) ELSE r.stem || '-' || r.index::VARCHAR END AS token FROM resolved r LEFT JOIN resolved l ON l.index = r.lead"
ID = {"known": _KNOWN, "good": GOOD, "resolved": RESOLVED, "masked": MASKED}


def _resolved(a):
    accepted, _ = I.acceptable_rows(a.save_row())
    return I.resolve_matricule(accepted, a.etudiant(), salt="r1")


@register("resolve_matricule", r"SELECT index, source, needs_review, regexp_replace(token, '^((TMP|ETU)-..-.....)-.*$', '\1') AS matricule FROM masked", **ID)
def resolve_matricule(a):
    shown = F.regexp_replace("matricule", "^((TMP|ETU)-..-.....)-.*$", "$1")
    return _resolved(a).select("index", "source", "needs_review", shown.alias("matricule"))


@register("generate_matricule", "SELECT source, count(*) AS n, count(DISTINCT token) AS distinct_numbers FROM masked WHERE source LIKE 'generated%' GROUP BY ALL", **ID)
def generate_matricule(a):
    return _resolved(a).filter("source like 'generated%'").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("matricule").alias("distinct_numbers"))


MULTIPLIER = 0x9E377  # of the permutation over five digits, see identity.py


@register(
    "generate_matricule_numbers",
    f"""SELECT index, stem || '-' || upper(lpad(to_hex((slot * {MULTIPLIER} + ('0x' || sha256('r1|' || stem)[1:5])::BIGINT) % 1048576), 5, '0')) AS matricule
        FROM (SELECT index, stem, row_number() OVER (PARTITION BY stem ORDER BY sha256('r1|' || index::VARCHAR)) - 1 AS slot FROM resolved WHERE source LIKE 'generated%')""",
    known=_KNOWN,
    good=GOOD,
    resolved=RESOLVED,
)
def generate_matricule_numbers(a):
    """The numbers themselves; no number of this table's students has the form of a generated one."""
    return _resolved(a).filter("source like 'generated%'").select("index", "matricule")


@register("pending_cases", "SELECT index, nom, prenom, 'pending' AS status FROM masked WHERE source = 'generated_temporary'", **ID)
def pending_cases(a):
    return I.pending_cases(_resolved(a), NOW).select("index", "nom", "prenom", "status")


_CHECK = "SELECT c.*, k.found FROM pending_case c LEFT JOIN known k ON k.nk = lower(c.nom) AND k.pk = lower(c.prenom) WHERE status = 'pending'"


@register("check_pending", "SELECT case_id, found, coalesce(found <> generated_matricule, false) AS matched FROM chk", known=_KNOWN, chk=_CHECK)
def check_pending(a):
    return I.check_pending(a.pending_case(), a.etudiant()).select("case_id", "found", "matched")


@register("check_pending_counts", "SELECT count(*) AS total_pending, count(*) FILTER (found <> generated_matricule) AS matches_found, count(*) - count(*) FILTER (found <> generated_matricule) AS unresolved_count FROM chk", known=_KNOWN, chk=_CHECK)
def check_pending_counts(a):
    return I.check_pending_counts(I.check_pending(a.pending_case(), a.etudiant()))


OUTCOME = """
  SELECT c.case_id, c.generated_matricule AS temporary_matricule, c.found AS found_matricule, t.id AS temporary_student_id, e.id AS existing_student_id,
         CASE WHEN c.found IS NULL THEN 'no_match_found' WHEN c.found = c.generated_matricule THEN 'already_same_matricule' WHEN t.id IS NULL THEN 'temporary_student_not_found' WHEN e.id <> t.id THEN 'real_matricule_already_assigned' ELSE 'update' END AS outcome
  FROM chk c LEFT JOIN (SELECT matricule, min(id) AS id FROM etudiant GROUP BY 1) t ON t.matricule = c.generated_matricule LEFT JOIN (SELECT matricule, min(id) AS id FROM etudiant GROUP BY 1) e ON e.matricule = c.found"""


@register("reconcile_pending", "SELECT * FROM outcome", known=_KNOWN, chk=_CHECK, outcome=OUTCOME)
def reconcile_pending(a):
    return I.reconcile_pending(a.pending_case(), a.etudiant())


@register("conflict_report", "SELECT case_id, outcome FROM outcome WHERE outcome IN ('temporary_student_not_found', 'real_matricule_already_assigned')", known=_KNOWN, chk=_CHECK, outcome=OUTCOME)
def conflict_report(a):
    return I.conflict_report(I.reconcile_pending(a.pending_case(), a.etudiant())).select("case_id", "outcome")


@register(
    "apply_reconciliation",
    f"""SELECT 'student' AS kind, e.id, coalesce(g.number, e.matricule) AS number, NULL::VARCHAR AS status, NULL::VARCHAR AS resolved_at FROM etudiant e LEFT JOIN (SELECT id, arg_max(number, case_id) AS number FROM granted GROUP BY 1) g ON g.id = e.id
        UNION ALL SELECT 'case', c.case_id, g.number, CASE WHEN g.number IS NULL THEN c.status ELSE 'resolved' END, CASE WHEN g.number IS NOT NULL THEN '{NOW}' END FROM pending_case c LEFT JOIN granted g ON g.case_id = c.case_id""",
    known=_KNOWN,
    chk=_CHECK,
    outcome=OUTCOME,
    granted="SELECT case_id, temporary_student_id AS id, 'N/' || case_id::VARCHAR AS number FROM outcome WHERE outcome = 'already_same_matricule' AND case_id % 6 = 0",
)
def apply_reconciliation(a):
    """Both outputs where every sixth case that has its number is granted a new one (outcome `update`)."""
    reconciled = I.reconcile_pending(a.pending_case(), a.etudiant())
    granted = (F.col("outcome") == "already_same_matricule") & (F.col("case_id") % 6 == 0)
    number = F.when(granted, F.concat(F.lit("N/"), F.col("case_id").cast("string"))).otherwise(F.col("found_matricule"))
    given = reconciled.withColumns({"found_matricule": number, "outcome": F.when(granted, "update").otherwise(F.col("outcome"))})
    students, cases = I.apply_reconciliation(given, a.pending_case(), a.etudiant(), NOW, preview=False)
    none = F.lit(None).cast("string")
    rows = students.select(F.lit("student").alias("kind"), "id", F.col("matricule").alias("number"), none.alias("status"), none.alias("resolved_at"))
    return rows.union(cases.select(F.lit("case"), "case_id", "resolved_matricule", "status", "resolved_at"))


# --- merge ----------------------------------------------------------------------------------
FOLD = """
  SELECT m.token, min(m.index) AS first_index, arg_max(m.nom, m.index) AS nom, arg_max(m.prenom, m.index) AS prenom, arg_max(m.sexe, m.index) FILTER (m.sexe IS NOT NULL) AS sexe,
         arg_max(m.lieu_naissance, m.index) FILTER (m.lieu_naissance IS NOT NULL) AS lieu, arg_max(m.birth, m.index) FILTER (m.birth IS NOT NULL) AS birth, any_value(e.id) AS known_id
  FROM masked m LEFT JOIN etudiant e ON e.matricule = m.token GROUP BY m.token"""
IDS = "SELECT *, coalesce(known_id, (SELECT max(id) FROM etudiant) + row_number() OVER (PARTITION BY known_id IS NULL ORDER BY first_index)) AS sid FROM fold"


@register(
    "upsert_students",
    "SELECT e.id, coalesce(f.nom, e.nom) AS nom, coalesce(f.prenom, e.prenom) AS prenom, coalesce(f.sexe, e.sexe) AS sexe, coalesce(f.birth, e.date_naissance)::VARCHAR AS birth, coalesce(f.lieu, e.lieu_naissance) AS lieu FROM etudiant e LEFT JOIN ids f ON f.known_id = e.id UNION ALL SELECT sid, nom, prenom, sexe, birth::VARCHAR, lieu FROM ids WHERE known_id IS NULL",
    **ID,
    fold=FOLD,
    ids=IDS,
)
def upsert_students(a):
    version, _ = M.upsert_students(_resolved(a), a.etudiant(), NOW)
    return version.select("id", "nom", "prenom", "sexe", F.col("date_naissance").cast("string").alias("birth"), F.col("lieu_naissance").alias("lieu"))


@register(
    "upsert_report",
    "SELECT m.index, CASE WHEN i.known_id IS NULL AND m.index = i.first_index THEN 'created' ELSE 'updated' END AS action, i.sid AS student_id, m.source, m.needs_review FROM masked m JOIN ids i ON i.token = m.token",
    **ID,
    fold=FOLD,
    ids=IDS,
)
def upsert_report(a):
    _, saved = M.upsert_students(_resolved(a), a.etudiant(), NOW)
    return saved.select("index", "action", "student_id", "source", "needs_review")


def _patched(a):
    return a.etudiant().filter("sexe is null").select("id", F.lit("Autre").alias("sexe"), F.lit("?").alias("unknown_column"))


@register("touch_updated_at", f"SELECT id, CASE WHEN sexe IS NULL THEN '{NOW}' END AS updated_at FROM etudiant")
def touch_updated_at(a):
    new = M.generic_update(a.etudiant(), _patched(a))
    return M.touch_updated_at(a.etudiant(), new, "id", ["nom", "prenom", "sexe", "matricule"], NOW).select("id", "updated_at")


@register("generic_update", "SELECT id, nom, coalesce(sexe, 'Autre') AS sexe FROM etudiant")
def generic_update(a):
    return M.generic_update(a.etudiant(), _patched(a)).select("id", "nom", "sexe")


@register("delete_by_id", "SELECT DISTINCT o_custkey AS id, o_custkey IN (SELECT id FROM etudiant) AS found FROM orders")
def delete_by_id(a):
    ids = a.table("orders").select(F.col("o_custkey").alias("id"))
    return M.delete_by_id(a.etudiant(), ids)[1]


PERSON = f"coalesce(nullif(u.matricule, ''), {S.norm(chr(34) + 'u' + chr(34) + '.nom || ' + chr(39) + ' ' + chr(39) + ' || u.prenom')})"
LOADED = f"""
  SELECT {PERSON} AS etudiant, p.annee, p.k AS page_number, u.i AS student_index, c.j AS pos, c.code, v.periode, {S.coerce_number("CASE WHEN v.periode = 'S1' THEN c.s1 ELSE c.s2 END")} AS moy
  FROM unified u JOIN page p ON p.k = u.k JOIN cells c ON c.k = u.k AND c.i = u.i CROSS JOIN (VALUES ('S1'), ('S2')) v(periode)"""


@register(
    "load_grades",
    "SELECT etudiant, annee, periode, code, arg_min(moy, page_number * 1000 + student_index * 100 + pos) AS moy FROM loaded WHERE code <> '' AND moy BETWEEN 0 AND 20 GROUP BY ALL",
    unified=UNIFIED,
    cells=CELLS,
    loaded=LOADED,
)
def load_grades(a):
    rows = P.parse_students(a.page().withColumn("annee", F.col("result.annee")), False, "annee")
    cells = P.flatten_modules(rows, "nom", "prenom", "matricule", "annee", "page_number", "student_index")
    return M.load_grades(rows, cells)["resultat"]


@register(
    "load_grades_inscription",
    f"SELECT {PERSON} AS etudiant, p.annee, arg_min(struct_pack(m := u.annual_avg), p.k * 1000 + u.i).m AS moy, count(*) AS n FROM unified u JOIN page p ON p.k = u.k GROUP BY ALL",
    unified=UNIFIED,
)
def load_grades_inscription(a):
    rows = P.parse_students(a.page().withColumn("annee", F.col("result.annee")), False, "annee")
    cells = P.flatten_modules(rows, "nom", "prenom", "matricule", "annee", "page_number", "student_index")
    return M.load_grades(rows, cells)["inscription"].select("etudiant", "annee", "moy", "n")


@register(
    "load_grades_rejected",
    "SELECT etudiant, annee, periode, code, page_number, student_index, pos, moy, CASE WHEN code = '' THEN 'module without a code' ELSE 'note outside 0-20' END AS reason FROM loaded WHERE moy IS NOT NULL AND (code = '' OR moy NOT BETWEEN 0 AND 20)",
    unified=UNIFIED,
    cells=CELLS,
    loaded=LOADED,
)
def load_grades_rejected(a):
    rows = P.parse_students(a.page().withColumn("annee", F.col("result.annee")), False, "annee")
    cells = P.flatten_modules(rows, "nom", "prenom", "matricule", "annee", "page_number", "student_index")
    return M.load_grades(rows, cells)["rejected"]


@register(
    "merge_documents",
    """SELECT coalesce(r.id, d.doc_id) AS doc_id, coalesce(d.name, r.file_name) AS name, CASE WHEN r.id IS NULL THEN 'pending' WHEN r.failed_pages = 0 AND r.ok_pages >= r.total_pages THEN 'completed' ELSE 'failed' END AS status,
       CASE WHEN r.failed_pages = 0 AND r.ok_pages >= r.total_pages THEN NULL WHEN r.id IS NOT NULL THEN 'Only ' || r.ok_pages::VARCHAR || '/' || r.total_pages::VARCHAR || ' pages processed.' END AS error
       FROM docs d FULL JOIN rec r ON lower(r.file_name) = lower(d.name)""",
    rec=REC,
    docs="SELECT 'doc_' || upload_id::VARCHAR AS doc_id, 'Doc_' || (upload_id * 3)::VARCHAR || '.PDF' AS name FROM upload",
)
def merge_documents(a):
    n = F.col("upload_id")
    registry = a.upload().select(F.concat(F.lit("doc_"), n.cast("string")).alias("doc_id"), F.concat(F.lit("Doc_"), (n * 3).cast("string"), F.lit(".PDF")).alias("name"), F.lit("pending").alias("status"))
    return M.merge_documents(registry, _records(a).withColumn("error", F.lit(None).cast("string")), "k").drop("progress")


@register("merge_recent_cap", "SELECT id, status FROM (SELECT id, status, 0 AS src, k FROM rec WHERE status = 'ok' UNION ALL SELECT id, status, 1, k FROM rec WHERE status = 'failed') ORDER BY src, k LIMIT 200", rec=REC)
def merge_recent_cap(a):
    rows = _records(a)
    return M.merge_recent_cap(rows.filter("status = 'ok'"), rows.filter("status = 'failed'"), "k", 200).select("id", "status")


# --- views and aggregates ------------------------------------------------------------------------
@register(
    "current_inscriptions",
    """SELECT * FROM (WITH open_years AS (SELECT id AS annee_univ_id, annee AS annee_universitaire FROM annee_universitaire WHERE date_fin >= DATE '1999-01-01'),
            offered AS (SELECT f.id AS formation_id, annee_universitaire, titre AS programme_titre, code AS programme_code FROM formation f JOIN open_years USING (annee_univ_id) JOIN (SELECT id AS programme_id, code, titre FROM programme) USING (programme_id)),
            placed AS (SELECT id AS inscription_id, etudiant_id, formation_id, groupe_id, rang, "decisionJury", moy AS moyenne_generale FROM inscription WHERE formation_id IN (SELECT formation_id FROM offered))
       SELECT inscription_id, etudiant_id, s.nom, s.prenom, s.matricule, formation_id, programme_code, programme_titre, annee_universitaire, g.groupe, moyenne_generale, "decisionJury", rang
       FROM placed JOIN offered USING (formation_id) JOIN (SELECT id AS groupe_id, code AS groupe FROM groupe) g USING (groupe_id) JOIN (SELECT id AS etudiant_id, nom, prenom, matricule FROM etudiant) s USING (etudiant_id))""",
)
def current_inscriptions(a):
    return R.current_inscriptions(a.relational(), "1999-01-01")


@register(
    "student_grades",
    """SELECT * FROM (WITH subjects AS (SELECT x.id AS module_id, code AS matiere_code, title AS matiere_title FROM module x JOIN (SELECT id AS matiere_id, code, title FROM matiere) USING (matiere_id)),
            years AS (SELECT x.id AS formation_id, annee AS annee_univ FROM formation x JOIN (SELECT id AS annee_univ_id, annee FROM annee_universitaire) USING (annee_univ_id)),
            enrolled AS (SELECT x.id AS inscription_id, etudiant_id, annee_univ FROM inscription x JOIN years USING (formation_id)),
            halves AS (SELECT x.id AS "inscriptionPer_id", etudiant_id, annee_univ, periode FROM inscription_periode x JOIN enrolled USING (inscription_id) JOIN (SELECT id AS periodepgm_id, libelle AS periode FROM periode_programme) USING (periodepgm_id))
       SELECT etudiant_id, s.nom, s.prenom, annee_univ, periode, matiere_code, matiere_title, g.moy AS note, g.note_cc, g.note_exam
       FROM resultat g JOIN halves USING ("inscriptionPer_id") JOIN subjects USING (module_id) JOIN (SELECT id AS etudiant_id, nom, prenom FROM etudiant) s USING (etudiant_id))""",
)
def student_grades(a):
    return R.student_grades(a.relational())


_ANALYTICS = "SELECT type_recherche, count(*) AS total_searches, avg(resultats_trouves) AS avg_results, sum(CASE WHEN correction_utilisateur <> 0 THEN 1 ELSE 0 END)::BIGINT AS corrections, round(100.0 * sum(CASE WHEN correction_utilisateur <> 0 THEN 1 ELSE 0 END) / count(*), 2) AS correction_rate, date_recherche::DATE AS search_date FROM recherche_log GROUP BY type_recherche, date_recherche::DATE"


@register("search_analytics", _ANALYTICS)
def search_analytics(a):
    return R.search_analytics(a.recherche_log())


_MESSAGE = "(CASE WHEN total_pages = 0 THEN 0 ELSE round_even(processed_percentage, 0) END)::INT::VARCHAR || '% pages processed (' || processed_pages::VARCHAR || '/' || total_pages::VARCHAR || ')' AS message"
FILES = "SELECT batch_id, file_name, count(*) FILTER (status = 'ok') AS processed_pages, count(*) FILTER (status <> 'ok') AS failed_pages, count(*) AS total_pages FROM conv_page GROUP BY ALL"
CONV = "SELECT 'batch_' || (conv_id % 20)::VARCHAR AS batch_id, 'doc_' || conv_id::VARCHAR || '.pdf' AS file_name, turn + 1 AS page_number, CASE WHEN role = 'system' THEN CASE WHEN conv_id % 3 = 0 THEN 'pending' ELSE 'failed' END ELSE 'ok' END AS status FROM conversations"
_PCT = "round((processed_pages + failed_pages) * 100.0 / total_pages, 2) AS processed_percentage"


def _conversation_pages(a):
    c = F.col("conv_id")
    return a.table("conversations").select(
        F.concat(F.lit("batch_"), (c % 20).cast("string")).alias("batch_id"),
        F.concat(F.lit("doc_"), c.cast("string"), F.lit(".pdf")).alias("file_name"),
        (F.col("turn") + 1).alias("page_number"),
        F.when(F.col("role") == "system", F.when(c % 3 == 0, "pending").otherwise("failed")).otherwise("ok").alias("status"),
    )


@register("file_progress", f"SELECT *, {_MESSAGE} FROM (SELECT *, {_PCT} FROM fp)", conv_page=CONV, fp=FILES)
def file_progress(a):
    return R.file_progress(_conversation_pages(a), "batch_id", "file_name")


@register(
    "batch_progress",
    f"SELECT *, {_MESSAGE} FROM (SELECT *, {_PCT} FROM (SELECT batch_id, file_name, sum(processed_pages)::BIGINT AS processed_pages, sum(failed_pages)::BIGINT AS failed_pages, sum(total_pages)::BIGINT AS total_pages, count(*) FILTER (failed_pages = 0) AS processed_files, count(*) FILTER (failed_pages > 0) AS failed_files FROM fp GROUP BY ROLLUP (batch_id, file_name)) WHERE batch_id IS NOT NULL)",
    conv_page=CONV,
    fp=FILES,
)
def batch_progress(a):
    return R.batch_progress(_conversation_pages(a))


@register("queue_progress", "SELECT k, round(ok_pages * 100.0 / total_pages)::INT AS percent FROM record")
def queue_progress(a):
    return R.queue_progress(a.record()).select("k", "percent")


@register("completion_percent", "SELECT k, least(100, greatest(0, round((ok_pages + failed_pages) * 100.0 / total_pages)))::INT AS percent FROM record")
def completion_percent(a):
    return R.completion_percent(a.record()).select("k", "percent")


def _perf_sql(by: str, student: str, source: str) -> str:
    return f"SELECT {by}, count(DISTINCT {student}) AS students, round(avg(moy), 4) AS average, round(avg(CASE WHEN moy >= 10 THEN 100.0 WHEN moy IS NOT NULL THEN 0.0 END), 4) AS success, round(100.0 - avg(CASE WHEN moy >= 10 THEN 100.0 WHEN moy IS NOT NULL THEN 0.0 END), 4) AS failure, round(stddev_samp(moy), 4) AS dispersion FROM {source} GROUP BY {by}"


@register("module_performance", _perf_sql("module_id", "inscriptionPer_id", "resultat"))
def module_performance(a):
    return R.performance(a.resultat(), "module_id", "inscriptionPer_id", "moy")


@register(
    "promo_performance",
    "SELECT promo, count(*) AS n, round(avg(CASE WHEN moy >= 10 THEN 100.0 WHEN moy IS NOT NULL THEN 0.0 END), 4) AS success, round(100.0 - avg(CASE WHEN moy >= 10 THEN 100.0 WHEN moy IS NOT NULL THEN 0.0 END), 4) AS failure, round(avg(moy), 4) AS average FROM (SELECT year(date_inscription)::VARCHAR AS promo, moy FROM inscription) GROUP BY ROLLUP (promo)",
)
def promo_performance(a):
    return R.promo_performance(a.inscription().select(F.year("date_inscription").cast("string").alias("promo"), "moy"))


@register("gender_split", "SELECT coalesce(sexe, 'Autre') AS sexe, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM etudiant), 4) AS share FROM etudiant GROUP BY 1")
def gender_split(a):
    return R.gender_split(a.etudiant())


@register("graduate_status", "SELECT id, CASE WHEN moy >= 10 THEN 'Graduate' ELSE 'Non-Graduate' END AS status FROM inscription")
def graduate_status(a):
    return a.inscription().select("id", R.graduate_status(F.col("moy")).alias("status"))


@register("grade_band", "SELECT CASE WHEN moy >= 14 THEN 'high' WHEN moy >= 10 THEN 'middle' ELSE 'low' END AS band, count(*) AS n FROM resultat GROUP BY 1")
def grade_band(a):
    return a.resultat().groupBy(R.grade_band(F.col("moy")).alias("band")).agg(F.count("*").alias("n"))


@register("error_summary", "SELECT contains(error, '429') AS transient, CASE WHEN contains(error, '429') THEN '429' ELSE 'other' END AS class, count(*) AS n FROM page WHERE status = 'failed' GROUP BY ALL")
def error_summary(a):
    return R.error_summary(a.page_text())


# --- rankings -----------------------------------------------------------------------------------
@register("top_students", "SELECT id, moy, position, dense FROM (SELECT id, moy, row_number() OVER (ORDER BY moy DESC, id) AS position, dense_rank() OVER (ORDER BY moy DESC) AS dense FROM inscription WHERE moy IS NOT NULL) WHERE position <= 10")
def top_students(a):
    return R.top_students(a.inscription().select("id", "moy"), "moy", "id")


_RANKED = "SELECT id, formation_id, groupe_id, moy, rang, rank() OVER (PARTITION BY formation_id, groupe_id ORDER BY moy DESC) AS rank FROM inscription WHERE moy IS NOT NULL"


@register("compute_ranks", "SELECT id, rank FROM ranked", ranked=_RANKED)
def compute_ranks(a):
    return R.compute_ranks(a.inscription().select("id", "formation_id", "groupe_id", "moy"), ["formation_id", "groupe_id"], "moy").select("id", "rank")


@register("rank_mismatch_audit", "SELECT id, rang, rank AS computed_rank FROM ranked WHERE rang <> rank", ranked=_RANKED)
def rank_mismatch_audit(a):
    rows = a.inscription().select("id", "formation_id", "groupe_id", "moy", "rang")
    return R.rank_mismatch_audit(rows, ["formation_id", "groupe_id"], "moy", "rang").select("id", "rang", "computed_rank")


# --- set operations and join kinds ---------------------------------------------------------------
@register("set_union_distinct", "SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events")
def set_union_distinct(a):
    return a.table("orders").select(F.col("o_custkey").alias("id")).union(a.table("events").select("user_id")).distinct()


@register("set_intersect", "SELECT o_custkey AS id FROM orders INTERSECT SELECT user_id FROM events")
def set_intersect(a):
    return a.table("orders").select(F.col("o_custkey").alias("id")).intersect(a.table("events").select("user_id"))


@register("set_difference", "SELECT o_custkey AS id FROM orders EXCEPT SELECT user_id FROM events")
def set_difference(a):
    return a.table("orders").select(F.col("o_custkey").alias("id")).subtract(a.table("events").select("user_id"))


@register("join_semi_history", "SELECT id FROM recherche_log WHERE etudiant_id IN (SELECT id FROM etudiant)")
def join_semi_history(a):
    return a.recherche_log().join(a.etudiant().select(F.col("id").alias("etudiant_id")), "etudiant_id", "left_semi").select("id")


@register("join_anti_numbers", "SELECT case_id FROM pending_case WHERE generated_matricule NOT IN (SELECT matricule FROM etudiant)")
def join_anti_numbers(a):
    return a.pending_case().join(a.etudiant().select(F.col("matricule").alias("generated_matricule")), "generated_matricule", "left_anti").select("case_id")


@register("join_one_to_many", "SELECT e.id, coalesce(max(v.frequence), 0) AS best, count(v.variation) AS n FROM etudiant e LEFT JOIN variation_nom v ON v.etudiant_id = e.id GROUP BY 1")
def join_one_to_many(a):
    v = a.variation_nom().groupBy(F.col("etudiant_id").alias("id")).agg(F.max("frequence").alias("best"), F.count("*").alias("n"))
    return a.etudiant().select("id").join(v, "id", "left").select("id", F.coalesce("best", F.lit(0)).alias("best"), F.coalesce("n", F.lit(0)).alias("n"))
