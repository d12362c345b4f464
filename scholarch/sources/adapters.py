"""Views of the star-schema tables as academic records.

All of them are row-local projections (no shuffle) unless the comment says otherwise, so
every consumer still gets column pruning and filter pushdown down to the Parquet scan.
`FIXTURES.md` documents the mapping; page documents are derived per order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarch.functions.text import full_search_term, normalize_text
from scholarch.operators.pages import read_page_results
from scholarch.session import spread


class Archive:
    """Academic views over one folder of star-schema Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- people ------------------------------------------------------------------
    def etudiant(self) -> DataFrame:
        """A person per document: two words from anywhere in its text, placed by the document's number."""
        words = F.split(F.btrim("text", F.lit(" \t\n\f\r")), "[ \\t\\n\\f\\r]+")
        number = F.col("doc_id").cast("string")
        # the generator keeps the split of the whole text from being repeated in the pushed filter
        return (
            self.table("documents")
            .select("doc_id", "source", F.explode_outer(F.array(words)).alias("w"))
            .filter(F.size("w") >= 2)
            .select(
                "doc_id",
                "source",
                F.get("w", (F.col("doc_id") * 31 % F.size("w")).cast("int")).alias("nom"),
                F.get("w", ((F.col("doc_id") * 17 + 5) % F.size("w")).cast("int")).alias("prenom"),
            )
            .select(
                F.col("doc_id").alias("id"),
                "nom",
                "prenom",
                F.concat((74 + F.col("doc_id") % 11).cast("string"), F.lit("/"), F.lpad(number, 9, "0")).alias("matricule"),
                F.when(F.col("doc_id") % 3 == 0, "M").when(F.col("doc_id") % 3 == 1, "F").alias("sexe"),
                F.date_add(F.lit("1955-01-01").cast("date"), (F.col("doc_id") % 3650).cast("int")).alias("date_naissance"),
                F.col("source").alias("lieu_naissance"),
            )
        )

    def requete(self) -> DataFrame:
        """One search per student: misspelt (last letter lost) unless id%20=0, with the number for id%30=0."""
        cut = F.substring("nom", 1, F.length("nom") - 1)
        return self.etudiant().select(
            F.col("id").alias("query_id"),
            F.when((F.col("id") % 20 == 0) | (F.length("nom") < 2), F.col("nom")).otherwise(cut).alias("nom"),
            "prenom",
            F.when(F.col("id") % 30 == 0, F.col("matricule")).alias("matricule"),
        )

    def variation_nom(self) -> DataFrame:
        """A learned spelling for every student that has a label row (join on id)."""
        whole = normalize_text(F.concat_ws(" ", "nom", "prenom"))
        return (
            self.etudiant()
            .join(self.table("labels"), F.col("id") == F.col("doc_id"))
            .select(
                F.col("id").alias("etudiant_id"),
                F.when(F.col("quality") == 1, whole).otherwise(normalize_text(F.col("nom"))).alias("variation"),
                (1 + F.col("id") % 7).cast("int").alias("frequence"),
            )
        )

    def recherche_log(self) -> DataFrame:
        """Search log: one row per event; the term is the name of the student the event points to."""
        e = self.table("events").select(
            F.col("event_id").alias("id"),
            "user_id",
            F.col("event_type").alias("type_recherche"),
            F.floor("value").cast("int").alias("resultats_trouves"),
            (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 2).alias("correction_utilisateur"),
            F.col("ts").alias("date_recherche"),
        )
        return e.select(
            "id",
            # now and then a student that the table does not have
            F.when(F.col("user_id") % 7 != 0, F.when(F.col("id") % 97 == 5, F.col("user_id") + 1_000_000_000).otherwise(F.col("user_id"))).alias("etudiant_id"),
            F.col("user_id").alias("cible_id"),
            "type_recherche",
            "resultats_trouves",
            "correction_utilisateur",
            "date_recherche",
        )

    def recherche_log_named(self) -> DataFrame:
        names = self.etudiant().select(F.col("id").alias("cible_id"), full_search_term(F.col("nom"), F.col("prenom")).alias("terme_recherche"))
        return (
            self.recherche_log()
            .join(names, "cible_id")
            .withColumn("terme_normalise", normalize_text(F.col("terme_recherche")))
            .drop("cible_id")
        )

    def confirmation(self) -> DataFrame:
        """Confirmed choices: every corrected log row, the searched name cut by one letter on odd ids."""
        log = self.recherche_log().filter("correction_utilisateur = 1 and etudiant_id is not null")
        names = self.etudiant().select(F.col("id").alias("cible_id"), "nom", "prenom", "matricule")
        odd = F.col("conf_id") % 2 == 1
        return log.select(
            F.col("id").alias("conf_id"),
            F.col("etudiant_id").alias("selected_student_id"),
            "cible_id",
            "resultats_trouves",
            "date_recherche",
        ).join(names, "cible_id", "left").select(
            "conf_id",
            "selected_student_id",
            F.when(odd & (F.length("nom") > 1), F.substring("nom", 1, F.length("nom") - 1)).otherwise(F.coalesce("nom", F.lit("inconnu"))).alias("searched_nom"),
            F.coalesce("prenom", F.lit("")).alias("searched_prenom"),
            F.when(F.col("conf_id") % 5 == 0, F.col("matricule")).alias("searched_matricule"),
            F.col("resultats_trouves").alias("result_count"),
            F.col("date_recherche").alias("confirmed_at"),
        )

    # --- programme structure --------------------------------------------------------
    def annee_universitaire(self) -> DataFrame:
        """Distinct order years (an aggregate to a handful of rows)."""
        y = F.year("o_orderdate")
        years = self.table("orders").select(y.cast("long").alias("id")).distinct()
        text, after = F.col("id").cast("string"), (F.col("id") + 1).cast("string")
        return years.select(
            "id",
            F.concat_ws("-", text, after).alias("annee"),
            F.make_date(F.col("id").cast("int"), F.lit(9), F.lit(1)).alias("date_debut"),
            F.make_date((F.col("id") + 1).cast("int"), F.lit(6), F.lit(30)).alias("date_fin"),
        )

    def programme(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("long").alias("id"),
            F.col("n_name").alias("code"),
            F.col("n_name").alias("titre"),
            (F.col("n_regionkey") % 2).cast("int").alias("doctorat"),
        )

    def _enrolment(self) -> DataFrame:
        """orders joined to customers: the row source of inscriptions, formations and groups."""
        year = F.year("o_orderdate").cast("long")
        return (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.col("o_orderkey").alias("id"),
                F.col("o_custkey").alias("etudiant_id"),
                (F.col("c_nationkey").cast("long") * 10000 + year).alias("formation_id"),
                F.col("c_nationkey").cast("long").alias("programme_id"),
                year.alias("annee_univ_id"),
                F.col("c_mktsegment").alias("groupe_code"),
                "o_orderstatus",
                "o_totalprice",
                F.col("o_orderdate").alias("date_inscription"),
            )
        )

    def formation(self) -> DataFrame:
        return self._enrolment().select(F.col("formation_id").alias("id"), "programme_id", "annee_univ_id").distinct()

    def groupe(self) -> DataFrame:
        return (
            self._enrolment()
            .select("formation_id", F.col("groupe_code").alias("code"))
            .distinct()
            .select((F.col("formation_id") * 100 + F.ascii("code")).alias("id"), "code", "formation_id")
        )

    def inscription(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self._enrolment().select(
            "id",
            "etudiant_id",
            "formation_id",
            (F.col("formation_id") * 100 + F.ascii("groupe_code")).alias("groupe_id"),
            F.when(F.col("id") % 9 != 0, F.floor(F.col("o_totalprice") % 2100) / 100).alias("moy"),
            (F.col("id") % 40 + 1).cast("int").alias("rang"),
            F.when(status == "O", "Admis").when(status == "F", "Eliminé").otherwise("Passage conditionnel").alias("decisionJury"),
            "date_inscription",
        )

    def matiere(self) -> DataFrame:
        key = F.col("p_partkey").cast("string")
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.concat(F.upper(F.substring("p_name", 1, 3)), key).alias("code"),
            F.col("p_name").alias("title"),
            F.col("p_size").cast("double").alias("coefficient"),
        )

    def periode_programme(self) -> DataFrame:
        return self.programme().select(F.col("id").alias("programme_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("s")).select(
            (F.col("programme_id") * 2 + F.col("s")).alias("id"),
            F.concat(F.lit("S"), (F.col("s") + 1).cast("string")).alias("libelle"),
            (F.col("s") + 1).cast("int").alias("ordre"),
            "programme_id",
        )

    def module(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_partkey").alias("matiere_id"),
            (F.col("p_partkey") % 50).alias("periode_id"),
            (F.col("p_size") / 2).alias("coefficient"),
        )

    def inscription_periode(self) -> DataFrame:
        semesters = F.explode(F.array(F.lit(0), F.lit(1)))
        return (
            self._enrolment()
            .select("*", semesters.alias("s"))
            .select(
                (F.col("id") * 2 + F.col("s")).alias("id"),
                F.col("id").alias("inscription_id"),
                (F.col("programme_id") * 2 + F.col("s")).alias("periodepgm_id"),
                (F.col("formation_id") * 100 + F.ascii("groupe_code")).alias("groupe_id"),
            )
        )

    def resultat(self) -> DataFrame:
        grade = F.round(F.col("l_quantity") * 0.4, 2)
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 2 + F.col("l_linenumber") % 2).alias("inscriptionPer_id"),
            F.col("l_partkey").alias("module_id"),
            grade.alias("moy"),
            F.when(F.col("l_returnflag") != "A", F.round(F.col("l_discount") * 250, 2)).alias("note_cc"),
            F.round(F.col("l_tax") * 200, 2).alias("note_exam"),
        )

    # --- grade sheets to load ---------------------------------------------------------
    def grade_sheet(self) -> DataFrame:
        """One sheet per order: the customer as student (by number, some by name), nation, year and segment as written."""
        k = F.col("o_orderkey")
        names = self.etudiant().select(F.col("id").alias("o_custkey"), "nom", "prenom")
        year = F.year("o_orderdate")
        nations = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        return (
            self.table("orders")
            .join(self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"), "o_custkey")
            .join(nations, "c_nationkey")
            .join(names, "o_custkey", "left")
            .select(
                k.alias("sheet_id"),
                F.when(k % 10 != 4, F.concat((74 + F.col("o_custkey") % 11).cast("string"), F.lit("/"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).alias("matricule"),
                "nom",
                "prenom",
                F.when(k % 41 == 0, F.lit("AUTRE")).when(k % 2 == 0, F.concat(F.lit(" "), F.lower("n_name"))).otherwise(F.col("n_name")).alias("programme"),
                F.concat((year + F.when(k % 43 == 0, 20).otherwise(0)).cast("string"), F.when(k % 3 == 0, " / ").otherwise("-"), (year + 1 + F.when(k % 43 == 0, 20).otherwise(0)).cast("string")).alias("annee"),
                F.when(k % 37 == 0, F.lit(None)).otherwise(F.lower("c_mktsegment")).alias("groupe"),
                F.when(k % 9 != 0, F.floor(F.col("o_totalprice") % 2100) / 100).alias("moy"),
                (k % 40 + 1).cast("int").alias("rang"),
                F.when(F.col("o_orderstatus") == "O", "Admis").when(F.col("o_orderstatus") == "F", "Eliminé").otherwise("Passage conditionnel").alias("decisionJury"),
                F.col("o_orderdate").alias("dated"),
            )
        )

    def grade_cell(self) -> DataFrame:
        """One note per order line; most name a subject that the programme teaches in that period."""
        places = (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("o_orderkey").alias("l_orderkey"), (F.col("c_nationkey") * 2).cast("long").alias("_first"), F.col("o_orderdate").alias("dated"))
        )
        line = F.col("l_linenumber")
        near = F.col("l_partkey") - F.col("l_partkey") % 50 + F.col("_first") + line % 2
        parts = self.matiere().select(F.col("id").alias("_part"), "code")
        note = F.round(F.col("l_quantity") * 0.42, 2).cast("decimal(6,2)").cast("string")
        return (
            self.table("lineitem")
            .select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
            .join(places, "l_orderkey")
            .withColumn("_part", F.when(F.col("l_partkey") % 19 == 0, F.col("l_partkey")).otherwise(near))
            .join(parts, "_part", "left")
            .select(
                F.col("l_orderkey").alias("sheet_id"),
                line.cast("int").alias("pos"),
                F.when(F.col("l_partkey") % 47 == 0, "S3").otherwise(F.concat(F.lit("s"), (line % 2 + 1).cast("string"))).alias("periode"),
                F.lower("code").alias("code"),
                F.when(F.col("l_partkey") % 53 == 0, "uncertain").otherwise(F.replace(note, F.lit("."), F.lit(","))).alias("note"),
                "dated",
            )
        )

    def relational(self) -> dict[str, DataFrame]:
        return {
            "annee_universitaire": self.annee_universitaire(),
            "programme": self.programme(),
            "etudiant": self.etudiant(),
            "formation": self.formation(),
            "groupe": self.groupe(),
            "matiere": self.matiere(),
            "periode_programme": self.periode_programme(),
            "module": self.module(),
            "inscription": self.inscription(),
            "inscription_periode": self.inscription_periode(),
            "resultat": self.resultat(),
            "recherche_name_log": self.recherche_log(),
            "variation_nom": self.variation_nom(),
        }

    # --- identity queue ------------------------------------------------------------
    def pending_case(self) -> DataFrame:
        """One case per student: own number, an unknown number, or an unknown name."""
        e, kind = self.etudiant(), F.col("id") % 3
        return e.select(
            F.col("id").alias("case_id"),
            F.when(F.col("id") % 10 != 9, "pending").otherwise("resolved").alias("status"),
            F.when(kind == 2, F.concat(F.col("nom"), F.lit("zzq"))).otherwise(F.translate("nom", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("nom"),
            "prenom",
            F.when(kind == 1, F.concat(F.lit("TMP-"), F.col("id").cast("string"))).otherwise(F.col("matricule")).alias("generated_matricule"),
        )

    def save_row(self) -> DataFrame:
        """Verified rows to save: one per order, naming the student whose id is the customer key."""
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        e = self.etudiant().select(F.col("id").alias("o_custkey"), "nom", "prenom", "matricule", "date_naissance")
        k, known = F.col("o_orderkey"), F.col("nom").isNotNull()
        invented = F.translate(F.col("o_custkey").cast("string"), "0123456789", "abekilmors")
        # every eleventh row or so names nobody the table knows
        hidden = o.withColumn("o_person", F.when(k % 11 != 3, F.col("o_custkey")))
        return hidden.join(e.withColumnRenamed("o_custkey", "o_person"), "o_person", "left").select(
            k.alias("index"),
            F.when(k % 37 == 0, "  ").when(known, F.col("nom")).otherwise(F.concat(F.lit("Nouveau"), invented)).alias("nom"),
            F.when(known, F.col("prenom")).otherwise(invented).alias("prenom"),
            F.when((k % 4 == 0) & known, F.concat(F.lit(" "), F.col("matricule"), F.lit(" "))).when(k % 16 == 1, F.concat(F.lit("N"), F.col("o_custkey").cast("string"))).alias("matricule"),
            (k % 5 == 0).alias("is_first_year"),
            F.when(k % 6 == 0, F.when(k % 12 == 0, F.lit("1960-13-45")).otherwise(F.col("date_naissance").cast("string"))).alias("date_naissance"),
            F.when(k % 2 == 0, F.concat(F.lit("Ville "), (k % 50).cast("string"))).alias("lieu_naissance"),
            F.when(k % 3 == 0, "F").alias("sexe"),
            F.concat(F.year("o_orderdate").cast("string"), F.lit("-x")).alias("annee_univ"),
        )

    # --- operations, files -------------------------------------------------------------
    def operation_event(self) -> DataFrame:
        """Progress events of operations: one per log event, keyed by user."""
        kind = F.col("event_type")
        return self.table("events").select(
            "event_id",
            F.col("user_id").alias("operation_id"),
            F.when(kind == "purchase", "completed").when(kind == "error", F.when(F.col("event_id") % 3 == 0, "cancelled").otherwise("failed")).otherwise("processing").alias("status"),
            F.when(kind == "signup", "timeout_waiting").otherwise("extracting").alias("stage"),
            (F.floor("value") % 40 + 1).cast("long").alias("total_pages"),
            F.least(F.floor("value") % 40 + 1, F.col("event_id") % 23).cast("long").alias("processed_pages"),
            (F.col("event_id") % 2).cast("long").alias("failed_pages"),
            F.col("ts").alias("updated_at"),
        )

    def upload(self) -> DataFrame:
        """Uploaded files: one per web page; suffix, size and MIME type vary."""
        n = F.col("page_id")
        return self.table("pages").select(
            n.alias("upload_id"),
            F.when(n % 17 == 0, "").otherwise(F.concat(F.lit("dir/Doc_"), (n % 90).cast("string"), F.when(n % 5 == 0, ".PDF").when(n % 5 == 1, ".txt").otherwise(".pdf"))).alias("file_name"),
            F.when(n % 5 == 1, F.when(n % 2 == 0, "application/pdf").otherwise("text/plain")).otherwise("application/pdf").alias("mime_type"),
            F.when(n % 13 == 0, F.lit(0)).otherwise(F.length("html").cast("long") * F.when(n % 11 == 0, 100000).otherwise(1)).cast("long").alias("bytes"),
            F.concat(F.lit("batch_"), (n % 20).cast("string")).alias("batch_id"),
            F.timestamp_seconds(1700000000 + n * 61).alias("mtime"),
        )

    def raw_answer(self) -> DataFrame:
        """Whole document texts with an object embedded: valid, cut off, or twice."""
        n = F.col("doc_id")
        good = F.concat(F.lit('{"doc": '), n.cast("string"), F.lit(', "t": "a } b", "v": {"x": '), (n % 10).cast("string"), F.lit("}}"))
        tail = F.when(n % 4 == 0, good).when(n % 4 == 1, F.concat(good, F.lit(" et "), good)).when(n % 4 == 2, F.lit('{"doc": ')).otherwise("")
        return self.table("documents").select("doc_id", F.concat("text", F.lit("\n"), tail, F.lit("\nfin")).alias("answer"))

    # --- page documents ------------------------------------------------------------------
    def page_text(self) -> DataFrame:
        """One page document (JSON text) per order, built from the order's own numbers.

        Bounded size, no grouping.  The keys (a few bytes each) are dealt out evenly first, because
        building and parsing documents multiplies their bytes.
        """
        base = self.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("yr"))
        return spread(base, "k").selectExpr(
            "k",
            "concat('batch_', c % 20) AS batch_id",
            "concat('doc_', c, '.pdf') AS file_name",
            "k AS page_number",
            "if(k % 12 = 0, 'failed', 'ok') AS status",
            "CASE WHEN k % 24 = 0 THEN '429 Quota exceeded' WHEN k % 12 = 0 THEN 'invalid answer' END AS error",
            r"concat('C:\\data\\Tmp\\p', k, '.png') AS image_path",
            f"if(k % 12 <> 0, to_json({_PAGE_RESULT}), null) AS result_json",
        )

    def page(self) -> DataFrame:
        return read_page_results(self.page_text(), "result_json").drop("result_json")

    def record(self) -> DataFrame:
        """Completed records: one per order with one to three nested pages."""
        pages = F.transform(
            F.sequence(F.lit(0), (F.col("k") % 3).cast("int")),
            lambda i: F.struct(
                (3 - i).cast("long").alias("page_number"),
                F.when((F.col("k") + i) % 5 == 0, "failed").otherwise("ok").alias("status"),
                F.concat(F.lit("/srv/tmp/p"), i.cast("string")).alias("image_path"),
                (i + 1).cast("int").alias("attempt"),
                F.lit("***").alias("api_key_suffix"),
                F.when((F.col("k") + i) % 5 == 0, "503 busy").alias("error"),
                F.when((F.col("k") + i) % 5 != 0, F.concat(F.lit("type_"), (F.col("k") % 8).cast("string"))).alias("kind"),
            ),
        )
        failed = F.size(F.filter("pages", lambda p: p["status"] == "failed"))
        return (
            self.table("orders")
            .select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
            .select("k", "c", pages.alias("pages"))
            .select(
                "k",
                F.concat(F.lit("batch_"), (F.col("c") % 20).cast("string")).alias("batch_id"),
                F.concat(F.lit("/up/Doc_"), F.col("k").cast("string"), F.lit(".pdf")).alias("file_path"),
                F.timestamp_seconds(1600000000 + F.col("k") % 997).alias("processed_at"),
                F.when(F.col("k") % 10 == 0, "failed").when(F.col("k") % 10 == 1, "processing").when(F.col("k") % 10 == 2, "cancelled").otherwise("ok").alias("status"),
                F.size("pages").cast("long").alias("total_pages"),
                (F.size("pages") - failed).cast("long").alias("ok_pages"),
                failed.cast("long").alias("failed_pages"),
                "pages",
            )
        )


# fixed values of the page documents ------------------------------------------------------
CODES = ("MAT", "FOR", "PLI", "GES", "S/G", "ANG", "str ", None)
TABLE_CODES = ("MAT", "FOR", "PL1", "GES", "ANG", "STR", "DEC", "STH", "IST", "STA", "CBB", "ASS")
SINGLE_NAMES = ("Mathematiques", "Physique", "Chimie", "Anglais", "Statistique")
DECISIONS = ("Admis", "Eliminé", "Non admis", "Passage conditionnel", "Ajourné", "illisible", None, "")
TYPES = ("cover", "resultats_annonce", "table_de_matieres", "unknown", "single_student") + ("multiple_students",) * 3
SECTION_CODES = ("2_I. TRC", "2 I TRC", None, "77-1I-TRC", "", "section")


def _reading(n: int) -> str | None:
    """Noisy readings by rule: comma or dot decimals, whole numbers, markers, blanks, out of range."""
    value = f"{(n * 37) % 2300 / 100:.2f}"
    if n % 11 == 7:
        return {0: None, 1: "", 2: "uncertain", 3: value + "abc"}[n // 11 % 4]
    if n % 13 == 5:
        return value.split(".")[0]
    return value.replace(".", ",") if n % 3 == 0 else value


# fixed values: 97 readings and 24 ranks, generated by rule
READINGS = tuple(_reading(n * 61) for n in range(97))
RANKS = tuple({0: None, 1: "", 2: f"{n}eme", 3: f"{n},7"}.get(n % 8, str(n)) for n in range(24))


def _pick(x: str, values: tuple[str | None, ...]) -> str:
    items = ", ".join("null" if v is None else f"'{v}'" for v in values)
    return f"get(array({items}), int(({x}) % {len(values)}))"


def _raw(x: str) -> str:
    return _pick(x, READINGS)


def _rank(x: str) -> str:
    return _pick(x, RANKS)


def _letters(x: str) -> str:
    return f"translate(string({x}), '0123456789', 'abekilmors')"


def _named(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields.items()) + ")"


def _module(x: str, name: str, notes: dict[str, str]) -> str:
    return _named(
        code=_pick(x, CODES),
        name=name,
        coef=f"if({x} % 4 = 0, string({x} % 7), null)",
        **notes,
    )


_STUDENT_MODULE = _module("(s * 4 + j)", "if((s * 4 + j) % 16 = 7, concat('Module ', j + 1), null)", {"noteS1": _raw("(s * 4 + j) * 3 + 1"), "noteS2": _raw("(s * 4 + j) * 3 + 2")})
_PLAIN = _pick("j", SINGLE_NAMES)
_SINGLE_MODULE = _module(
    "(k * 4 + j)",
    f"CASE WHEN (k + j) % 7 = 0 THEN '' WHEN (k div 8 + j) % 5 = 0 THEN replace({_PLAIN}, 'i', '1') ELSE {_PLAIN} END",
    {
        "note_s1": _raw("(k * 4 + j) * 3 + 1"),
        "note_s2": _raw("(k * 4 + j) * 3 + 2"),
        "coef_s1": _raw("(k * 4 + j) * 5 + 1"),
        "coef_s2": _raw("(k * 4 + j) * 5 + 2"),
    },
)
_STUDENT = _named(
    nom=f"if(s % 41 = 0, '', upper({_letters('c * 31 + s - k * 3')}))",
    prenom=f"concat('Prénom ', {_letters('s % 1000')})",
    matricule="CASE WHEN s % 5 = 0 THEN null WHEN s % 7 = 0 THEN '' ELSE concat(74 + s % 11, '/', s) END",
    decision=_pick("s + 1", DECISIONS),
    modules=f"transform(sequence(0, int(if(k % 50 = 9, 12, k % 4))), j -> {_STUDENT_MODULE})",
    moyenne=_named(S1=_raw("s * 11 + 1"), S2=_raw("s * 11 + 2"), annuel=_raw("s * 11 + 3")),
    rang=_named(S1=_rank("s"), S2=_rank("s + 1"), annuel=_rank("s + 4")),
    decisionDeJuin=_pick("s", DECISIONS),
    nbrAbs=_raw("s * 13 + 5"),
    noteDeStage=_raw("s * 17 + 6"),
    decisionFinaleDuConseil=_pick("s + 5", DECISIONS),
)
_AVERAGES = ("S1", "S1_80pct", "S2", "S2_80pct", "annuel", "annuel_80pct")
_MATIERE = _named(
    abrev=f"if((k + j) % 9 = 0, '', {_pick('j', TABLE_CODES)})",
    libelle="if((k + j) % 18 = 0, '', concat('Matière ', j))",
    coef=_named(S1=_raw("k + j"), S2=_raw("k + j + 1")),
    moyenne=_named(**{name: _raw(f"k * 7 + j + {n}") for n, name in enumerate(_AVERAGES)}),
)
_SINGLE = _named(
    name=f"concat(upper({_letters('c * 31')}), '  Prénom ', {_letters('k % 1000')})",
    section=_pick("k div 8", (None, "", "S1", "S2")),
    year="concat(yr, '/', yr + k % 3)",
    matricule="if(k % 5 <> 0, concat('74/', k), null)",
    decisionDeJuin=_pick("k", DECISIONS),
    decisionFinaleDuConseil=_pick("k div 8", DECISIONS),
    semestre1_moyenne=_raw("k * 11 + 4"),
    general_moyenne=_raw("k * 11 + 5"),
    general_rang=_rank("k + 2"),
)
_SUMMARY = _named(
    semestre1_moyenne=_raw("k * 11 + 1"),
    semestre1_rang=_rank("k"),
    semestre2_moyenne=_raw("k * 11 + 2"),
    semestre2_rang=_rank("k + 1"),
    general_moyenne=_raw("k * 11 + 3"),
    general_rang=_rank("k + 4"),
    observation=_pick("k div 16", DECISIONS),
)
_PAGE_RESULT = _named(
    type=_pick("k", TYPES),
    sectionCode=_pick("k", SECTION_CODES),
    annee="concat(yr, '/', yr + k % 2)",
    anneeEtude=_pick("k", ("1ere", None, "2eme")),
    section=_pick("k", (None, "", "A", "B")),
    option=_pick("k", (None, "Opt")),
    error="if(k % 14 = 3, concat('err ', k), null)",
    markdown="if(k % 10 = 5, concat('md ', k), null)",
    student=f"if(k % 8 = 4, {_SINGLE}, null)",
    modules=f"if(k % 8 = 4, transform(sequence(0, int(k % 5)), j -> {_SINGLE_MODULE}), null)",
    summary=f"if(k % 8 = 4, {_SUMMARY}, null)",
    students=f"if(k % 8 = 1 OR k % 8 >= 5, transform(sequence(k * 3, k * 3 + k % 3), s -> {_STUDENT}), null)",
    matieres=f"if(k % 8 = 2, transform(sequence(0, int(2 + k div 8 % 10)), j -> {_MATIERE}), null)",
)
