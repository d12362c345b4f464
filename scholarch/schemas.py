"""Declared schemas: the relational tables, the page-result superset and the queue lines.

Raw numbers stay strings, so that `12` and `12.0` remain distinguishable until a typing
rule has looked at them.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TYPES = {
    "long": LongType(),
    "int": IntegerType(),
    "string": StringType(),
    "double": DoubleType(),
    "date": DateType(),
    "timestamp": TimestampType(),
}


def _struct(spec: str) -> StructType:
    """'name type, ...' ; a trailing '!' marks a column that must not be null."""
    fields = []
    for item in spec.split(","):
        name, kind = item.split()
        fields.append(StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return StructType(fields)


_STAMPS = ", created_at timestamp, updated_at timestamp"

TABLES: dict[str, StructType] = {
    "annee_universitaire": _struct("id long!, annee string!, date_debut date!, date_fin date!" + _STAMPS),
    "programme": _struct("id long!, code string!, titre string!, doctorat int" + _STAMPS),
    "etudiant": _struct(
        "id long!, nom string!, prenom string!, matricule string!, sexe string, date_naissance date,"
        "lieu_naissance string, nom_soundex string, prenom_soundex string, nom_metaphone string,"
        "prenom_metaphone string, nom_trigram string, prenom_trigram string, matricule_normalise string,"
        "matricule_prefixes string" + _STAMPS
    ),
    "formation": _struct("id long!, programme_id long!, annee_univ_id long!" + _STAMPS),
    "groupe": _struct("id long!, code string!, formation_id long!" + _STAMPS),
    "matiere": _struct("id long!, code string!, title string!, coefficient double!" + _STAMPS),
    "periode_programme": _struct("id long!, libelle string!, ordre int!, programme_id long!" + _STAMPS),
    "module": _struct("id long!, matiere_id long!, periode_id long!, coefficient double" + _STAMPS),
    "inscription": _struct(
        "id long!, etudiant_id long!, formation_id long!, groupe_id long!, moy double, rachat int,"
        "rattrapage int, rang int, decisionJury string, observation string, date_inscription timestamp" + _STAMPS
    ),
    "inscription_periode": _struct(
        "id long!, inscription_id long!, periodepgm_id long!, groupe_id long!, moy double" + _STAMPS
    ),
    "resultat": _struct(
        "id long!, inscriptionPer_id long!, module_id long!, moy double, note_cc double, note_exam double" + _STAMPS
    ),
    "recherche_name_log": _struct(
        "id long!, etudiant_id long, terme_recherche string!, terme_normalise string, type_recherche string,"
        "resultats_trouves int, correction_utilisateur int, date_recherche timestamp"
    ),
    "variation_nom": _struct(
        "id long!, etudiant_id long!, nom_canonique string!, variation string!, frequence int,"
        "derniere_utilisation timestamp, created_at timestamp"
    ),
}

# business keys (one row per key), declared checks and foreign keys of the same tables
UNIQUE_KEYS: list[tuple[str, tuple[str, ...]]] = [
    ("annee_universitaire", ("annee",)),
    ("programme", ("code",)),
    ("etudiant", ("matricule",)),
    ("formation", ("programme_id", "annee_univ_id")),
    ("groupe", ("code", "formation_id")),
    ("matiere", ("code",)),
    ("periode_programme", ("libelle", "programme_id")),
    ("module", ("matiere_id", "periode_id")),
    ("inscription", ("etudiant_id", "formation_id")),
    ("inscription_periode", ("inscription_id", "periodepgm_id")),
    ("resultat", ("inscriptionPer_id", "module_id")),
    ("variation_nom", ("etudiant_id", "variation")),
]

FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    # child, column, parent, on delete
    ("formation", "programme_id", "programme", "RESTRICT"),
    ("formation", "annee_univ_id", "annee_universitaire", "RESTRICT"),
    ("groupe", "formation_id", "formation", "CASCADE"),
    ("periode_programme", "programme_id", "programme", "CASCADE"),
    ("module", "matiere_id", "matiere", "RESTRICT"),
    ("module", "periode_id", "periode_programme", "CASCADE"),
    ("inscription", "etudiant_id", "etudiant", "CASCADE"),
    ("inscription", "formation_id", "formation", "RESTRICT"),
    ("inscription", "groupe_id", "groupe", "RESTRICT"),
    ("inscription_periode", "inscription_id", "inscription", "CASCADE"),
    ("inscription_periode", "periodepgm_id", "periode_programme", "RESTRICT"),
    ("inscription_periode", "groupe_id", "groupe", "RESTRICT"),
    ("resultat", "inscriptionPer_id", "inscription_periode", "CASCADE"),
    ("resultat", "module_id", "module", "RESTRICT"),
    ("recherche_name_log", "etudiant_id", "etudiant", "SET NULL"),
    ("variation_nom", "etudiant_id", "etudiant", "CASCADE"),
]

CHECKS: dict[str, dict[str, str]] = {
    # rule name -> SQL predicate that is true for a violation (null passes unless stated)
    "etudiant": {"sexe": "sexe not in ('M','F','Autre')"},
    "resultat": {
        "moy": "moy not between 0 and 20",
        "note_cc": "note_cc not between 0 and 20",
        "note_exam": "note_exam not between 0 and 20",
    },
    "inscription": {"moy": "moy not between 0 and 20"},
    "matiere": {"coefficient": "coefficient is null or coefficient <= 0"},
    "annee_universitaire": {"dates": "date_fin <= date_debut"},
    "variation_nom": {"frequence": "frequence is null or frequence < 1"},
}


def _strings(names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names.split()])


MODULE = _strings("code name module libelle coef coefficient credit credits coef_s1 note_s1 coef_s2 note_s2 noteS1 noteS2")
SIX_AVERAGES = _strings("S1 S1_80pct S2 S2_80pct annuel annuel_80pct")
STUDENT = StructType(
    [
        *_strings("nom prenom matricule decision").fields,
        StructField(
            "metadata",
            StructType(
                [
                    *_strings("semestre sousGroupe").fields,
                    StructField("autresChamps", MapType(StringType(), StringType())),
                ]
            ),
        ),
        StructField("modules", ArrayType(MODULE)),
        StructField("moyenne", _strings("S1 S2 annuel")),
        StructField("rang", _strings("S1 S2 annuel")),
        *_strings("decisionDeJuin nbrAbs noteDeStage decisionFinaleDuConseil diploma").fields,
    ]
)
PAGE_RESULT = StructType(
    [
        *_strings("type sectionCode annee anneeEtude section option institution error markdown").fields,
        StructField(
            "student",
            _strings(
                "name group section year matricule moyenneAnterieur decisionDeJuin decisionFinaleDuConseil "
                "semestre1_moyenne semestre2_moyenne general_moyenne semestre1_rang semestre2_rang general_rang "
                "noteDeStage diploma"
            ),
        ),
        StructField("modules", ArrayType(MODULE)),
        StructField("notesConcours", _strings("mathematique cultureGenerale testPsychologique")),
        StructField(
            "summary",
            _strings(
                "semestre1_moyenne semestre1_rang semestre2_moyenne semestre2_rang general_moyenne general_rang observation"
            ),
        ),
        StructField("students", ArrayType(STUDENT)),
        StructField(
            "matieres",
            ArrayType(
                StructType(
                    [
                        *_strings("abrev libelle").fields,
                        StructField("coef", _strings("S1 S2")),
                        StructField("moyenne", SIX_AVERAGES),
                    ]
                )
            ),
        ),
        StructField("moyennePromotion", SIX_AVERAGES),
    ]
)
PAGE = StructType(
    [
        StructField("page_number", LongType()),
        *_strings("image_path status").fields,
        StructField("attempt", IntegerType()),
        *_strings("api_key_suffix error").fields,
        StructField("result", PAGE_RESULT),
    ]
)
RUN = StructType(
    [
        *_strings("file_path run_dir pages_dir").fields,
        StructField("total_pages", LongType()),
        StructField("ok_pages", LongType()),
        StructField("failed_pages", LongType()),
        StructField("pages", ArrayType(PAGE)),
    ]
)
COMPLETED_RECORD = StructType(
    [
        *_strings("id batch_id file_name processed_at status error").fields,
        StructField("total_pages", LongType()),
        StructField("ok_pages", LongType()),
        StructField("failed_pages", LongType()),
        StructField(
            "pages",
            ArrayType(
                StructType(
                    [
                        StructField("page_number", LongType()),
                        *_strings("status image_path").fields,
                        StructField("result", PAGE_RESULT),
                        *_strings("error").fields,
                    ]
                )
            ),
        ),
    ]
)
COMPLETED_BATCH = StructType(
    [
        *_strings("batch_id processed_at").fields,
        StructField("count", LongType()),
        StructField("records", ArrayType(COMPLETED_RECORD)),
    ]
)
PENDING_CASE = StructType(
    [
        *_strings("case_id created_at status").fields,
        StructField("student_id", LongType()),
        *_strings("nom prenom annee_univ generated_matricule source resolved_at resolved_matricule").fields,
    ]
)
