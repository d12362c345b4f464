"""SQL text twins of the adapters and column rules, for the row-by-row comparison.

Only strings live here: `query(body)` prefixes the common table expressions that the body
mentions.
"""

from __future__ import annotations

import re

from scholarch.sources.adapters import CODES, DECISIONS, RANKS, READINGS, SECTION_CODES, SINGLE_NAMES, TABLE_CODES, TYPES

WS_RE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def n_modules(k: str) -> str:
    """Modules of a student on page k; a few pages have more than ten."""
    return f"(CASE WHEN {k} % 50 = 9 THEN 12 ELSE {k} % 4 END + 1)"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(coalesce({x},''))), '[^a-z0-9]+', ' ', 'g'))"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_RE}+|{WS_RE}+$', '', 'g')"


def soundex(normed: str) -> str:
    word = f"replace({normed}, ' ', '')"
    codes = (
        f"translate({word}, 'abcdefghijklmnopqrstuvwxyz0123456789', '012301200224550126230102020000000000')"
    )
    for digit in "0123456":
        codes = f"regexp_replace({codes}, '{digit}+', '{digit}', 'g')"
    return (
        f"CASE WHEN {word} = '' THEN '' ELSE substr(rpad(upper(substr({word},1,1)) || replace(substr({codes},2), '0', ''), 40, '0'), 1, 4) END"
    )


def trigrams(normed: str) -> str:
    return (
        f"CASE WHEN {normed} = '' THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, length({normed}) + 2), "
        f"lambda i: substr('  ' || {normed} || ' ', i, 3))) END"
    )


def dice(a: str, b: str) -> str:
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"
    )


def dotted(x: str) -> str:
    return f"replace({trim_ws(x)}, ',', '.')"


def coerce_number(x: str) -> str:
    return f"try_cast(nullif(regexp_extract({dotted(x)}, '^[-+]?[0-9]*\\.?[0-9]+'), '') AS DOUBLE)"


def strict_number(text: str) -> str:
    return f"CASE WHEN regexp_full_match({text}, '[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?') THEN try_cast({text} AS DOUBLE) END"


def coerce_rank(x: str) -> str:
    return f"CAST(trunc({strict_number(dotted(x))}) AS BIGINT)"


def finite(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN NULL WHEN {trim_ws(x)} = '' THEN 0.0 ELSE {strict_number(trim_ws(x))} END"


def rnd(x: str, n: int) -> str:
    """Half-up on the shortest decimal form of the double."""
    return f"round((({x})::DOUBLE)::VARCHAR::DECIMAL(38,20), {n})::DOUBLE"


def number_value(x: str) -> str:
    return f"CASE WHEN regexp_full_match({dotted(x)}, '[-+]?[0-9]+(\\.[0-9]+)?') THEN try_cast({dotted(x)} AS DOUBLE) END"


def number_unc(x: str) -> str:
    return f"({x} IS NOT NULL AND {trim_ws(x)} <> '' AND ({number_value(x)}) IS NULL)"


def natural_value(x: str) -> str:
    return f"CASE WHEN ({number_value(x)}) > -1 THEN trunc({number_value(x)}) END"


def natural_unc(x: str) -> str:
    return f"({x} IS NOT NULL AND {trim_ws(x)} <> '' AND ({natural_value(x)}) IS NULL)"


def decimal_value(x: str) -> str:
    return f"CASE WHEN regexp_full_match({trim_ws(x)}, '[-+]?[0-9]+[.,][0-9]+') THEN try_cast({dotted(x)} AS DOUBLE) END"


def decimal_unc(x: str) -> str:
    return f"({x} IS NOT NULL AND {trim_ws(x)} <> '' AND ({decimal_value(x)}) IS NULL)"


def fne(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {trim_ws(x)} <> '' THEN {x} END" for x in xs) + ")"


def raw_number(x: str) -> str:
    return pick(x, *READINGS)


def raw_rank(x: str) -> str:
    return pick(x, *RANKS)


def pick(x: str, *values: str | None) -> str:
    items = ", ".join("NULL" if v is None else "'" + v + "'" for v in values)
    return f"([{items}])[(({x}) % {len(values)}) + 1]"


def letters(x: str) -> str:
    return f"translate(({x})::VARCHAR, '0123456789', 'abekilmors')"


def _module_fields(x: str, single: bool) -> str:
    plain = pick("j", *SINGLE_NAMES)
    named = (
        f"CASE WHEN (k + j) % 7 = 0 THEN '' WHEN (k // 8 + j) % 5 = 0 THEN replace({plain}, 'i', '1') ELSE {plain} END AS name"
        if single
        else f"CASE WHEN ({x}) % 16 = 7 THEN 'Module ' || (j + 1)::VARCHAR END AS name"
    )
    coef = f"CASE WHEN ({x}) % 4 = 0 THEN (({x}) % 7)::VARCHAR END AS coef"
    notes = f"{raw_number(f'({x})*3+1')} AS s1, {raw_number(f'({x})*3+2')} AS s2"
    extra = (
        f"{raw_number(f'({x})*5+1')} AS coef_s1, {raw_number(f'({x})*5+2')} AS coef_s2"
        if single
        else "NULL::VARCHAR AS coef_s1, NULL::VARCHAR AS coef_s2"
    )
    return f"{pick(x, *CODES)} AS code, {named}, {coef}, {notes}, {extra}"


_S = "(k*3+i)"
CTES: dict[str, str] = {
    "etudiant": """
  SELECT doc_id AS id, t[1 + (doc_id * 31) % len(t)] AS nom, t[1 + (doc_id * 17 + 5) % len(t)] AS prenom,
         (74 + doc_id % 11)::VARCHAR || '/' || lpad(doc_id::VARCHAR, 9, '0') AS matricule,
         CASE doc_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS sexe,
         DATE '1955-01-01' + (doc_id % 3650)::INTEGER AS date_naissance, source AS lieu_naissance
  FROM (SELECT doc_id, source, string_split_regex(regexp_replace(text, '^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+$', '', 'g'), '[ \\t\\n\\f\\r]+') AS t FROM documents)
  WHERE len(t) >= 2""",
    "requete": """
  SELECT id AS query_id, CASE WHEN id % 20 = 0 OR length(nom) < 2 THEN nom ELSE substr(nom, 1, length(nom) - 1) END AS nom,
         prenom, CASE WHEN id % 30 = 0 THEN matricule END AS matricule
  FROM etudiant""",
    "variation_nom": f"""
  SELECT id AS etudiant_id, CASE WHEN quality = 1 THEN {norm("nom || ' ' || prenom")} ELSE {norm("nom")} END AS variation,
         (1 + id % 7)::INTEGER AS frequence
  FROM etudiant JOIN labels ON id = doc_id""",
    "recherche_log": """
  SELECT event_id AS id, CASE WHEN user_id % 7 <> 0 THEN CASE WHEN event_id % 97 = 5 THEN 1000000000 + user_id ELSE user_id END END AS etudiant_id, user_id AS cible_id,
         event_type AS type_recherche, floor(value)::INTEGER AS resultats_trouves,
         regexp_extract(props, '[0-9]+')::INTEGER % 2 AS correction_utilisateur, ts AS date_recherche
  FROM events""",
    "recherche_log_named": f"""
  SELECT l.id, l.etudiant_id, l.type_recherche, l.resultats_trouves, l.correction_utilisateur, l.date_recherche,
         e.nom || ' ' || e.prenom AS terme_recherche, {norm("e.nom || ' ' || e.prenom")} AS terme_normalise
  FROM recherche_log l JOIN etudiant e ON e.id = l.cible_id""",
    "confirmation": """
  SELECT l.id AS conf_id, l.etudiant_id AS selected_student_id,
         CASE WHEN l.id % 2 = 1 AND length(e.nom) > 1 THEN substr(e.nom, 1, length(e.nom) - 1) ELSE coalesce(e.nom, 'inconnu') END AS searched_nom,
         coalesce(e.prenom, '') AS searched_prenom, CASE WHEN l.id % 5 = 0 THEN e.matricule END AS searched_matricule,
         l.resultats_trouves AS result_count, l.date_recherche AS confirmed_at
  FROM recherche_log l LEFT JOIN etudiant e ON e.id = l.cible_id
  WHERE l.correction_utilisateur = 1 AND l.etudiant_id IS NOT NULL""",
    "annee_universitaire": """
  SELECT id, id::VARCHAR || '-' || (id + 1)::VARCHAR AS annee, make_date(id, 9, 1) AS date_debut, make_date(id + 1, 6, 30) AS date_fin
  FROM (SELECT DISTINCT year(o_orderdate) AS id FROM orders)""",
    "programme": "SELECT n_nationkey::BIGINT AS id, n_name AS code, n_name AS titre, n_regionkey % 2 AS doctorat FROM nation",
    "enrolment": """
  SELECT o_orderkey AS id, o_custkey AS etudiant_id, c_nationkey::BIGINT * 10000 + year(o_orderdate) AS formation_id,
         c_nationkey::BIGINT AS programme_id, year(o_orderdate) AS annee_univ_id, c_mktsegment AS groupe_code,
         o_orderstatus, o_totalprice, o_orderdate AS date_inscription
  FROM orders JOIN customer ON o_custkey = c_custkey""",
    "formation": "SELECT DISTINCT formation_id AS id, programme_id, annee_univ_id FROM enrolment",
    "groupe": "SELECT DISTINCT formation_id * 100 + ascii(groupe_code) AS id, groupe_code AS code, formation_id FROM enrolment",
    "inscription": """
  SELECT id, etudiant_id, formation_id, formation_id * 100 + ascii(groupe_code) AS groupe_id,
         CASE WHEN id % 9 <> 0 THEN floor(o_totalprice % 2100) / 100 END AS moy, (id % 40 + 1)::INTEGER AS rang,
         CASE o_orderstatus WHEN 'O' THEN 'Admis' WHEN 'F' THEN 'Eliminé' ELSE 'Passage conditionnel' END AS decisionJury, date_inscription
  FROM enrolment""",
    "matiere": "SELECT p_partkey AS id, upper(substr(p_name, 1, 3)) || p_partkey::VARCHAR AS code, p_name AS title, p_size::DOUBLE AS coefficient FROM part",
    "periode_programme": "SELECT id * 2 + s AS id, 'S' || (s + 1)::VARCHAR AS libelle, s + 1 AS ordre, id AS programme_id FROM programme, (VALUES (0), (1)) v(s)",
    "module": "SELECT p_partkey AS id, p_partkey AS matiere_id, p_partkey % 50 AS periode_id, p_size / 2.0 AS coefficient FROM part",
    "inscription_periode": """
  SELECT id * 2 + s AS id, id AS inscription_id, programme_id * 2 + s AS periodepgm_id, formation_id * 100 + ascii(groupe_code) AS groupe_id
  FROM enrolment, (VALUES (0), (1)) v(s)""",
    "resultat": """
  SELECT l_orderkey * 2 + l_linenumber % 2 AS inscriptionPer_id, l_partkey AS module_id, round(l_quantity * 0.4, 2) AS moy,
         CASE WHEN l_returnflag <> 'A' THEN round(l_discount * 250, 2) END AS note_cc, round(l_tax * 200, 2) AS note_exam
  FROM lineitem""",
    "grade_sheet": """
  SELECT o_orderkey AS sheet_id, CASE WHEN o_orderkey % 10 <> 4 THEN (74 + o_custkey % 11)::VARCHAR || '/' || lpad(o_custkey::VARCHAR, 9, '0') END AS matricule, e.nom, e.prenom,
         CASE WHEN o_orderkey % 41 = 0 THEN 'AUTRE' WHEN o_orderkey % 2 = 0 THEN ' ' || lower(n_name) ELSE n_name END AS programme,
         (year(o_orderdate) + shift)::VARCHAR || CASE WHEN o_orderkey % 3 = 0 THEN ' / ' ELSE '-' END || (year(o_orderdate) + 1 + shift)::VARCHAR AS annee,
         CASE WHEN o_orderkey % 37 <> 0 THEN lower(c_mktsegment) END AS groupe,
         CASE WHEN o_orderkey % 9 <> 0 THEN floor(o_totalprice % 2100) / 100 END AS moy, (o_orderkey % 40 + 1)::INTEGER AS rang,
         CASE o_orderstatus WHEN 'O' THEN 'Admis' WHEN 'F' THEN 'Eliminé' ELSE 'Passage conditionnel' END AS decisionJury, o_orderdate AS dated
  FROM (SELECT *, CASE WHEN o_orderkey % 43 = 0 THEN 20 ELSE 0 END AS shift FROM orders) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN etudiant e ON e.id = o_custkey""",
    "grade_cell": """
  SELECT sheet_id, pos, CASE WHEN l_partkey % 47 = 0 THEN 'S3' ELSE 's' || (l_linenumber % 2 + 1)::VARCHAR END AS periode, lower(m.code) AS code,
         CASE WHEN l_partkey % 53 = 0 THEN 'uncertain' ELSE replace(round(l_quantity * 0.42, 2)::DECIMAL(6,2)::VARCHAR, '.', ',') END AS note, dated
  FROM (SELECT l_orderkey AS sheet_id, l_linenumber::INTEGER AS pos, l_partkey, l_linenumber, l_quantity, o_orderdate AS dated,
               CASE WHEN l_partkey % 19 = 0 THEN l_partkey ELSE l_partkey - l_partkey % 50 + c_nationkey * 2 + l_linenumber % 2 END AS part
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey) LEFT JOIN matiere m ON m.id = part""",
    "pending_case": """
  SELECT id AS case_id, CASE WHEN id % 10 <> 9 THEN 'pending' ELSE 'resolved' END AS status,
         CASE WHEN id % 3 = 2 THEN nom || 'zzq' ELSE translate(nom, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS nom, prenom,
         CASE WHEN id % 3 = 1 THEN 'TMP-' || id::VARCHAR ELSE matricule END AS generated_matricule
  FROM etudiant""",
    "save_row": f"""
  SELECT k AS index,
         CASE WHEN k % 37 = 0 THEN '  ' WHEN nom IS NOT NULL THEN nom ELSE 'Nouveau' || {letters('o_custkey')} END AS nom,
         CASE WHEN nom IS NOT NULL THEN prenom ELSE {letters('o_custkey')} END AS prenom,
         CASE WHEN k % 4 = 0 AND nom IS NOT NULL THEN ' ' || matricule || ' ' WHEN k % 16 = 1 THEN 'N' || o_custkey::VARCHAR END AS matricule,
         k % 5 = 0 AS is_first_year,
         CASE WHEN k % 6 = 0 THEN CASE WHEN k % 12 = 0 THEN '1960-13-45' ELSE date_naissance::VARCHAR END END AS date_naissance,
         CASE WHEN k % 2 = 0 THEN 'Ville ' || (k % 50)::VARCHAR END AS lieu_naissance,
         CASE WHEN k % 3 = 0 THEN 'F' END AS sexe, year(o_orderdate)::VARCHAR || '-x' AS annee_univ
  FROM (SELECT o_orderkey AS k, o_custkey, o_orderdate, e.nom, e.prenom, e.matricule, e.date_naissance
        FROM orders LEFT JOIN etudiant e ON e.id = o_custkey AND o_orderkey % 11 <> 3)""",
    "operation_event": """
  SELECT event_id, user_id AS operation_id,
         CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'cancelled' ELSE 'failed' END ELSE 'processing' END AS status,
         CASE WHEN event_type = 'signup' THEN 'timeout_waiting' ELSE 'extracting' END AS stage,
         (floor(value)::BIGINT % 40 + 1) AS total_pages, least(floor(value)::BIGINT % 40 + 1, event_id % 23) AS processed_pages,
         event_id % 2 AS failed_pages, ts AS updated_at
  FROM events""",
    "upload": """
  SELECT page_id AS upload_id,
         CASE WHEN page_id % 17 = 0 THEN '' ELSE 'dir/Doc_' || (page_id % 90)::VARCHAR || CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' ELSE '.pdf' END END AS file_name,
         CASE WHEN page_id % 5 = 1 THEN CASE WHEN page_id % 2 = 0 THEN 'application/pdf' ELSE 'text/plain' END ELSE 'application/pdf' END AS mime_type,
         CASE WHEN page_id % 13 = 0 THEN 0 ELSE length(html) * CASE WHEN page_id % 11 = 0 THEN 100000 ELSE 1 END END AS bytes,
         'batch_' || (page_id % 20)::VARCHAR AS batch_id, 1700000000 + page_id * 61 AS mtime_s
  FROM pages""",
    "raw_answer": """
  SELECT doc_id, text || chr(10) || CASE doc_id % 4 WHEN 0 THEN good WHEN 1 THEN good || ' et ' || good WHEN 2 THEN '{"doc": ' ELSE '' END || chr(10) || 'fin' AS answer, good
  FROM (SELECT doc_id, text, '{"doc": ' || doc_id::VARCHAR || ', "t": "a } b", "v": {"x": ' || (doc_id % 10)::VARCHAR || '}}' AS good FROM documents)""",
    "page": f"""
  SELECT k, c, yr, 'batch_' || (c % 20)::VARCHAR AS batch_id, 'doc_' || c::VARCHAR || '.pdf' AS file_name, k AS page_number,
         CASE WHEN k % 12 = 0 THEN 'failed' ELSE 'ok' END AS status,
         CASE WHEN k % 24 = 0 THEN '429 Quota exceeded' WHEN k % 12 = 0 THEN 'invalid answer' END AS error,
         CASE WHEN k % 12 <> 0 THEN {pick('k', *TYPES)} END AS type,
         CASE WHEN k % 12 <> 0 THEN {pick('k', *SECTION_CODES)} END AS sectionCode,
         CASE WHEN k % 12 <> 0 THEN yr::VARCHAR || '/' || (yr + k % 2)::VARCHAR END AS annee,
         CASE WHEN k % 12 <> 0 THEN {pick('k', '1ere', None, '2eme')} END AS anneeEtude,
         CASE WHEN k % 12 <> 0 THEN {pick('k', None, '', 'A', 'B')} END AS section,
         CASE WHEN k % 12 <> 0 THEN {pick('k', None, 'Opt')} END AS option,
         CASE WHEN k % 12 <> 0 AND k % 14 = 3 THEN 'err ' || k::VARCHAR END AS rerror,
         CASE WHEN k % 12 <> 0 AND k % 10 = 5 THEN 'md ' || k::VARCHAR END AS markdown
  FROM (SELECT o_orderkey AS k, o_custkey AS c, year(o_orderdate) AS yr FROM orders)""",
    "single": f"""
  SELECT k, c, batch_id, file_name, page_number, annee, anneeEtude,
         upper({letters('c*31')}) || '  Prénom ' || {letters('k % 1000')} AS name,
         {pick('k // 8', None, '', 'S1', 'S2')} AS section, yr::VARCHAR || '/' || (yr + k % 3)::VARCHAR AS year,
         CASE WHEN k % 5 <> 0 THEN '74/' || k::VARCHAR END AS matricule,
         {pick('k', *DECISIONS)} AS dj, {pick('k // 8', *DECISIONS)} AS df, {pick('k // 16', *DECISIONS)} AS observation,
         {raw_number('k*11+4')} AS avg1, {raw_number('k*11+5')} AS avgg, {raw_rank('k+2')} AS rankg,
         {raw_number('k*11+1')} AS sm1, {raw_rank('k')} AS sr1, {raw_number('k*11+2')} AS sm2, {raw_rank('k+1')} AS sr2,
         {raw_number('k*11+3')} AS smg, {raw_rank('k+4')} AS srg
  FROM page WHERE type = 'single_student'""",
    "single_module": f"""
  SELECT k, c, batch_id, file_name, page_number, j, {_module_fields('k*4+j', True)}
  FROM page, unnest(range(0, k % 5 + 1)) AS u(j) WHERE type = 'single_student'""",
    "student": f"""
  SELECT k, c, i, {_S} AS s, batch_id, file_name, page_number, type,
         CASE WHEN {_S} % 41 = 0 THEN '' ELSE upper({letters('c*31+i')}) END AS nom, 'Prénom ' || {letters(f'{_S} % 1000')} AS prenom,
         CASE WHEN {_S} % 5 = 0 THEN NULL WHEN {_S} % 7 = 0 THEN '' ELSE (74 + {_S} % 11)::VARCHAR || '/' || {_S}::VARCHAR END AS matricule,
         {pick(f'{_S}+1', *DECISIONS)} AS decision, {raw_number(f'{_S}*11+1')} AS m1, {raw_number(f'{_S}*11+2')} AS m2, {raw_number(f'{_S}*11+3')} AS ma,
         {raw_rank(_S)} AS r1, {raw_rank(f'{_S}+1')} AS r2, {raw_rank(f'{_S}+4')} AS ra, {pick(_S, *DECISIONS)} AS dj, {pick(f'{_S}+5', *DECISIONS)} AS df,
         {raw_number(f'{_S}*13+5')} AS nbrAbs, {raw_number(f'{_S}*17+6')} AS stage
  FROM page, unnest(range(0, k % 3 + 1)) AS u(i) WHERE type IN ('multiple_students', 'resultats_annonce')""",
    "student_module": f"""
  SELECT k, c, i, s, batch_id, file_name, page_number, type, j, {_module_fields('s*4+j', False)}
  FROM student, unnest(range(0, {n_modules('k')})) AS u(j)""",
    "matiere_row": f"""
  SELECT k, c, batch_id, file_name, page_number, j, CASE WHEN (k + j) % 9 = 0 THEN '' ELSE {pick('j', *TABLE_CODES)} END AS abrev,
         CASE WHEN (k + j) % 18 = 0 THEN '' ELSE 'Matière ' || j::VARCHAR END AS libelle, {raw_number('k+j')} AS c1, {raw_number('k+j+1')} AS c2,
         {', '.join(f"{raw_number(f'k*7+j+{n}')} AS v{n}" for n in range(6))}
  FROM page, unnest(range(0, 2 + (k // 8) % 10 + 1)) AS u(j) WHERE type = 'table_de_matieres'""",
    "record": """
  SELECT k, batch_id, '/up/Doc_' || k::VARCHAR || '.pdf' AS file_path, 1600000000 + k % 997 AS processed_s,
         CASE k % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' WHEN 2 THEN 'cancelled' ELSE 'ok' END AS status,
         k % 3 + 1 AS total_pages, k % 3 + 1 - nf AS ok_pages, nf AS failed_pages
  FROM (SELECT o_orderkey AS k, 'batch_' || (o_custkey % 20)::VARCHAR AS batch_id,
               len(list_filter(range(0, o_orderkey % 3 + 1), lambda i: (o_orderkey + i) % 5 = 0)) AS nf FROM orders)""",
    "record_page": """
  SELECT r.k, r.batch_id, r.file_path, r.processed_s, r.status AS record_status, 3 - i AS page_number, CASE WHEN (r.k + i) % 5 = 0 THEN 'failed' ELSE 'ok' END AS status,
         '/srv/tmp/p' || i::VARCHAR AS image_path, CASE WHEN (r.k + i) % 5 = 0 THEN '503 busy' END AS error,
         CASE WHEN (r.k + i) % 5 <> 0 THEN 'type_' || (r.k % 8)::VARCHAR END AS kind
  FROM record r, unnest(range(0, r.k % 3 + 1)) AS u(i)""",
}


def query(body: str, **extra: str) -> str:
    """`WITH <every CTE the body needs> body`; `extra` adds query-local expressions in order."""
    known = {**CTES, **extra}
    order: list[str] = []

    def visit(text: str, stack: tuple[str, ...]) -> None:
        for name in known:
            if name in stack or name in order:
                continue
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b|,\s*{name}\s+[a-z]+\d?\b", text):
                visit(known[name], (*stack, name))
                order.append(name)

    visit(body, ())
    head = ",\n".join(f"{name} AS ({known[name].strip()})" for name in order)
    return (f"WITH {head}\n" if head else "") + body.strip()
