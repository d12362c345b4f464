"""Small literal cases and brute-force checks of single rules."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from scholarch.functions import json_text, labels, numbers, text
from scholarch.operators import identity as I
from scholarch.operators import linkage as L
from scholarch.operators import modules as M
from scholarch.operators import quality as Q
from scholarch.sources import files


def one(spark, column, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "word, key",
    [("ashcraft", "A226"), ("1abc", "1120"), ("Tymczak", "T522"), ("Pfister", "P236"), ("", ""), ("É", "E000"), ("bob b", "B100")],
)
def test_soundex(spark, word, key):
    assert one(spark, text.soundex_key, word) == key


def test_normalize_text(spark):
    assert one(spark, text.normalize_text, "  É-l'Ève ﬁn Ĳ  9 ") == "e l eve fin ij 9"
    assert one(spark, text.normalize_text, "™ № 𝐀 ㎢ ½ Å") == "tm no a km2 1 2 a"
    assert one(spark, text.normalize_text, None) == ""


def test_normalize_text_is_exact_for_every_character(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = [("".join(f"a{chr(c)}b " for c in points[i : i + 97]),) for i in range(0, len(points), 97)]
    df = spark.createDataFrame(rows, "x string")
    assert df.select(text.normalize_text(F.col("x")).alias("a"), text.normalize_text_exact("x").alias("b")).filter("a <> b").count() == 0


@pytest.mark.parametrize("raw, want", [("12,5abc", 12.5), ("abc", None), ("", None), (".5", 0.5), ("-3", -3.0)])
def test_coerce_number(spark, raw, want):
    assert one(spark, numbers.coerce_number, raw) == want


@pytest.mark.parametrize(
    "rule, raw, value, uncertain",
    [
        (numbers.number_or_uncertain, "?", None, True),
        (numbers.number_or_uncertain, " 12,5 ", 12.5, False),
        (numbers.number_or_uncertain, None, None, False),
        (numbers.natural_or_uncertain, "-0.5", 0.0, False),
        (numbers.natural_or_uncertain, "-2", None, True),
        (numbers.decimal_avg_or_uncertain, "12", None, True),
        (numbers.decimal_avg_or_uncertain, "12.0", 12.0, False),
    ],
)
def test_tri_state(spark, rule, raw, value, uncertain):
    got = one(spark, rule, raw)
    assert (got["value"], got["uncertain"]) == (value, uncertain)


def test_json_in_text(spark):
    answer = 'a {"x": "} {"} b {"y": 2} c {bad'
    df = spark.createDataFrame([(answer,)], "x string")
    assert df.select(json_text.json_last_balanced("x")).first()[0] == '{"y": 2}'
    assert df.select(json_text.json_greedy(F.col("x"))).first()[0] is None


def test_section_code(spark):
    assert one(spark, labels.normalize_section_code, "2_I. TRC") == "2-I-TRC"
    assert one(spark, labels.normalize_section_code, "section") is None


def test_align_modules_brute_force(spark):
    rnd = random.Random(7)
    pool = ["MAT", "FOR", "PL1", "PLI", "GES", "GE5", "ANG", "", "UNCERTAIN", "STR", "MA7"]
    rows = [(i, [rnd.choice(pool) for _ in range(rnd.randint(0, 6))], [rnd.choice(pool) for _ in range(rnd.randint(1, 6))]) for i in range(60)]

    def score(a, b):
        if not a or not b:
            return 0.0
        return min(1.0, difflib.SequenceMatcher(None, a, b).ratio() + 0.05 * (a[0] == b[0]) + 0.03 * (abs(len(a) - len(b)) <= 1))

    def expect(mine, want):
        want = [w for w in want if w]
        open_codes, hit, used = list(dict.fromkeys(want)), {}, set()
        for i, c in enumerate(mine):
            if c not in ("", "UNCERTAIN") and c in open_codes:
                hit[c] = i
                open_codes.remove(c)
                used.add(i)
        for i, c in enumerate(mine):
            if i in used or c in ("", "UNCERTAIN") or not open_codes:
                continue
            best = max(open_codes, key=lambda w: (score(c, w), -open_codes.index(w)))
            if score(c, best) >= 0.72:
                hit[best] = i
                open_codes.remove(best)
        return [(w, hit.get(w, -1)) for w in want]

    df = spark.createDataFrame(rows, "id int, codes array<string>, expected array<string>")
    df = df.withColumn("modules", F.transform("codes", lambda c: F.struct(c.alias("code"))))
    got = {r["id"]: [(x["code"], x["source_pos"]) for x in r["aligned"]] for r in M.align_modules(df, "modules", "expected").collect()}
    assert got == {i: expect(mine, want) for i, mine, want in rows}


def test_suggest_fallback_and_hot_name(spark):
    students = [(i, "Martin", "Paul", f"74/{i:03d}") for i in range(40)] + [(100, "Zuze", "Quoq", "75/100")]
    s = spark.createDataFrame(students, "id long, nom string, prenom string, matricule string")
    q = spark.createDataFrame(
        [(1, "Martin", "Paul", None), (2, "Xyxu", "", None), (3, "Martin", "Paul", "74/039")],
        "query_id long, nom string, prenom string, matricule string",
    )
    rows = L.suggest(q, s, limit=3).orderBy("query_id", "rank").collect()
    got = {k: [r["student_id"] for r in rows if r["query_id"] == k] for k in (1, 2, 3)}
    assert got[1] == [0, 1, 2]
    assert got[2] == [0, 1, 2]
    assert got[3] == [39, 0, 1]


def test_reconcile_outcomes(spark):
    """With unique ids and numbers the found number belongs to another row, so no case is an update."""
    s = spark.createDataFrame(
        [(1, "Ali", "Ben", "74/1"), (2, "Ali", "Ben", "TMP-1"), (3, "Ada", "Lo", "75/9")],
        "id long, nom string, prenom string, matricule string",
    )
    cases = spark.createDataFrame(
        [("a", "pending", "ALI", "Ben", "TMP-1"), ("b", "pending", "ada", "Lo", "TMP-2"), ("c", "pending", "No", "One", "TMP-3"), ("d", "resolved", "Ali", "Ben", "TMP-1"), ("e", "pending", "Ada", "Lo", "75/9")],
        "case_id string, status string, nom string, prenom string, generated_matricule string",
    )
    got = {r["case_id"]: r["outcome"] for r in I.reconcile_pending(cases, s).collect()}
    assert got == {"a": "real_matricule_already_assigned", "b": "temporary_student_not_found", "c": "no_match_found", "e": "already_same_matricule"}


def test_reconciliation_is_applied(spark):
    s = spark.createDataFrame([(1, "TMP-1"), (2, "74/2")], "id long, matricule string")
    cases = spark.createDataFrame([("a", "pending"), ("b", "pending")], "case_id string, status string")
    outcomes = spark.createDataFrame([("a", 1, "75/7", "update"), ("b", 2, "75/8", "no_match_found")], "case_id string, temporary_student_id long, found_matricule string, outcome string")
    students, queue = I.apply_reconciliation(outcomes, cases, s, "now", preview=False)
    assert {r.id: r.matricule for r in students.collect()} == {1: "75/7", 2: "74/2"}
    assert {r.case_id: (r.status, r.resolved_matricule, r.resolved_at) for r in queue.collect()} == {"a": ("resolved", "75/7", "now"), "b": ("pending", None, None)}
    assert I.apply_reconciliation(outcomes, cases, s, "now") == (s, cases)


def test_cascade_refuses_a_parent_that_is_still_needed(spark):
    def rows(columns, *values):
        return spark.createDataFrame(values, columns)

    tables = {
        "programme": rows("id long", (1,), (2,), (3,)),
        "formation": rows("id long, programme_id long, annee_univ_id long", (30, 3, 1)),
        "periode_programme": rows("id long, programme_id long", (10, 1), (20, 2)),
        "module": rows("id long, matiere_id long, periode_id long", (100, 1, 10), (200, 2, 20)),
        "resultat": rows("inscriptionPer_id long, module_id long", (7, 100)),
    }
    out, refused = Q.cascade_delete(tables, "programme", rows("id long", (1,), (2,), (3,)))
    assert {r.id for r in refused.collect()} == {1, 3}  # a graded module; a formation
    left = {n: sorted(r[0] for r in df.collect()) for n, df in out.items()}
    assert left == {"programme": [1, 3], "formation": [30], "periode_programme": [10], "module": [100], "resultat": [7]}


def test_newest_batch_files_come_first(spark, tmp_path):
    import json
    import os

    for n, when in ((1, 100), (2, 300), (3, 200)):
        path = tmp_path / f"b{n}.json"
        path.write_text(json.dumps({"batch_id": f"b{n}", "count": 2, "records": [{"id": f"{n}-{i}"} for i in range(2)]}, indent=2))
        os.utime(path, (when, when))
    (tmp_path / "broken.json").write_text("{ broken")
    assert [r.id for r in files.scan_completed(spark, str(tmp_path), 5).collect()] == ["2-0", "2-1", "3-0", "3-1", "1-0"]
    assert files.scan_completed(spark, str(tmp_path)).count() == 6


def test_generated_numbers_are_repeatable_and_unique(spark):
    rows = spark.range(3000).select(F.col("id").alias("index"))
    taken = spark.createDataFrame([("TMP-78-AAABB-00000",)], "matricule string")
    first = I.generate_matricules(rows, "index", F.lit("TMP-78-AAABB"), taken, "s")
    again = I.generate_matricules(rows, "index", F.lit("TMP-78-AAABB"), taken, "s")
    assert first.count() == first.select("generated").distinct().count() == 3000
    assert first.exceptAll(again).count() == 0


def test_keyed_state_equals_batch_twin(spark):
    from scholarch.plans import QUERIES

    folder = "/root/testdata/sf0.001"
    keyed = QUERIES["stream_operation_state_keyed"](spark, folder).select("operation_id", "status")
    twin = QUERIES["stream_operation_state"](spark, folder).select("operation_id", "status")
    stale = keyed.filter("status = 'failed'").select("operation_id")
    assert keyed.count() == twin.count()
    assert keyed.join(stale, "operation_id", "left_anti").exceptAll(twin).count() == 0


EVENTS = "operation_id long, event_id long, status string, stage string, total_pages long, processed_pages long, failed_pages long, updated_at timestamp"


def _event(op, n, status, when, stage="extracting"):
    import datetime

    return (op, n, status, stage, 9, n, 0, datetime.datetime.fromisoformat(f"2024-03-{when}"))


def test_state_ends_with_the_operations(spark, tmp_path):
    """Only open operations and recent cancellations stay in the store; an operation of the standing table goes on."""
    from scholarch.streaming import jobs as J

    initial = spark.createDataFrame([_event(4, 1, "processing", "01 09:00"), _event(5, 1, "cancelled", "01 09:00")], EVENTS)
    runs = [
        [_event(1, 1, "processing", "01 10:00"), _event(2, 1, "processing", "01 10:00"), _event(3, 1, "cancelled", "01 10:00"), _event(5, 2, "processing", "01 10:00")],
        [_event(1, 2, "completed", "01 11:00"), _event(3, 2, "processing", "01 11:00"), _event(6, 1, "processing", "01 12:00", "timeout_waiting")],
        [_event(7, 1, "processing", "02 08:00")],
        [_event(7, 2, "processing", "04 08:00"), _event(3, 3, "processing", "04 08:00")],
    ]
    session = J.isolated_session(spark)
    kept = []
    for rows in runs:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events = session.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
        progress = J.run_available(J.operation_state_stream(events, keep_seconds=86_400, initial=initial), f"{tmp_path}/out", f"{tmp_path}/at", "update")
        kept.append(progress[-1]["stateOperators"][0]["numRowsTotal"])
    out = sorted((r.operation_id, r.event_id, r.status, r.stage, str(r.updated_at)[8:16]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert out == [
        (1, 1, "processing", "extracting", "01 10:00"),
        (1, 2, "completed", "extracting", "01 11:00"),
        (2, 1, "failed", "stale", "01 22:00"),
        (2, 1, "processing", "extracting", "01 10:00"),
        (3, 1, "cancelled", "extracting", "01 10:00"),
        (3, 3, "processing", "extracting", "04 08:00"),
        (4, 1, "failed", "stale", "01 21:00"),
        (6, 1, "processing", "timeout_waiting", "01 12:00"),
        (7, 1, "failed", "stale", "02 20:00"),
        (7, 1, "processing", "extracting", "02 08:00"),
        (7, 2, "processing", "extracting", "04 08:00"),
    ]
    assert kept == sorted(kept, reverse=True)[:1] + kept[1:] and kept[-1] < kept[0]


def test_a_stream_stopped_in_mid_input_goes_on_exactly_once(spark, tmp_path):
    import json

    from scholarch.streaming import jobs as J

    (tmp_path / "in").mkdir()
    for n in range(6):
        runs = [{"file_path": f"{n}-{i}.pdf", "pages": [{"page_number": p, "status": "ok"} for p in (1, 2)]} for i in range(3)]
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps(runs if n else runs[0], indent=2))
    (tmp_path / "in" / "broken.json").write_text('[{"file_path": "x", "pages": [')
    session = J.isolated_session(spark)
    out, at = f"{tmp_path}/out", f"{tmp_path}/at"
    done = J.run_some(J.ingest_runs(J.read_runs(session, f"{tmp_path}/in", 1)), out, at, 2)
    first = spark.read.parquet(out).count()
    assert done >= 1 and 0 < first < 32
    J.run_available(J.ingest_runs(J.read_runs(session, f"{tmp_path}/in", 1)), out, at)
    rows = [(r.file_path, r.page_number) for r in spark.read.parquet(out).collect()]
    assert len(rows) == len(set(rows)) == 2 * (1 + 5 * 3)


def test_table_sets_show_all_tables_of_a_version_or_none(spark, tmp_path):
    from scholarch.sources.versions import TableSet

    tables = TableSet(spark, str(tmp_path)).create({"a": "x int", "b": "y string"})
    good = {"a": spark.createDataFrame([(1,)], "x int"), "b": spark.createDataFrame([("u",)], "y string")}
    broken = spark.range(1).select(F.raise_error(F.lit("lost")).cast("string").alias("y"))
    with pytest.raises(Exception, match="lost"):
        tables.commit(0, {"a": good["a"], "b": broken})
    assert tables.version() == 0 and tables.read("a").count() == 0
    assert tables.commit(0, good) == 1 and [r.x for r in tables.read("a").collect()] == [1] and [r.y for r in tables.read("b").collect()] == ["u"]
    with pytest.raises(Exception, match="(?i)exist"):
        tables.commit(0, good)  # another load has taken this version
    assert tables.version() == 1 and tables.read("a", 0).count() == 0


def test_grades_loaded_again_change_nothing_and_nulls_are_rejected(spark, tmp_path):
    from scholarch.operators import grade_loading as G
    from scholarch.sources.versions import TableSet

    frame = spark.createDataFrame
    ref = {
        "etudiant": frame([(1, "A", "Omar", "Ali"), (2, "B", "Same", "Name"), (3, "C", "Same", "Name")], "id long, matricule string, nom string, prenom string"),
        "programme": frame([(7, "INF")], "id long, code string"),
        "annee_universitaire": frame([(2000, "2000-2001")], "id long, annee string"),
        "formation": frame([(70, 7, 2000)], "id long, programme_id long, annee_univ_id long"),
        "groupe": frame([(700, "G1", 70)], "id long, code string, formation_id long"),
        "periode_programme": frame([(71, "S1", 7)], "id long, libelle string, programme_id long"),
        "matiere": frame([(5, "MAT"), (6, "PHY")], "id long, code string"),
        "module": frame([(50, 5, 71)], "id long, matiere_id long, periode_id long"),
    }
    schema = "sheet_id long, matricule string, nom string, prenom string, programme string, annee string, groupe string, moy double, rang int, decisionJury string"
    sheets = frame(
        [
            (1, "A", None, None, " inf", "2000/2001", "g1", 12.0, 3, "Admis"),
            (2, None, "OMAR", "áli", "INF", "2000 / 2001", "G1", 13.0, 2, "Admis"),
            (3, None, "same", "name", "INF", "2000-2001", "G1", None, None, None),
            (4, "Z", None, None, "INF", "2000-2001", "G1", None, None, None),
            (5, "A", None, None, None, "2000-2001", "G1", None, None, None),
            (6, "A", None, None, "INF", None, "G1", None, None, None),
            (7, "A", None, None, "INF", "2000-2001", None, None, None, None),
        ],
        schema,
    )
    cells = frame(
        [(1, 1, "s1", "mat", "11,5"), (2, 1, "S1", "MAT", "14"), (2, 2, "S1", "PHY", "9"), (2, 3, "S9", "MAT", "9"), (2, 4, "S1", None, "9"), (2, 5, "S1", "MAT", "?"), (2, 6, "S1", "MAT", "21"), (4, 1, "S1", "MAT", "5")],
        "sheet_id long, pos int, periode string, code string, note string",
    )
    tables = TableSet(spark, str(tmp_path)).create(G.STANDING)
    for version, now in ((1, "t1"), (2, "t2")):
        assert G.load_grade_tables(sheets, cells, ref, tables, now) == version
        assert [tuple(r) for r in tables.read("inscription").collect()] == [(1, 1, 70, 700, 13.0, 2, "Admis", "t1")]
        assert [tuple(r) for r in tables.read("inscription_periode").collect()] == [(1, 1, 71, 700, 14.0, "t1")]
        assert [tuple(r) for r in tables.read("resultat").collect()] == [(1, 1, 50, 14.0, "t1")]
    reasons = sorted((r.sheet_id, r.pos or 0, r.reason) for r in tables.read("rejected").collect())
    assert reasons == [
        (2, 2, "subject not taught in the period"), (2, 3, "unknown period"), (2, 4, "unknown subject"), (2, 5, "unreadable note"), (2, 6, "note outside 0-20"),
        (3, 0, "ambiguous name"), (4, 0, "unknown student"), (5, 0, "unknown programme"), (6, 0, "unknown formation"), (7, 0, "unknown group"),
    ]
    assert G.load_grade_tables(sheets.limit(0), cells.limit(0), ref, tables, "t3") == 3 and tables.read("resultat").count() == 1


def test_numbers_of_a_stem_that_overflows(spark):
    """More rows than five digits hold, some of them taken: all slots are used, the rest takes the longer form."""
    stem, n = "ETU-78-AAABB", 16**5 + 2000
    taken = spark.range(3000).select(F.concat(F.lit(f"{stem}-"), F.lpad(F.hex(F.col("id") * 341), 5, "0")).alias("matricule"))
    odd = spark.createDataFrame([(f"{stem}-0000g",), (f"{stem}-1",), (None,), ("",), ("ETU-78-0123456789",)], "matricule string")
    rows = spark.range(n).select(F.col("id").alias("index"), F.when(F.col("id") % 200_000 == 7, "TMP-78-AAABB").otherwise(stem).alias("stem"))
    made = I.generate_matricules(rows, "index", F.col("stem"), taken.union(taken).union(odd), "s").cache()
    other = rows.where("stem like 'TMP%'").count()
    assert made.count() == made.select("generated").distinct().count() == made.select("index").distinct().count() == n
    assert made.join(taken.union(odd), made.generated == taken.matricule).count() == 0
    short = made.where(F.length("generated") == len(stem) + 6)
    assert short.where(f"generated like '{stem}-%'").count() == 16**5 - 3000 and short.where("generated like 'TMP%'").count() == other
    assert made.where("generated rlike '^ETU-78-[0-9A-F]{10}$'").count() == n - other - (16**5 - 3000)


def test_ranks_within_groups(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 97).cast("string"))).alias("g"), F.xxhash64("id").alias("x"))
    from pyspark.sql import Window

    from scholarch.operators.merge import ranks_within

    got = ranks_within(rows, "g", ["x"], "r").select("g", "x", "r")
    want = rows.withColumn("r", (F.row_number().over(Window.partitionBy("g").orderBy("x")) - 1).cast("long"))
    assert got.exceptAll(want).count() == 0 and got.count() == 5000


def test_folder_manifest_reads_only_what_may_pass(spark, tmp_path):
    from scholarch.operators import lookups as K

    contents = {"a.pdf": b"%PDF-1.7 x", "b.PDF": b"%PDF-1.4", "c.txt": b"%PDF-1.4", "e.pdf": b"%PDF-" + b"x" * 60, "f.pdf": b"PK\x03\x04", "sub dir/g h.pdf": b"%PDF-2.0"}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    uploads = files.scan_uploads(spark, str(tmp_path), 50)
    got = {r.file_name: (r.bytes, r.reason) for r in K.folder_manifest(uploads, 50).collect()}
    assert got == {
        "a.pdf": (10, None), "b.PDF": (8, None), "c.txt": (8, "Only PDF files are supported"), "e.pdf": (65, "File is too large"), "f.pdf": (4, "Not a PDF document"), "g h.pdf": (8, None),
    }
    plan = uploads.select("file_name", "bytes")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].splitlines()[0]


def test_runs_are_pruned_by_time_and_matched_by_stem(spark, tmp_path):
    import json
    import os

    for folder, path, when in (("doc_1_a", "/u/doc_1.pdf", 1000), ("doc_1_b", "/u/doc_1.pdf", 3000), ("doc_11_a", "/u/doc_1.pdf", 9000), ("doc_1_c", "/u/doc_11.pdf", 9000), ("doc_2_a", "/u/doc_2.pdf", 1500)):
        (tmp_path / folder).mkdir()
        file = tmp_path / folder / "extraction_result.json"
        file.write_text(json.dumps({"file_path": path, "total_pages": 2, "pages": []}, indent=1))
        os.utime(file, (when, when))
    (tmp_path / "doc_1_d").mkdir()
    (tmp_path / "doc_1_d" / "extraction_result.json").write_text("{ broken")
    uploads = spark.createDataFrame([(1, "/u/doc_1.pdf", 2000), (2, "/u/doc_2.pdf", 2000), (3, "/u/doc_2.pdf", None)], "upload_id long, file_path string, at int")
    uploads = uploads.select("upload_id", "file_path", F.timestamp_seconds("at").alias("started_at"))
    assert [(r.upload_id, r.run_id) for r in files.scan_runs_latest(files.scan_runs(spark, str(tmp_path)), uploads).orderBy("upload_id").collect()] == [(1, "doc_1_b"), (3, "doc_2_a")]
    assert {r.run_id for r in files.scan_runs(spark, str(tmp_path), "1970-01-01T00:30:00").collect()} == {"doc_1_b", "doc_11_a", "doc_1_c"}


# --- what a query does not read is not worked out --------------------------------------------------


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _sf_pages(spark):
    from scholarch.sources.adapters import Archive

    return Archive(spark, "/root/testdata/sf0.001").page()


def test_student_rows_cost_only_the_columns_read(spark):
    from scholarch.operators import pages as P

    rows = P.parse_students(_sf_pages(spark))
    assert "[eE]" in _optimized(rows.select("avg_s1"))  # the pattern of a number
    assert "[eE]" not in _optimized(rows.select("page_number", "modules"))


def test_averages_name_the_notes_once(spark):
    from pyspark.sql import functions as F
    from scholarch.operators import pages as P

    row = spark.sql("SELECT array(struct('12.5' AS s1), struct('' AS s1), struct('x' AS s1), struct(' ' AS s1), struct('1e999' AS s1)) AS cells")
    mean = row.select(P.average_of_cells(F.col("cells"), "s1").alias("m"))
    assert mean.first().m == 6.25
    # once as it stands and once trimmed
    assert _optimized(mean).count("[eE]") <= 2
    assert row.select(P.average_of_cells(F.slice("cells", 2, 2), "s1").alias("m")).first().m is None


def test_aligned_students_read_their_pages_once(spark):
    from scholarch.plans import QUERIES

    # the pages are parsed where they are written; both sides of the join read what was written
    assert "from_json" not in _optimized(QUERIES["align_modules_exact"](spark, "/root/testdata/sf0.001"))


def test_trusted_table_of_visited_pages(spark):
    from pyspark.sql import functions as F
    from scholarch.operators import modules as M

    def page(doc, number, codes):
        return ("b", doc, number, None if codes is None else [(f"C{i}", None) for i in range(codes)])

    documents = {"second wins a tie": [3, 3, 3], "first full page": [9, 2, 8], "second full page": [9, 8, 9], "one page": [4], "fullest": [None, 2, 5, 5], "none": [None, None]}
    rows = [page(d, n + 1, c) for d, sizes in documents.items() for n, c in enumerate(sizes)]
    pages = spark.createDataFrame(rows, "batch_id string, file_name string, page_number long, m array<struct<abrev: string, coef: struct<S1: string, S2: string>>>")
    chosen = M.select_module_table(pages.select("batch_id", "file_name", "page_number", F.struct(F.col("m").alias("matieres")).alias("result")))
    got = {r.file_name: (r.page_number, r.n_modules) for r in chosen.collect()}
    assert got == {"second wins a tie": (2, 3), "first full page": (1, 9), "second full page": (2, 8), "one page": (1, 4), "fullest": (3, 5)}


def test_student_payload_as_rows(spark):
    from pyspark.sql import functions as F
    from scholarch.operators import grades as G
    from scholarch.operators import pages as P

    pages = _sf_pages(spark)
    listed = P.unnest(G.normalize_student_payload(pages), "students", *P.PAGE_KEYS, item="st")
    rows = G.normalize_students(pages)
    assert rows.count() > 0
    assert rows.select(*listed.columns).exceptAll(listed).isEmpty() and listed.exceptAll(rows.select(*listed.columns)).isEmpty()
    assert "regexp" not in _optimized(rows.select(F.col("st.nom"))).replace("regexp_replace", "")
