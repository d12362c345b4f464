"""Vocabulary rules: statuses, decisions, section codes, labels, upload times, error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholarch.functions.text import WS, normalize_text, trim_ws

# fixed values: status synonyms
STATUS_SYNONYMS = {
    "completed": ["completed", "complete", "done", "success", "ok"],
    "processing": ["processing", "running", "in_progress", "in-progress"],
    "pending": ["pending", "queued", "waiting"],
    "cancelled": ["cancelled", "canceled"],
    "failed": ["failed", "error"],
}
# fixed values: statuses that end an operation
TERMINAL_STATUSES = ["ok", "failed", "completed", "cancelled", "canceled"]
# fixed values: markers of an error worth a retry
TRANSIENT_MARKERS = [
    "429", "503", "busy", "resource exhausted", "rate", "quota", "timeout",
    "temporarily unavailable", "try again",
]
# fixed values: normalised decision wording -> code
DECISION_CODES = {
    "admis": "admis",
    "elimine": "elimine",
    "elimine e": "elimine",
    "non admis": "non_admis",
    "provisoirement elimine": "provisoirement_elimine",
    "passage conditionnel": "passage_conditionnel",
    "ajourne": "ajourne",
}
# fixed values: known module codes
KNOWN_MODULE_CODES = [
    "MAT", "FOR", "FBR", "FGR", "PL1", "PLI", "GES", "ANG", "STR", "DEC", "STH", "IST",
    "STA", "CBB", "ASS", "STK", "FIP", "ANA", "FIC", "MEC", "ELE", "PHY", "CHI", "DES",
]


def normalize_status(col: Column) -> Column:
    text = F.lower(trim_ws(col))
    out = F.lit(None).cast("string")
    for status, words in STATUS_SYNONYMS.items():
        out = F.when(text.isin(words), F.lit(status)).otherwise(out)
    return F.coalesce(out, F.lit("pending"))


def record_status_label(col: Column) -> Column:
    text = F.lower(col)
    return (
        F.when(text.isin("ok", "completed"), "Completed")
        .when(text == "failed", "Failed")
        .when(text == "processing", "Processing")
        .otherwise("Unknown")
    )


def effective_status(status: Column, total: Column, ok: Column, failed: Column) -> Column:
    """A failed document whose pages were all read counts as completed."""
    normal = normalize_status(status)
    all_read = (total > 0) & (F.coalesce(failed, F.lit(0)) == 0) & (ok >= total)
    return F.when((normal == "failed") & all_read, "completed").otherwise(normal)


def normalize_decision(col: Column) -> Column:
    text = normalize_text(col)
    out = F.lit(None).cast("string")
    for wording, code in DECISION_CODES.items():
        out = F.when(text == wording, F.lit(code)).otherwise(out)
    return out


def normalize_section_code(col: Column) -> Column:
    """'2_I. TRC' and '2 I TRC' -> '2-I-TRC'; '77-1I-TRC' keeps its form; else null."""
    text = F.upper(trim_ws(col))
    plain = "^([0-9])[ _.-]+([IVX]+)[ _.-]+([A-Z]{2,4})$"
    dated = "^([0-9]{2})[ _.-]+([0-9][IVX]+)[ _.-]+([A-Z]{2,4})$"

    def joined(pattern: str) -> Column:
        return F.concat_ws("-", *[F.regexp_extract(text, pattern, g) for g in (1, 2, 3)])

    return F.when(text.rlike(plain), joined(plain)).when(text.rlike(dated), joined(dated))


def is_transient_error(col: Column) -> Column:
    return F.lower(col).rlike("|".join(TRANSIENT_MARKERS))


def transient_class(col: Column) -> Column:
    """First marker found in the error text, else 'other'."""
    text = F.lower(col)
    out = F.lit("other")
    for marker in reversed(TRANSIENT_MARKERS):
        out = F.when(F.contains(text, F.lit(marker)), F.lit(marker)).otherwise(out)
    return out


def module_label(position: Column, *labels: Column) -> Column:
    """First non-empty of the label columns, white space collapsed, else 'Module i'."""
    filled = [F.nullif(c, F.lit("")) for c in labels]
    default = F.concat(F.lit("Module "), (position + 1).cast("string"))
    return F.trim(F.regexp_replace(F.coalesce(*filled, default), f"{WS}+", " "))


def module_coefficient(*candidates: Column) -> Column:
    return F.coalesce(*candidates).cast("string")


def is_generic_label(col: Column) -> Column:
    return F.trim(col).rlike("(?i)^Module\\s+[0-9]+$")


def parse_upload_time(col: Column) -> Column:
    """Timestamp of an ISO text; a bare date means the end of that day; unreadable gives null."""
    text = trim_ws(col)
    whole = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(text, F.lit("T23:59:59"))).otherwise(text)
    return F.when(whole.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"), whole).try_cast("timestamp")


def parse_birth_date(col: Column) -> Column:
    """struct(value date, error): strict YYYY-MM-DD, empty gives null, anything else an error text."""
    value = F.when(col.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), col).try_cast("date")
    bad = col.isNotNull() & (col != "") & value.isNull()
    return F.struct(
        value.alias("value"),
        F.when(bad, F.concat(F.lit("bad date: "), col)).alias("error"),
    )


def page_specialty(section: Column, option: Column, section_code: Column, kind: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (section, option, section_code, kind)])
