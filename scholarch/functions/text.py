"""Text normalisation, phonetic and trigram keys as native column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Python's idea of white space, as a Java character class and as a set of characters.
WS = "[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]"
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """(from, to, longer), derived from the Unicode decomposition rule over all planes.

    A character's folded form is its NFKD form without combining marks, in lower case, with
    anything but a-z and 0-9 as a blank.  `from`/`to` feed `translate`: the characters with a
    folded form of one letter or digit; last come the marks, which have no counterpart, so
    translate deletes them.  `longer` holds the forms of several characters.  Characters in
    neither fold to a blank.
    """
    single, marks, longer = {}, [], {}
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if not plain:
            marks.append(ch)
            continue
        if not any(c.isascii() and c.isalnum() for c in plain):
            continue
        folded = "".join(c if c.isascii() and c.isalnum() else " " for c in plain.lower())
        if len(folded) == 1:
            single[ch] = folded
        else:
            longer[ch] = folded
    return "".join(single) + "".join(marks), "".join(single.values()), longer


@lru_cache(maxsize=1)
def _longer_class() -> str:
    """The characters with longer forms as a character class of code point ranges."""
    points = sorted(map(ord, _fold_tables()[2]))
    ranges: list[list[int]] = []
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


@lru_cache(maxsize=1)
def _mark_tables() -> tuple[str, str]:
    """As `_fold_tables`, but canonical decomposition only (NFD) and any base character."""
    single, marks = {}, []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if 0x0300 <= cp <= 0x036F:
            marks.append(ch)
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not 0x0300 <= ord(c) <= 0x036F)
        if len(base) == 1 and base != ch:
            single[ch] = base
    return "".join(single) + "".join(marks), "".join(single.values())


def fold_ascii(col: Column) -> Column:
    """Letters and digits in their plain lower-case form; whatever has none stays as it is.

    Most texts are ASCII, or have no character with a longer form, and take the cheaper ways.
    """
    source, target, longer = _fold_tables()
    # two literals that the optimizer folds into one map
    forms = F.map_from_arrays(F.split(F.lit("\t".join(longer)), "\t"), F.split(F.lit("\t".join(longer.values())), "\t"))
    spelled = F.array_join(F.transform(F.regexp_extract_all(col, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.element_at(forms, c), c)), "")
    whole = F.when(col.rlike(_longer_class()), spelled).otherwise(col)
    return F.lower(F.when(col.rlike("[^\\x00-\\x7F]"), F.translate(whole, source, target)).otherwise(col))


def normalize_text(col: Column) -> Column:
    """Accents folded, lower case, everything but a-z and 0-9 one blank, trimmed; null gives ''."""
    folded = fold_ascii(F.coalesce(col, F.lit("")))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def normalize_text_exact(values: pd.Series) -> pd.Series:
    """The same with full NFKD (multi-character compatibility forms too), Arrow-batched.

    One text at a time, so that no more than the batch and its result are held.
    """
    return values.map(_normalized_exact)


def _normalized_exact(text: str | None) -> str:
    if not isinstance(text, str):
        return ""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def trim_ws(col: Column) -> Column:
    return F.btrim(col, F.lit(WS_CHARS))


def blank_to_null(col: Column) -> Column:
    # the first letter found ends the search; trimming would copy the text
    return F.when(F.rlike(col, F.lit(f"[^{WS[1:]}")), col)


def normalize_text_upper(col: Column) -> Column:
    """Accents folded, trimmed, upper case; punctuation stays."""
    source, target = _mark_tables()
    return F.upper(trim_ws(F.translate(F.coalesce(col, F.lit("")), source, target)))


def normalize_ws_lower(col: Column) -> Column:
    """White space collapsed and trimmed, lower case; accents stay."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), f"{WS}+", " ")))


def normalize_code(col: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(col, F.lit("")), f"{WS}+", ""))


def first_non_empty(*cols: Column) -> Column:
    """First value that is neither null nor blank (returned untrimmed)."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def split_name(col: Column) -> Column:
    """struct(nom, prenom): first token and the rest joined by blanks."""
    tokens = F.split(trim_ws(F.coalesce(col, F.lit(""))), f"{WS}+")
    rest = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.struct(
        F.coalesce(F.get(tokens, F.lit(0)), F.lit("")).alias("nom"),
        F.array_join(rest, " ").alias("prenom"),
    )


def full_search_term(nom: Column, prenom: Column, matricule: Column | None = None) -> Column:
    parts = [nom, prenom] + ([matricule] if matricule is not None else [])
    trimmed = [F.nullif(trim_ws(p), F.lit("")) for p in parts]
    return F.concat_ws(" ", *trimmed)


# --- phonetic key -----------------------------------------------------------------

# fixed values: letter -> digit of the phonetic key ('0' = not coded; digits are not coded)
_SOUNDEX_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
_SOUNDEX_DIGITS = "012301200224550126230102020000000000"


def soundex_of_normalized(norm: Column) -> Column:
    """Four-character key of an already normalised text; '' for an empty one.

    Runs of one code collapse first; the run of the leading letter is then dropped and
    uncoded letters removed, so h and w separate equal codes (unlike Spark's `soundex`).
    """
    word = F.replace(norm, F.lit(" "), F.lit(""))
    codes = F.regexp_replace(F.translate(word, _SOUNDEX_LETTERS, _SOUNDEX_DIGITS), "(.)\\1+", "$1")
    tail = F.replace(F.substring(codes, 2, 1 << 30), F.lit("0"), F.lit(""))
    key = F.rpad(F.concat(F.upper(F.substring(word, 1, 1)), tail), 4, "0")
    return F.when(word == "", F.lit("")).otherwise(key)


def soundex_key(col: Column) -> Column:
    return soundex_of_normalized(normalize_text(col))


# --- trigrams ----------------------------------------------------------------------


def trigrams_of_normalized(norm: Column) -> Column:
    padded = F.concat(F.lit("  "), norm, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(norm) + 1), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def trigram_set(col: Column) -> Column:
    return trigrams_of_normalized(normalize_text(col))


def trigram_serialize(grams: Column) -> Column:
    """Sorted distinct non-empty grams joined by '|'."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(grams, lambda g: g != ""))), "|")


def trigram_deserialize(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), "\\|")
    return F.array_distinct(F.filter(parts, lambda g: g != ""))


def trigram_similarity(left: Column, right: Column) -> Column:
    """Dice coefficient of two gram sets, 0 when either is empty."""
    total = F.size(left) + F.size(right)
    shared = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        F.lit(2.0) * shared / total
    )


# --- identity tokens ------------------------------------------------------------------


def normalize_matricule(col: Column) -> Column:
    return F.lower(F.translate(col, "-_ ", ""))


def matricule_suffix4(col: Column) -> Column:
    return F.right(col, F.lit(4))


def matricule_numeric(col: Column) -> Column:
    """Leading digits as a number when the first character is a digit, else null."""
    return F.regexp_extract(col, "^[0-9]+", 0).try_cast("bigint")


def safe_token(col: Column, length: int) -> Column:
    cleaned = F.upper(F.regexp_replace(F.coalesce(col, F.lit("")), "[^A-Za-z0-9]", ""))
    return F.rpad(F.substring(cleaned, 1, length), length, "X")


def year_token(col: Column, run_year: str) -> Column:
    """Last two digits of the first four-digit run, else the two digits of the run year."""
    found = F.regexp_extract(F.coalesce(col, F.lit("")), "([0-9]{4})", 1)
    return F.when(found != "", F.right(found, F.lit(2))).otherwise(F.lit(run_year[-2:]))


def strict_academic_year(col: Column) -> Column:
    """YYYY/YYYY kept (untouched) only when the years are consecutive."""
    trimmed = trim_ws(col)
    first = F.regexp_extract(trimmed, "^([0-9]{4})/([0-9]{4})$", 1).try_cast("int")
    second = F.regexp_extract(trimmed, "^([0-9]{4})/([0-9]{4})$", 2).try_cast("int")
    return F.when(second == first + 1, col)


def image_relative_path(col: Column) -> Column:
    """Forward slashes, cut from the first '/tmp/' on; null when there is none."""
    path = F.translate(col, "\\", "/")
    at = F.instr(F.lower(path), "/tmp/")
    return F.when(at > 0, F.substring(path, at, F.length(path)))
