"""Finding the JSON object inside a noisy answer text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def json_greedy(text: Column) -> Column:
    """From the first '{' to the last '}', null when there is none or it does not parse.

    The parser ignores text after the first value, so the piece is checked as the only
    element of an array.
    """
    found = F.regexp_extract(text, "(?s)\\{.*\\}", 0)
    whole = F.try_parse_json(F.concat(F.lit("["), found, F.lit("]")))
    alone = F.try_variant_get(whole, "$[1]", "variant").isNull()
    return F.when((found != "") & whole.isNotNull() & alone, found)


_TOKEN = re.compile(r'[{}]|"(?:[^"\\]|\\.)*"?', re.S)


def _last_object(text: str | None) -> str | None:
    """Source text of the last top-level {...} that parses; quotes and escapes respected."""
    if not text:
        return None
    best, start = None, text.find("{")
    while start >= 0:
        depth = 0
        end = -1
        # braces outside strings; a string is one token, also one that never closes
        for token in _TOKEN.finditer(text, start):
            if token[0] == "{":
                depth += 1
            elif token[0] == "}":
                depth -= 1
                if depth == 0:
                    end = token.end()
                    break
        if end < 0:
            return best
        try:
            json.loads(text[start:end])
            best = text[start:end]
        except ValueError:
            pass
        start = text.find("{", end)
    return best


@F.pandas_udf(StringType())
def _last_objects(texts: pd.Series) -> pd.Series:
    return texts.map(_last_object)


def json_last_balanced(text: Column | str) -> Column:
    """The last object of a text; one without both braces never reaches Python."""
    column = F.col(text) if isinstance(text, str) else text
    piece = F.regexp_extract(column, "(?s)\\{.*\\}", 0)
    return _last_objects(F.nullif(piece, F.lit("")))
