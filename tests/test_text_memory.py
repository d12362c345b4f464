"""What a batch of long texts costs while it is normalised."""

import tracemalloc
import unicodedata

import pandas as pd

from scholarch.functions.text import _normalized_exact


def plain(values: pd.Series) -> pd.Series:
    text = values.fillna("").str.normalize("NFKD").map(lambda s: "".join(c for c in s if not unicodedata.combining(c)))
    return text.str.lower().str.replace(r"[^a-z0-9]+", " ", regex=True).str.strip()


def peak(work) -> int:
    tracemalloc.start()
    work()
    try:
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_one_text_at_a_time():
    values = pd.Series(["Élève ﬁn Å x́ " * 300, "PLAIN  text, no. 7\n" * 300, None, "", "İI ① -"] * 60)
    assert values.map(_normalized_exact).tolist() == plain(values).tolist()
    assert peak(lambda: values.map(_normalized_exact)) < 0.6 * peak(lambda: plain(values))
