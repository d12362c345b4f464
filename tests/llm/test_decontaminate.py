"""Contamination against brute force, by broadcast and by join; removal of spans and documents."""

import hashlib
import random
import re

import pytest

from scholarch.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(doc, items, n=10):
    own = words(doc)
    hit, names = set(), set()
    for item, text in items:
        w = words(text)
        if item is None or not w:
            continue
        size = min(n, len(w))
        for i in range(len(w) - size + 1):
            for j in range(len(own) - size + 1):
                if own[j : j + size] == w[i : i + size]:
                    hit |= set(range(j, j + size))
                    names.add(str(item))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(own), len(hit), len(names), digest, bool(hit)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    pool = ["alpha", "Beta", "GAMMA", "déjà", "x1", "日本", "of", "the"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([3, 9, 10, 14])))) for i in range(12)]
    items += [(20, ""), (21, None), (None, "of the"), (5, "the x1 of x1 the"), (30, "...")]
    docs = []
    for i in range(60):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        if i % 3 == 0:
            text += ", " + rng.choice(items[:12])[1].upper() + "! " + text
        docs.append((i, text))
    docs += [(None, items[0][1]), (61, None), (62, ""), (0, docs[0][1]), (63, "w " * 20000 + items[1][1])]
    return docs, items, spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_words string"), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words int")


@pytest.mark.parametrize("most", [10**6, 0])
def test_contamination(tables, most):
    docs, items, left, right = tables
    got = sorted(map(tuple, decontaminate.contamination(left, right, max_words=most).collect()), key=str)
    assert got == sorted(((i, *brute(t, items)) for i, t in docs), key=str)


def test_empty_tables(tables):
    _, _, left, right = tables
    assert decontaminate.contamination(left.limit(0), right).count() == 0
    assert decontaminate.contamination(left, right.limit(0)).where("contaminated").count() == 0


def test_windows_that_share_a_code_are_numbered_anew(monkeypatch):
    items = [(str(i), f"w{i} w{i + 1} w{i % 3} end".encode()) for i in range(40)]
    plain = decontaminate.Matcher(items, 3)
    text = b" ".join(t for _, t in items[5:9] + items[5:9]).split()
    found = [plain.find(text)]
    code = decontaminate.Matcher._code
    seeds = []

    def poor(columns, seed):
        seeds.append(seed)
        return code(columns, seed) >> (60 if seed < 3 else 0) << (60 if seed < 3 else 0)

    monkeypatch.setattr(decontaminate.Matcher, "_code", staticmethod(poor))
    again = decontaminate.Matcher(items, 3)
    assert seeds == [1, 2, 3]
    found.append(again.find(text))
    want = {(i, 3) for i in range(len(text) - 2) if any(b" ".join(text[i : i + 3]) in t for _, t in items)}
    for spots in found:
        assert {f[:2] for f in spots} == want
        assert sorted({k for f in spots for k in f[2]}) == ["5", "6", "7", "8"]


@pytest.mark.parametrize("most", [10**6, 0])
def test_column_names_of_its_own_do_not_clash(tables, most):
    _, _, left, right = tables
    odd = left.selectExpr("doc_id", "text", "doc_id AS _row", "text AS _found", "1 AS first", "2 AS h")
    out = decontaminate.remove_hits(odd, right, max_words=most)
    assert out.columns == odd.columns
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, decontaminate.remove_hits(left, right, max_words=most).select("doc_id", "text").collect()))


@pytest.mark.parametrize("most", [10**6, 0])
def test_removal(tables, most):
    docs, items, left, right = tables
    out = decontaminate.remove_hits(left, right, max_words=most)
    assert out.columns == left.columns
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for i, text in docs:
        total, hit, *_ = brute(text, items)
        if hit == 0:
            assert text in got[i]
        elif hit == total:
            assert i not in got
        else:
            assert all(len(words(t)) == total - hit for t in got[i])
    whole = {r.doc_id for r in decontaminate.remove_hits(left, right, max_words=most, whole_documents=True).collect()}
    assert whole == {i for i, t in docs if not brute(t, items)[4]}


def test_spans_keep_the_rest_of_a_text():
    text = "Keep this -- one two. Three, four! and that"
    mask = [w in {"one", "two", "three", "four"} for w in words(text)]
    import numpy as np

    spans = decontaminate.hit_spans(text, np.array(mask))
    assert decontaminate.without_spans(text, spans) == "Keep this -- ! and that"
