"""Runs against a plain search over all periods: whole table, random and nested repeats, odd texts."""

import hashlib
import random
import zlib

import pytest

from scholarch.llm import periodic_runs
from scholarch.llm.common import table
from scholarch.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def brute(words):
    """Every maximal stretch of period q whose smallest period is q, four periods and six words long."""
    n, runs = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e - i + q
            if length >= max(6, 4 * q):
                part = words[i : i + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    runs.append((i, q, length))
            i = max(e, i + 1)
    return sorted(runs)


def expected(text):
    words = (text or "").encode().split()
    runs = brute(words)
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = None
    for s, q, n in runs:
        if best is None or n * best[1] > best[2] * q:
            best = (s, q, n)
    lines = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
    shown = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode()


def got(df):
    return [(r.doc_id, (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)) for r in df.collect()]


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    rows = dict(got(QUERIES["op13_periodic_runs"](spark, FOLDER)))
    assert rows.keys() == docs.keys()
    texts = {i: planted(i, t) for i, t in docs.items()}
    assert sum(texts[i] != t for i, t in docs.items()) > 5
    assert rows == {i: expected(t) for i, t in texts.items()}
    assert sum(r[0] > 0 for r in rows.values()) > 5


def samples():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (5, 6, 7, 40, 90, 200)]
    for q in (1, 2, 3, 4, 5, 7, 8, 12, 16, 31, 32, 33, 64, 100):
        for extra in (-1, 0, 1, q // 2, 3 * q):
            unit = [f"w{rng.randrange(50)}" for _ in range(q)]
            before = [f"b{rng.randrange(900)}" for _ in range(rng.randrange(0, 70))]
            texts.append(" ".join(before + (unit * 9)[: max(1, 4 * q + extra)] + [f"c{i}" for i in range(rng.randrange(0, 40))]))
    inner = "x x x x x x y ".split()
    texts += [" ".join(inner * 6), " ".join((inner * 5 + ["z"]) * 5), "same " * 700, " ".join((["k"] * 30 + ["l"]) * 4)]
    fib = ["a", "a b"]
    while len(fib[-1]) < 900:
        fib.append(f"{fib[-1]} {fib[-2]}")
    return texts + [fib[-1]]


@pytest.mark.parametrize("pack", [4096, 1])
def test_repeats_at_every_scale(spark, monkeypatch, pack):
    monkeypatch.setattr(periodic_runs, "PACK", pack)
    texts = samples()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(got(periodic_runs.report(periodic_runs.collapse(docs)))) == {i: expected(t) for i, t in enumerate(texts)}


def test_edges_and_copies(spark):
    loop = "one two three " * 5
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, loop), (4, loop), (None, loop), (5, "a b " * 6), (6, "a\x1cb a\x1cc " * 5), (None, None), (7, "a " * 5), (8, "a " * 6)]
    schema = "doc_id long, text string, key string, words string, runs int, period string, salt int"
    docs = spark.createDataFrame([(*r, "k", "w", 1, "p", 2) for r in rows], schema)
    out = periodic_runs.collapse(docs)
    assert sorted(got(periodic_runs.report(out)), key=str) == sorted(((i, expected(t)) for i, t in rows), key=str)
    assert {r.collapsed for r in out.where("doc_id = 4 OR doc_id = 8").collect()} == {"one two three", "a"}
    assert periodic_runs.report(periodic_runs.collapse(docs.limit(0))).count() == 0


def test_a_very_long_text(spark):
    """The unit of 50,000 words repeats five times, with a shorter loop inside it."""
    rng = random.Random(9)
    unit = [f"u{rng.randrange(10**6)}" for _ in range(50_000)]
    unit[700:720] = ["in", "out"] * 10
    words = ["start"] + unit * 5 + ["end"]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = periodic_runs.collapse(docs).first()
    assert [tuple(r) for r in row.runs] == sorted([(1, 50_000, 250_000), *((701 + 50_000 * i, 2, 20) for i in range(5))])
    assert row.collapsed == " ".join(["start"] + unit[:702] + unit[720:] + ["end"])
