"""Fingerprints and components against brute force, with buckets small enough to overflow."""

import random

import pytest
import xxhash

from scholarch.llm import simhash

ROWS = "doc_id long, text string, fp string, component string"


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def near(prints):
    return [(a, b) for i, a in enumerate(prints) for b in prints[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3]


@pytest.mark.parametrize("text", ["", " \t\n", "A", "a b", "a b c", "Straße É é x y z", "a\x0bb\x0cc\x1cd", "w " * 5000, "a\u00a0b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_null_text():
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("bucket", [2048, 20, 4])
def test_links_connect_what_brute_force_links(spark, bucket):
    rng = random.Random(bucket)
    prints = set()
    for _ in range(6):
        seed = rng.getrandbits(64)
        for _ in range(40):  # families around a seed, some of them chains
            prints.add(seed)
            for _ in range(rng.randint(1, 3)):
                seed ^= 1 << rng.randrange(64) if rng.random() < 0.6 else 1 << rng.randrange(20)
    prints |= {rng.getrandbits(64) for _ in range(100)} | {0, 2**64 - 1}
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = [tuple(r) for r in simhash.fingerprint_links(df, 3, bucket).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in links)
    assert groups(links, signed) == groups(near(signed), signed)


def test_near_duplicates(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(400)]
    rows = [(10, " ".join(base)), (4, " ".join(base)), (7, " ".join([*base[:200], "new", *base[201:]])), (1, "one two"), (1, "one two"), (None, "One TWO"), (None, "quite other words"), (3, None), (2, ""), (9, "  ")]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(30))) for i in range(50)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], ROWS)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    prints = [plain_fingerprint(t) for _, t in rows]
    place = groups(near(sorted(set(prints))), set(prints))
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[place[p]] = min(i, least.get(place[p], i))
    assert got == sorted(((i, f"{p:016x}", least.get(place[p])) for (i, _), p in zip(rows, prints, strict=True)), key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
