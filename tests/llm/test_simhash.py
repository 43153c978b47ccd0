"""SimHash links against brute force over all pairs."""

import random

import pytest
import xxhash

from muster.llm import simhash


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace(
        "\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            votes[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * votes[k] > len(shingles))


def slow_components(rows):
    leader = list(range(len(rows)))

    def find(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if bin(a ^ rows[j][1]).count("1") <= 2:
                leader[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        known = [k for k in (key, least.get(find(i))) if k is not None]
        least[find(i)] = min(known, default=None)
    return [least[find(i)] for i in range(len(rows))]


def texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgÉß") for _ in range(5))
    base = [" ".join(word() for _ in range(rng.randint(1, 150))) for _ in range(40)]
    near = [b.replace(" ", "  ", 1).upper() if i % 3 else b + " end" for i, b in enumerate(base)]
    return [None, "", " \n\t", "one", "One two", "one two three", *base, *near, *base[:5], "x y z"]


def test_fingerprints_and_components(spark):
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts())]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, fp string")
    got = sorted(map(tuple, simhash.near_duplicates(docs.repartition(3)).collect()), key=repr)
    prints = [(k, slow_fingerprint(t)) for k, t in rows]
    expected = [(k, f"{f:016x}", c) for (k, f), c in zip(prints, slow_components(prints))]
    assert got == sorted(expected, key=repr)


@pytest.mark.parametrize("below", [32, 2])
def test_links_of_crowded_and_sparse_grid_points(spark, monkeypatch, below):
    monkeypatch.setattr(simhash, "PAIRS_BELOW", below)
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(300)} | {0, 1, 3, 7, (1 << 64) - 1, 1 << 63}
    for centre in list(prints)[:6]:
        for _ in range(60):
            centre ^= 1 << rng.randrange(64)
            prints.add(centre ^ (1 << rng.randrange(64)))
            prints.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    rows = [(i, f) for i, f in enumerate(sorted(prints))]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    marked = spark.createDataFrame([(i, signed(f)) for i, f in rows], "__key long, fp long")
    got = {r["__key"]: r.component_id for r in simhash.labelled(marked).collect()}
    assert [got[i] for i, _ in rows] == slow_components(rows)


def test_one_of_each_stays(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "A b c d "), (9, "other words here now"),
            (None, "lonely words are these"), (None, None), (8, ""), (4, "A B C D")]
    docs = spark.createDataFrame([(k, t, i % 2) for i, (k, t) in enumerate(rows)], "doc_id long, text string, mark int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 8, 9, None]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0
