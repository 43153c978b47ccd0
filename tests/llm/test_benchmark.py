"""Wu-Manber search against brute force over all windows."""

import hashlib
import random
import re

import pytest

from muster.llm import benchmark

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(text, items):
    words, hit, names = slow_words(text), set(), set()
    for name, body in items:
        w = slow_words(body)
        size = min(13, len(w))
        for s in range(len(w) - size + 1 if w else 0):
            for at in range(len(words) - size + 1):
                if words[at:at + size] == w[s:s + size]:
                    hit.update(range(at, at + size))
                    names.add("" if name is None else str(name))
    return (len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(words))


def tables():
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["The", "of", "éa", "b2", "Ünd", "x", "ne"]) for _ in range(n))
    items = [(k, prose(rng.choice([13, 14, 30, 60]))) for k in range(20)]
    items += [(20, "two Words"), (21, "single!"), (22, ""), (23, None), (None, "no id here at all"), (10, "ten more, of ten"),
              (24, "aa aa aa"), (24, "aa aa aa"), (25, "twelve " * 12)]
    texts = [None, "", "...", "single", "two--words two", "aa aa aa aa aa", "no id here at all", "twelve " * 30]
    for _ in range(80):
        base = rng.choice(items)[1] or "x"
        cut = base.split(" ")
        at = rng.randint(0, max(0, len(cut) - 13))
        texts.append(prose(rng.randint(0, 300)) + "\n" + "; ".join(cut[at:at + rng.choice([12, 13, 14, 40])]).upper())
    return texts, items


@pytest.mark.parametrize("limit", [10 ** 6, 700])
def test_equals_brute_force(spark, limit):
    texts, items = tables()
    docs = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "doc_id long, text string, n_hit string")
    found = benchmark.mark(docs, spark.createDataFrame(items, "item_id long, text string"), limit=limit)
    got = {r.doc_id: tuple(r[c] for c in benchmark.RESULTS) for r in found.collect()}
    expected = {k: slow(t, items) for k, t in enumerate(texts)}
    assert got == expected
    assert 10 < sum(e[4] for e in expected.values()) < len(texts)


def test_dropping_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "clean words", 5), (2, "tiny leak", 6), (2, "tiny leak", 6), (None, None, 7)],
                                 "doc_id long, text string, n_words int")
    items = spark.createDataFrame([(1, "Leak")], "item_id long, text string")
    kept = benchmark.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == [(1, "clean words", 5), (None, None, 7)]
    assert benchmark.drop_contaminated(docs, items.limit(0)).count() == 4
    assert benchmark.mark(docs.limit(0), items).count() == 0
