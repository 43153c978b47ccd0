"""Repeat removal against brute force over all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

from muster.llm.repeats import anchored_runs, remove_repeats


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñß漢") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (90, 110, 150, 300)] + [prose(600)[:k] for k in (398, 399, 400, 401, 402, 470)]
    texts = [None, "", "short", "a" * 5000, "a" * 399, "a" * 400, "ab" * 900, "b" + "ab" * 700, prose(3000)]
    for _ in range(60):
        parts = [prose(rng.randint(0, 120)) for _ in range(rng.randint(1, 3))]
        parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        texts.append(rng.choice(["", " ", "x"]).join(parts))
    whole = prose(500)
    texts += [whole, whole, whole[3:], whole[:1200] + "!" + whole[1200:], whole[:700] + whole[720:]]
    return texts


def test_equals_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes long")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in remove_repeats(docs.repartition(5)).collect()}
    expected = brute(texts, 400)
    assert [got[i] for i in range(len(texts))] == expected
    assert sum(r[1] > 0 for r in expected) > 50


def test_short_strings_and_repeated_rows(spark):
    rows = [(None, "0123456789" * 3), (None, "0123456789" * 3), (1, None), (2, "é" * 40), (3, "xyz" + "é" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r[:5]) for r in remove_repeats(docs, length=64 + 4).collect()), key=repr)
    expected = sorted(((k, *b) for (k, _), b in zip(rows, brute([t for _, t in rows], 68))), key=repr)
    assert got == expected


def test_many_repeated_rows_beside_a_partly_equal_text(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    whole = prose(400)
    rows = [(1, whole)] * 200 + [(None, whole[:1500])] * 90 + [(2, whole[700:1300] + prose(90)), (3, prose(90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r[:5]) for r in remove_repeats(docs).collect()), key=repr)
    assert got == sorted(((k, *b) for (k, _), b in zip(rows, brute([t for _, t in rows], 400))), key=repr)


def brute_with_words(texts, length, words):
    """Texts without bytes of repeated windows of either kind."""
    bodies = [(t or "").encode() for t in texts]
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in bodies]
    tokens = [b.split() for b in bodies]
    seen = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    met = Counter(tuple(t[i:i + words]) for t in tokens for i in range(len(t) - words + 1))
    out = []
    for b, at, t in zip(bodies, places, tokens):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        for i in range(len(t) - words + 1):
            if met[tuple(t[i:i + words])] > 1:
                lo, hi = at[i][0], at[i + words - 1][1]
                gone[lo:hi] = b"\1" * (hi - lo)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_passages_of_words_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (49, 50, 51, 52, 58, 75, 130)]
    texts = [*corpus(), "a " * 50, "a " * 400, "a b " * 30, passages[2], passages[6].replace(" ", "\n\t ")]
    for _ in range(60):
        texts.append(prose(rng.randint(0, 60)) + rng.choice([" ", "  ", "\n", "x"])
                     + rng.choice(passages) + rng.choice(["", " ", "\n"]) + prose(rng.randint(0, 60)))
    texts += [passages[5][10:] + " " + passages[4], texts[-1], texts[-1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in remove_repeats(docs, words=51).collect()}
    expected = brute_with_words(texts, 400, 51)
    assert [got[i] for i in range(len(texts))] == expected
    assert sum(a[0] > b[1] for a, b in zip(expected, brute(texts, 400))) > 30


def test_passages_go_from_a_text_of_their_own(spark):
    """A repeated passage of 51 short words has fewer than 400 bytes: the digests keep it, ``text`` does not."""
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    passage, long = prose(51), prose(120)
    texts = [f"{prose(30)}\n{passage}\n{prose(9)}", f"{prose(8)}\n{passage}\n{prose(30)}", prose(70), None,
             f"{prose(20)} {long}", f"{prose(6)} {long} {prose(40)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {r.doc_id: tuple(r) for r in remove_repeats(docs).collect()}
    both = {r.doc_id: tuple(r) for r in remove_repeats(docs, passages=51).collect()}
    assert {i: r[:-1] for i, r in both.items()} == plain
    in_full = {r.doc_id: r.kept_text for r in remove_repeats(docs, words=51).collect()}
    assert {i: r[-1] for i, r in both.items()} == in_full
    assert [plain[i][-1] for i in range(4)] == texts[:4]
    assert both[0][-1] == texts[0].replace(passage, "") and both[1][-1] == texts[1].replace(passage, "")
    assert both[2][-1] == texts[2] and both[3][-1] is None and long not in both[4][-1] + both[5][-1]


def test_kept_text_is_whole_characters(spark):
    same = "é" * 300
    docs = spark.createDataFrame([(1, "à" + same + "z"), (2, "è" + same + "à"), (3, "q")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in remove_repeats(docs).collect()}
    assert got == {1: "àz", 2: "èà", 3: "q"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, __text string")
    assert remove_repeats(docs).count() == 0


def test_blocks_find_the_same_anchors():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 9000).astype(np.uint8)
    ends = np.array([0, 500, 500, 2600, 2700, 9000])

    def windows(most):
        return [(i, a) for lo, hi, a in zip(*anchored_runs(data, ends, 400, 64, most)) for i in range(lo, hi + 1)]

    whole = windows(10 ** 6)
    assert len(whole) == 500 - 399 + 2100 - 399 + 6300 - 399
    assert all(windows(most) == whole for most in (1, 700, 2200, 8999))
