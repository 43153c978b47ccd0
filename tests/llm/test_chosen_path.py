import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from muster.llm import chosen_path

SCHEMA = "doc_id long, text string"


def plain_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 4:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k:k + 4]) for k in range(len(words) - 3))


def plain(rows):
    """{doc_id: (size, least reachable id)} and the linked pairs, by comparing all with all."""
    sets = {i: plain_set(t) for i, t in rows}
    leader = {i: i for i in sets}

    def find(i):
        while leader[i] != i:
            i = leader[i]
        return i

    pairs = [(a, b) for a, b in combinations(sorted(sets), 2)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for a, b in pairs:
        a, b = find(a), find(b)
        leader[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}, pairs


def result(spark, rows, **options):
    found = chosen_path.near_duplicates(spark.createDataFrame(rows, SCHEMA), **options)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return found.collect()


def words(draw, n, vocabulary=4000):
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def test_recall_against_brute_force(spark):
    """Pairs a little above the least similarity, of which a miss is likeliest."""
    draw, rows = random.Random(3), []
    for _ in range(120):
        text = words(draw, 203)
        near = list(text)
        for at in draw.sample(range(0, 200, 5), 5):  # each changed word spoils up to 4 shingles
            near[at] = "new"
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(near).upper())]
    expected, pairs = plain(rows)
    assert len(pairs) >= 100
    found = {r["doc_id"]: r for r in result(spark, rows)}
    assert all(found[i]["n_shingles"] == n for i, (n, _) in expected.items())
    joined = sum(found[a]["component_id"] == found[b]["component_id"] for a, b in pairs)
    assert joined >= 0.99 * len(pairs)
    # Nothing is linked that full sets do not link.
    assert all(expected[i][1] == expected[found[i]["component_id"]][1] for i in expected)


def test_a_large_group_around_a_centre(spark, monkeypatch):
    """Copies like their origin but not each other: only the centre ties them together."""
    monkeypatch.setattr(chosen_path, "SMALL", 8)
    draw = random.Random(8)
    origin, rows = words(draw, 203), []
    for i in range(150):
        text = list(origin)
        for at in draw.sample(range(0, 200, 5), 4):
            text[at] = f"n{i}"
        rows.append((i + 1, " ".join(text)))
    rows.append((500, " ".join(origin)))
    rows += [(600 + i, " ".join(origin[:60] + words(draw, 200))) for i in range(60)]  # share a passage, no links
    expected, _ = plain(rows)
    assert sum(leader == 1 for _, leader in expected.values()) == 151
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in result(spark, rows)}
    assert found == expected


def test_deeper_levels_part_what_is_not_alike(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "SMALL", 3)
    draw, rows = random.Random(5), []
    shared = words(draw, 150)
    for i in range(40):
        text = shared + words(draw, 60)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text + ["more", "words"]))]
    expected, _ = plain(rows)
    assert len({leader for _, leader in expected.values()}) == 40
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in result(spark, rows, trees=8)} == expected


def test_odd_rows(spark):
    long_text = " ".join(words(random.Random(1), 60_000, 50_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (9, "ONE\ttwo"), (5, "one two three"), (6, "a b c d"),
            (None, "a b  c D"), (7, "a b c d"), (7, "a b c d"), (None, None), (None, "only here now yes"),
            (20, long_text), (21, long_text + " end")]
    found = sorted((tuple(r) for r in result(spark, rows)), key=str)
    n = len(plain_set(long_text))
    assert found == sorted([
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (9, 1, 4, False), (5, 1, 5, True),
        (6, 1, 6, True), (None, 1, 6, False), (7, 1, 6, False), (7, 1, 6, False), (None, 0, None, True),
        (None, 1, None, True), (20, n, 20, True), (21, n + 1, 20, False)], key=str)


def test_no_rows_clashing_columns_and_hot_copies(spark):
    assert result(spark, []) == []
    rows = [(i, "the same text of five words" if i % 3 else f"text number {i} is alone here") for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA)
    clash = {c: F.lit("?") for c in ("id", "n", "uid", "__text", "__doc", "key_a", "node", "component", "set_a")}
    found = chosen_path.near_duplicates(frame.withColumns(clash)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: leader for i, (_, leader) in plain(rows)[0].items()}


def test_tokens_agree_as_often_as_sets_are_alike():
    draw = random.Random(4)
    shared, left, right = (words(draw, n, 10 ** 9) for n in (2000, 250, 250))
    a, b = (chosen_path.shingle_set(" ".join(shared + w)) for w in (left, right))
    assert abs(np.mean(chosen_path.tokens(a) == chosen_path.tokens(b)) - 0.8) < 0.2


def test_unrelated_sets_of_one_node_are_no_candidates(spark):
    """Their number grows with the square of the node; pairs to be linked stay candidates."""
    draw, rows = random.Random(6), []
    for _ in range(300):
        text = words(draw, 203)
        near = list(text)
        for at in draw.sample(range(0, 200, 5), 5):
            near[at] = "new"
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(near))]
    linked = sum(len(a & b) * 100 >= 80 * len(a | b) for a, b in zip(*[iter([plain_set(t) for _, t in rows])] * 2))
    docs = spark.createDataFrame(rows, "__doc long, __text string")
    marked = docs.mapInArrow(chosen_path._mark, f"__doc long, {chosen_path._MARKED}")
    node = chosen_path.cut_lineage(marked.withColumnsRenamed({"__doc": "uid"}).withColumn("component", F.col("uid")))
    left, right = node.alias("l"), node.alias("r")
    found = left.join(right, F.col("l.uid") < F.col("r.uid")).where(chosen_path._similar("l", "r"))
    pairs = [tuple(p) for p in found.select("l.uid", "r.uid").collect()]
    assert all(a % 2 == 0 and b == a + 1 for a, b in pairs)
    assert linked > 200 and len(pairs) >= linked


def test_members_a_little_too_different_are_no_candidates(spark):
    """Of a group of near copies most pairs may be of similarities from 0.5 to 0.75: their number grows with the square."""
    draw, texts = random.Random(15), []
    origin = words(draw, 153)
    for i in range(120):
        text = list(origin)
        for at in draw.sample(range(0, 150, 5), 6):
            text[at] = f"n{i}"
        texts.append((i, " ".join(text)))
    rows = texts + [(200, " ".join(origin)), (201, " ".join(origin[:-3]))]
    sets = {i: plain_set(t) for i, t in rows}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2)}
    linked = {p for p, j in alike.items() if j >= 0.8}
    docs = spark.createDataFrame(rows, "__doc long, __text string")
    marked = docs.mapInArrow(chosen_path._mark, f"__doc long, {chosen_path._MARKED}")
    node = chosen_path.cut_lineage(marked.withColumnsRenamed({"__doc": "uid"}).withColumn("component", F.col("uid")))
    found = node.alias("l").join(node.alias("r"), F.col("l.uid") < F.col("r.uid")).where(chosen_path._similar("l", "r"))
    pairs = {tuple(p) for p in found.select("l.uid", "r.uid").collect()}
    assert linked <= pairs and linked
    assert sum(0.5 < j < 0.75 for j in alike.values()) > 5000
    assert sum(alike[p] < 0.7 for p in pairs) < 30
