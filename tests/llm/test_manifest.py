import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from muster.llm import manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(nodes, at, value):
    """Root of ``nodes``, root with ``value`` at place ``at``, siblings on the way."""
    nodes, changed, siblings = list(nodes), value, []
    while len(nodes) > 1:
        low = at // 16 * 16
        run = nodes[low:low + 16]
        siblings += run[:at - low] + run[at - low + 1:]
        changed = sha(*run[:at - low], changed, *run[at - low + 1:])
        nodes = [sha(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
        at //= 16
    return nodes[0], changed, siblings


def plain(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {}
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        leaves[s] = [plain_leaf(r) for r in sources[s]]
    subroots = [climb(leaves[s], 0, "")[0] for s in order]
    root = climb(subroots, 0, "")[0]
    out = []
    for k, s in enumerate(order):
        for i, row in enumerate(sources[s]):
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            value = plain_leaf((*row[:4], lowered(row[4]))) if bad else leaves[s][i]
            _, changed, below = climb(leaves[s], i, value)
            _, folded, above = climb(subroots, k, changed)
            out.append((row[0], leaves[s][i], subroots[k], root, sha(*below, *above), folded, folded == root))
    return out


def result(spark, rows):
    found = manifest.manifest(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in found.collect()]


def marked(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def test_trees_of_several_depths_equal_plain_hashing(spark):
    rows = []
    for source, n in [("a", 1), ("b", 2), ("c", 16), ("d", 17), ("e", 257), (None, 33), ("", 3), ("Ä", 1)]:
        rows += [(len(rows) + i, source, "en", i, f"Text {i} OF Ünits") for i in range(n)]
    rows += [(10_000 + i, f"s{i:02}", None, None, None) for i in range(20)]
    found = result(spark, rows)
    assert marked(found) == marked(plain(rows))
    assert {r[-1] for r in found} == {True, False}


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "a", "en", 3, "ABC"), (5, "a", "en", 0, ""), (5, "a", "de", 0, ""),
            (7, "a", "en", 4, "x:ÄB"), (7, "a", "en", 4, "x:ÄB"), (9, "a", "en", 10, "Q" * 300_000)]
    assert marked(result(spark, rows)) == marked(plain(rows))
    # An id of which nothing can be lowered verifies even where tampering was due.
    quiet = [(i, "a", "en", 1, "x") for i in range(40)]
    assert all(r[-1] for r in result(spark, quiet))


def test_no_rows_and_clashing_columns(spark):
    assert result(spark, []) == []
    rows = [(i, "ab"[i % 2], "en", i, f"T{i}") for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    more = frame.withColumns({c: F.lit("?") for c in ("id", "tree", "place", "digest", "rows", "path", "number", "leaf")})
    assert marked(map(tuple, manifest.manifest(more).collect())) == marked(plain(rows))


@pytest.mark.parametrize("size", [1, 5, 16])
def test_a_resumed_state_gives_the_digest_of_the_changed_run(size):
    nodes = [sha(str(i)) for i in range(size)]
    run = manifest.Run(nodes)
    assert run.digest == sha(*nodes)
    for slot in range(size):
        assert run.fold(slot, sha("new")) == sha(*nodes[:slot], sha("new"), *nodes[slot + 1:])
