"""Shards by bytes: contiguous, gapless, near equal; hot and odd rows."""

import zlib

from muster.llm.shards import shard_by_bytes


def test_law(spark):
    rows = [(None, "x" * (k % 50)) for k in range(400)] + [(k, None if k % 9 == 0 else "é" * (k % 40)) for k in range(300)]
    rows += [(7, "same")] * 50
    docs = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, shard string").repartition(7)
    got = shard_by_bytes(docs, 8).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
    want = sorted((repr(k), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == want
    total = sum(r.size for r in got)
    before, last = 0, -1
    for s in range(8):
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        keys = [-1 if r.doc_id is None else r.doc_id for r in own]
        assert keys == sorted(keys) and keys[0] >= last  # contiguous in id order
        last = keys[-1]
        for r in own:
            assert r.shard == min(7, (2 * before + r.size) * 8 // (2 * total))
            before += r.size
        assert abs(sum(r.size for r in own) - total / 8) <= 150


def test_same_result_in_other_layout(spark):
    docs = spark.createDataFrame([(k, "t" * (k * 37 % 91)) for k in range(500)], "doc_id long, text string")
    first = shard_by_bytes(docs.repartition(3), 40).collect()
    second = shard_by_bytes(docs.repartition(11, "text"), 40).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, second))


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert tuple(shard_by_bytes(docs, 40).first())[:3] == (1, 16, 0)
    assert shard_by_bytes(docs.limit(0), 40).count() == 0
