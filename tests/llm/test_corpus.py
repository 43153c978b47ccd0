"""Every corpus query against its SQL, and the whole pipeline against plain Python."""

import hashlib
import os
import random
import struct

import duckdb
import pytest
from conftest import DATA
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from muster.llm.oracles import LLM_ORACLES
from muster.llm.queries import LLM_QUERIES, PIECE_MODEL

from . import test_benchmark, test_quality_rules, test_repeats, test_simhash


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(DATA):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{DATA}/{table}'")
    df = LLM_QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(f"SELECT {', '.join(columns)} FROM ({LLM_ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(found, key=repr)


def test_ten_operators_are_registered():
    assert [int(n[2:].split("_")[0]) for n in LLM_QUERIES] == list(range(1, 11))


def test_pipeline_equals_plain_python(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghéß") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(30)) for k in range(4)]
    passage = prose(90)
    texts = [None, "", "few words", "spam!! spam!! spam!! " * 8] + [prose(rng.randint(20, 300)) for _ in range(25)]
    texts += [texts[8], texts[8], texts[9] + " end", texts[10].upper()]
    texts += [prose(30) + " " + passage + " " + prose(40) for _ in range(5)]
    texts += [prose(20) + " " + items[k][1] + " " + prose(20) for k in range(4)] + [prose(900) + " " + items[0][1][:140]]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(k, t) for k, t, *_ in rows if test_quality_rules.slow(t)[-1]]
    groups = test_simhash.slow_components([(k, test_simhash.slow_fingerprint(t)) for k, t in kept])
    kept = [(k, t) for (k, t), leader in zip(kept, groups) if k == leader]
    bodies = [t.encode() for _, t in kept]
    seen = {}
    for b in bodies:
        for i in range(len(b) - 399):
            seen[b[i:i + 400]] = seen.get(b[i:i + 400], 0) + 1
    cut = []
    for (k, t), b in zip(kept, bodies):
        gone = {i + j for i in range(len(b) - 399) if seen[b[i:i + 400]] > 1 for j in range(400)}
        rest, at = "", 0
        for c in t:
            size = len(c.encode())
            rest += "" if all(i in gone for i in range(at, at + size)) else c
            at += size
        cut.append((k, rest))
    assert sum(len(a[1]) != len(b[1]) for a, b in zip(kept, cut)) >= 5
    clean = [(k, t) for k, t in cut if not test_benchmark.slow(t, items)[-1]]
    assert len(clean) == len(cut) - 4
    library = SentencePieceProcessor(model_file=PIECE_MODEL)
    expected = []
    for k, t in clean:
        ids = library.encode(t, add_bos=True, add_eos=True)
        expected.append((k, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                         hashlib.sha256(t.encode()).hexdigest(), ids))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids").collect())) == expected


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, "Some words of a document that is long enough to stay in.", "en", "s", 9)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_short_passage_of_51_words_goes(spark):
    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    passage = prose(51)
    first, second = (prose(40), prose(30)), (prose(25), prose(60))
    assert len(passage) < 300
    rows = [(k, f"{a} {passage} {b}", "en", "s", 1) for k, (a, b) in enumerate([first, second])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, docs, DATA).collect()}
    assert got == {0: "  ".join(first), 1: "  ".join(second)}
