"""Encoding and decoding against the sentencepiece library."""

import codecs
import hashlib
import random
import struct

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from muster.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    codecs.register_error("bytewise", pieces._bytewise)
    return pieces.PieceModel(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def samples():
    rng = random.Random(1)
    found = ["", " ", "\n", "\x00", "<s></s><0x0A>", "▁", "a▁b", "漢字かな交じり文", "x" * 3000, " " * 700, "aab" * 900]
    found += [" " * n + t for n in range(40) for t in ("", "t", "é", "漢")]
    for letters in ("ab", "aeth ", "inthe ▁", "aàéß漢字の\n\t \x00", "   t", "العربية हिन्दी ", "😀👨‍👩‍👧 aﬁÅ"):
        found += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    return found


def test_encoding_and_decoding_equal_the_library(model, library):
    for text in samples():
        ids = library.encode(text, add_bos=True, add_eos=True)
        packed = model.encode(text)
        assert packed == struct.pack(f"<{len(ids)}I", *ids), repr(text)
        assert model.decode(packed) == library.decode(ids), repr(text)


def test_random_pieces_and_ids(model, library):
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(model.pieces[rng.randrange(259, 32000)].replace("▁", rng.choice([" ", ""]))
                       for _ in range(rng.randint(1, 8)))
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert model.encode(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)
        broken = [rng.randrange(32000) if rng.random() < 0.3 else rng.randrange(3, 259) for _ in range(9)]
        assert model.decode(struct.pack("<9I", *broken)) == library.decode(broken)


def test_border_check_is_re_merging(model):
    rng = random.Random(3)
    for _ in range(5000):
        a, b = (model.pieces[rng.randrange(259, n)] for n in (rng.choice([900, 32000]), 32000))
        assert model.fits(a, b) == (model.merged(a + b) == [a, b])


def test_forgetting_changes_nothing(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "_REMEMBERED", 3)
    text = "some words, some other words and some more of these words " * 3
    ids = library.encode(text, add_bos=True, add_eos=True)
    assert model.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_rows(spark, library):
    rows = [(1, None, 7), (None, "a  b\n", 8), (2, "", 9), (2, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = pieces.tokenize(docs, PATH)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    got = {(r.doc_id, r.n_tokens, r.decoded, tuple(r.ids), r.ids_sha256, r.decoded_sha256) for r in found.collect()}
    expected = set()
    for key, text, _ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        expected.add((key, len(ids), text or "", tuple(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                      hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == expected and found.count() == 4
    assert pieces.tokenize(docs.limit(0), PATH).count() == 0
