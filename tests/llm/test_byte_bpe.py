import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from odd import ODD, no_documents, odd_documents

from termscale.llm.byte_bpe import Encoder, decode_ids, encode_texts, vocabulary_at
from termscale.llm.perfect_hash import PerfectHash
from termscale.llm.queries import op11_byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library(path=PATH):
    vocabulary = vocabulary_at(path)
    ranks = dict(zip(vocabulary.tokens, vocabulary.ids.tolist(), strict=True))
    return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def unpacked(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


def test_every_key_has_a_slot_of_its_own():
    for keys in (vocabulary_at(PATH).tokens, [b""], [b"a", b"b"], []):
        made = PerfectHash(keys)
        assert made.find(list(keys)).tolist() == list(range(len(keys)))
        assert sorted(made.key_at.tolist()) == list(range(len(keys)))
    assert PerfectHash([b"a", b"b", b"c"]).find([b"d", b"", b"c"]).tolist() == [-1, -1, 2]


@pytest.mark.parametrize("path", [PATH, MULTI])
def test_ids_equal_the_library(path):
    draw = random.Random(3)
    letters = list("etaoin shrdlu'stre  \n\t0123.,!?<|>") + [chr(draw.randrange(0x80, 0x3000)) for _ in range(60)] + ["😀", "漢"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 700, "ab" * 5000, " " * 3000, "é" * 999, "<|endoftext|>", "\u0085  x", "\x1c \x1fy"]
    same = library(path)
    assert [unpacked(ids) for ids in Encoder(path, PATTERN).encode(texts)] == [same.encode_ordinary(t) for t in texts]


def test_merges_of_a_very_long_word():
    text = "xq" * 250_000 + "z"
    ids = vocabulary_at(PATH).merged(text.encode())
    assert b"".join(vocabulary_at(PATH).bytes_of[i].as_py() for i in set(ids)) and len(ids) == len(library().encode_ordinary(text))


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr("termscale.llm.byte_bpe.REMEMBERED", 3)
    encoder, same = Encoder(PATH, PATTERN), library()
    for i in range(20):
        text = f"qxz{'wq' * i} unheardof{i}zz"
        assert unpacked(encoder.encode([text])[0]) == same.encode_ordinary(text)
        assert len(encoder.remembered) <= 3


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_table(spark):
    rows = op11_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    same = library()
    for row in rows:
        ids = same.encode_ordinary(texts[row.doc_id])
        expected = (len(ids), digest(" ".join(map(str, ids)).encode()), digest(texts[row.doc_id].encode()))
        assert row[1:] == expected


def test_odd_rows(spark):
    same = library()
    encoded = encode_texts(odd_documents(spark), PATH, PATTERN)
    rows = decode_ids(encoded, PATH).collect()
    found = sorted([(r.doc_id, r.ids, bytes(r.data)) for r in rows], key=str)
    assert found == sorted([(i, same.encode_ordinary(t or ""), (t or "").encode()) for i, t in ODD], key=str)
    assert encode_texts(no_documents(spark), PATH, PATTERN).count() == 0


def test_ids_that_cannot_be_decoded(spark):
    rows = [(1, [64, 65]), (2, None), (3, [64, None]), (4, [50256]), (5, [-1]), (6, []), (7, [70])]
    made = decode_ids(spark.createDataFrame(rows, "doc_id int, ids array<int>").coalesce(1), PATH).collect()
    token = vocabulary_at(PATH).bytes_of
    whole = {1: token[64].as_py() + token[65].as_py(), 6: b"", 7: token[70].as_py()}
    assert {r.doc_id: r.data and bytes(r.data) if r.data else r.data for r in made} == {
        i: whole.get(i, None) for i in range(1, 8)
    }
