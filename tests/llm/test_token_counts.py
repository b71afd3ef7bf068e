import random

import public_tokenizers
from odd import ODD, no_documents, odd_documents

from termscale.llm.pretokens import PieceCache, lengths, packed_ids, tokenizer_at
from termscale.llm.queries import op1_token_counts
from termscale.llm.token_counts import frequent_words, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(text):
    return tokenizer_at(PATH).encode(text or "", add_special_tokens=False).ids


def test_pieces_equal_the_library():
    draw = random.Random(1)
    letters = [chr(c) for c in range(0x180)] + list("–’—€…'st rem\n") * 6
    small, cache = PieceCache(PATH, packed_ids, limit=50), PieceCache(PATH, lengths)
    taken = 0
    for _ in range(4000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 14)))
        found = small.values(text)
        if found is not None:
            taken += 1
            ids = library(text)
            assert b"".join(found) == b"".join(i.to_bytes(2, "little") for i in ids)
            assert sum(cache.values(text)) == len(ids)
    assert taken > 3000


def test_table(spark):
    rows = op1_token_counts(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for row in rows:
        n = len(library(texts[row.doc_id]))
        assert row[1:] == (len(texts[row.doc_id].encode()), n, n > 2048)


def test_odd_rows(spark):
    rows = token_counts(odd_documents(spark), PATH, limit=5).collect()
    expected = [(i, len((t or "").encode()), len(library(t)), len(library(t)) > 5) for i, t in ODD]
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    assert token_counts(no_documents(spark), PATH).count() == 0


def test_frequent_words_cover_all_texts(spark):
    texts = spark.range(400).selectExpr("concat('common word', id % 3, ' rare', id) AS text").repartition(7)
    assert set(frequent_words(texts, size=2, tracked=1024)) <= {"common", "word", "rare"}
