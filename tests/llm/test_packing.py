import zlib

import numpy as np
import public_tokenizers
from odd import ODD, no_documents, odd_documents

from termscale.llm.packing import hilbert_key, pack
from termscale.llm.pretokens import tokenizer_at
from termscale.llm.queries import op8_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return np.array([*tokenizer_at(PATH).encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(rows, documents, capacity):
    by_doc, by_sequence = {}, {}
    for row in rows:
        by_doc.setdefault(row.doc_id, []).append(row)
        by_sequence.setdefault(row.sequence_id, []).append(row)
    assert by_doc.keys() == documents.keys()
    for doc_id, pieces in by_doc.items():
        ids, at = ids_of(documents[doc_id]), 0
        for piece in sorted(pieces, key=lambda p: p.start):
            assert (piece.start, piece.doc_tokens) == (at, len(ids)) and piece.length > 0
            assert piece.ids_crc32 == zlib.crc32(ids[at : at + piece.length].tobytes())
            at += piece.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    sizes = []
    for number in sorted(by_sequence):
        at = 0
        for piece in sorted(by_sequence[number], key=lambda p: p.offset):
            assert piece.offset == at
            at += piece.length
        sizes.append(at)
    assert all(size == capacity for size in sizes[:-1]) and 0 < sizes[-1] <= capacity


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = op8_packing(spark, "/root/testdata/sf0.001").collect()
    check(rows, {r.doc_id: r.text for r in docs}, 2048)


def test_odd_rows(spark):
    rows = pack(odd_documents(spark), PATH, capacity=64).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) for _, t in ODD)
    own = {i: t for i, t in ODD if i not in (None, 2)}
    with_one = [(i, t) for i, t in ODD if i in own]
    check(pack(odd_documents(spark, with_one), PATH, capacity=64).collect(), own, 64)
    assert pack(no_documents(spark), PATH).count() == 0


def test_hilbert_neighbours():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    keys = hilbert_key(points, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
