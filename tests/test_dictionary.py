"""Ids that last over batches, and the matrix with them."""

from registry import queries as Q
from test_ranking import brute_force, corpus

import pytest

from termscale.operators import matrix as M
from termscale.operators.dictionary import Dictionary
from termscale.plans import ranking as P
from termscale.sources.commits import Folder

FIRST, SECOND = ["zip pow zip", "bang zap", ""], ["kapow zap", "zip gleam", None, "pow kapow"]


def ids_of(dictionary):
    rows = dictionary.read().collect()
    assert len({r.term for r in rows}) == len({r.term_id for r in rows}) == len(rows)
    return {r.term: r.term_id for r in rows}


def test_two_batches_keep_ids(spark, tmp_path):
    dictionary = Dictionary(spark, f"{tmp_path}/terms")
    assert ids_of(dictionary) == {} and dictionary.size() == 0
    first = P.build_index(corpus(spark, FIRST))
    assert dictionary.extend(first, "first") == 4
    before = ids_of(dictionary)
    assert before == {"zip": 0, "pow": 1, "bang": 2, "zap": 3}
    second = P.build_index(corpus(spark, SECOND, range(10, 14)))
    assert dictionary.extend(second, "second") == 2 and dictionary.extend(second, "second") == 0
    after = ids_of(dictionary)
    assert before.items() <= after.items() and after["kapow"] == 4 and after["gleam"] == 5 and dictionary.size() == 6
    assert dictionary.extend(first, "again") == 0 and ids_of(dictionary) == after

    whole = P.build_index(corpus(spark, FIRST + SECOND, [1, 2, 3, 10, 11, 12, 13]))
    names = {i: t for t, i in after.items()}
    cells = {(r.doc_id, names[r.term_id]): r.weight for r in M.document_term_matrix(whole, ids=dictionary.read()).collect()}
    weights = brute_force([(t or "").split() for t in FIRST + SECOND])
    expected = {(d, t): w for d, row in zip([1, 2, 3, 10, 11, 12, 13], weights) for t, w in row.items()}
    assert cells == {at: pytest.approx(w, abs=1e-12) for at, w in expected.items()}


def test_two_writers_do_not_share_ids(spark, tmp_path, monkeypatch):
    one, other = Dictionary(spark, f"{tmp_path}/terms"), Dictionary(spark, f"{tmp_path}/terms")
    first, second = P.build_index(corpus(spark, FIRST)), P.build_index(corpus(spark, SECOND))
    commit = Folder.commit

    def late(self, change):
        monkeypatch.setattr(Folder, "commit", commit)
        other.extend(second, "other")
        return commit(self, change)

    monkeypatch.setattr(Folder, "commit", late)
    one.extend(first, "one")
    assert sorted(ids_of(one).values()) == list(range(6))
    assert {e["job"] for e in one.folder.entries()} == {"one", "other"}


def test_no_terms(spark, tmp_path):
    dictionary = Dictionary(spark, f"{tmp_path}/terms")
    assert dictionary.extend(P.build_index(corpus(spark, ["", None])), "none") == 0
    assert ids_of(dictionary) == {} and dictionary.extend(P.build_index(corpus(spark, FIRST)), "some") == 4


def test_batches_of_the_query_share_one_index(spark, monkeypatch):
    made = []
    monkeypatch.setattr(P, "build_index", lambda *args, build=P.build_index: made.append(args) or build(*args))
    Q.vocabulary_batches(spark, "/root/testdata/sf0.001")
    assert len(made) == 1
