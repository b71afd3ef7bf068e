"""Segments against the index of all documents at once; commits with writers that fail or are late."""

import random

import pytest

from pyspark.sql import functions as F

from termscale.operators import index as I
from termscale.operators import ranking as R
from termscale.operators.segments import SegmentedIndex
from termscale.plans import ranking as P
from termscale.sources.commits import Folder
from termscale.sources.local import query_table

COLUMNS = ["doc_id", "term", "tf", "first_pos", "doc_len", "max_tf"]


def batch(spark, seed, ids):
    draw = random.Random(seed)
    words = ["zip", "pow", "bang", "kapow", "the", "cities", f"only{'abc'[seed % 3]}"]
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 9)))) for i in ids]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def same(stored, docs):
    whole = I.index_rows(docs)
    assert sorted(map(str, stored.read().select(COLUMNS).collect())) == sorted(map(str, whole.select(COLUMNS).collect()))
    ids = stored.read().filter("term is null").select("rec_id")
    assert ids.distinct().count() == ids.count()
    assert sorted(map(tuple, stored.document_frequency().collect())) == sorted(map(tuple, I.document_frequency(whole).collect()))
    assert tuple(stored.statistics().first()) == tuple(I.corpus_stats(whole).first())
    queries = query_table(docs.sparkSession, [["zip", "pow"], ["bang"], ["onlya"]])
    ranks = [
        sorted(str((r.query_id, r.doc_id, round(r.score, 9))) for r in R.top_documents(P.query_part(x, queries), queries, 500).collect())
        for x in (stored.read(), whole)
    ]
    assert ranks[0] == ranks[1]


def test_batches_are_the_whole(spark, tmp_path):
    stored = SegmentedIndex(spark, f"{tmp_path}/index")
    a, b, c = batch(spark, 1, range(40)), batch(spark, 2, [*range(30, 60), None, None]), batch(spark, 3, [5, 6, 100])
    assert stored.append(a, "a") and stored.append(b, "b")
    same(stored, a.union(b))
    # A retried job adds nothing.
    assert not stored.append(c, "b") and len(stored.folder.entries()) == 2
    same(stored, a.union(b))

    assert stored.delete(spark.createDataFrame([(5,), (35,), (35,), (999,), (None,)], "doc_id long"), "d")
    assert not stored.delete(spark.createDataFrame([(6,)], "doc_id long"), "d")
    left = a.union(b).filter("doc_id is null or doc_id not in (5, 35)")
    same(stored, left)
    # An id that comes again after its deletion counts.
    assert stored.append(c, "c")
    same(stored, left.union(c))

    assert stored.compact("all") and len(stored.folder.entries()) == 1
    same(stored, left.union(c))
    assert not stored.append(a, "a") and not stored.append(c, "c")
    assert stored.append(batch(spark, 4, range(200, 210)), "e")
    same(stored, left.union(c).union(batch(spark, 4, range(200, 210))))
    assert stored.folder.drop_unlisted() == 4
    same(stored, left.union(c).union(batch(spark, 4, range(200, 210))))


def test_a_batch_that_comes_while_others_are_compacted(spark, tmp_path, monkeypatch):
    stored = SegmentedIndex(spark, f"{tmp_path}/index")
    a, b = batch(spark, 1, range(20)), batch(spark, 2, range(20, 30))
    stored.append(a, "a")
    written = SegmentedIndex._add

    def late(self, name, job, replaced=()):
        monkeypatch.setattr(SegmentedIndex, "_add", written)
        SegmentedIndex(spark, f"{tmp_path}/index").append(b, "b")
        return written(self, name, job, replaced)

    monkeypatch.setattr(SegmentedIndex, "_add", late)
    assert stored.compact("all")
    assert sorted(e["job"] for e in stored.folder.entries()) == ["all", "b"]
    same(stored, a.union(b))


def test_a_failing_write_leaves_nothing(spark, tmp_path):
    stored = SegmentedIndex(spark, f"{tmp_path}/index")
    a = batch(spark, 1, range(20))
    stored.append(a, "a")
    broken = batch(spark, 2, range(5)).withColumn("text", F.expr("raise_error('broken')").cast("string"))
    with pytest.raises(Exception, match="broken"):
        stored.append(broken, "b")
    same(stored, a)
    assert stored.append(batch(spark, 2, range(50, 55)), "b")


def test_writers_at_the_same_time(spark, tmp_path):
    first, second = Folder(spark, f"{tmp_path}/x"), Folder(spark, f"{tmp_path}/x")
    calls = []

    def slow(entries):
        calls.append(len(entries))
        if len(calls) == 1:
            second.commit(lambda known: [*known, {"job": "fast", "folder": "f"}])
        return [*entries, {"job": "slow", "folder": "s"}]

    assert [e["job"] for e in first.commit(slow)] == ["fast", "slow"] and calls == [0, 1]
    assert first.versions() == [1, 2] and second.has("slow") and not second.has("other")


def test_empty_segments(spark, tmp_path):
    stored = SegmentedIndex(spark, f"{tmp_path}/index")
    with pytest.raises(ValueError):
        stored.read()
    assert not stored.compact("x")
    none = batch(spark, 1, range(3)).limit(0)
    assert stored.append(none, "none")
    assert stored.read().count() == 0 and tuple(stored.statistics().first()) == (0, 0, None)
    a = batch(spark, 1, range(9))
    stored.append(a, "a")
    same(stored, a)
