import hashlib
import re
import uuid

import pytest
from compare import connection, spark_rows, sql_rows
from odd import ODD, no_documents, odd_documents

from termscale.llm.exact_dedup import DigestIndex, deduplicate, first_copies
from termscale.llm.queries import EXACT_DEDUP, op5_exact_dedup


@pytest.fixture
def index(spark):
    made = DigestIndex(spark, f"index_{uuid.uuid4().hex}", 3)
    yield made
    spark.sql(f"DROP TABLE IF EXISTS {made.table}")


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert spark_rows(op5_exact_dedup(spark, sf_dir)) == sql_rows(connection(sf_dir), EXACT_DEDUP)


def test_odd_rows(spark, index):
    found = deduplicate(odd_documents(spark), index).collect()
    expected = []
    for doc_id, text in ODD:
        same = [i for i, other in ODD if normal(other) == normal(text)]
        keep = min((i for i in same if i is not None), default=None)
        digest = hashlib.sha256(normal(text).encode()).hexdigest()
        expected.append((doc_id, keep, len(same), doc_id == keep, digest))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    kept = first_copies(odd_documents(spark), DigestIndex(spark, index.table + "_2", 3))
    assert kept.columns == odd_documents(spark).columns
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id), key=str) == [1, 3, 5, 6, 7, 8, 9]
    spark.sql(f"DROP TABLE {index.table}_2")


def test_first_copies_tells_rows_of_one_id_apart(spark, index):
    rows = [(None, "kept"), (None, "copy"), (1, "copy"), (2, "other"), (3, "own"), (3, "other")]
    kept = first_copies(spark.createDataFrame(rows, "doc_id long, text string"), index).collect()
    expected = [(1, "copy"), (2, "other"), (3, "own"), (None, "kept")]
    assert sorted(map(tuple, kept), key=str) == sorted(expected, key=str)


def test_second_batch_meets_the_index(spark, index):
    first = spark.createDataFrame([(5, "a  b"), (6, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "a\tb"), (2, "d"), (3, "d ")], "doc_id long, text string")
    deduplicate(first, index).collect()
    rows = {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in deduplicate(second, index).collect()}
    assert rows == {1: (5, False, 1), 2: (2, True, 1), 3: (3, True, 1)}
    assert index.read().count() == 4
    plan = index.lacking(index.read())._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "left_anti" in plan.lower().replace("leftanti", "left_anti")


def test_empty_table(spark, index):
    assert deduplicate(no_documents(spark), index).count() == 0
