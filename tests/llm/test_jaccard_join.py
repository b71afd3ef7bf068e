import random

import numpy as np
import pytest
from compare import connection, spark_rows, sql_rows
from odd import ODD, no_documents, odd_documents

from termscale.llm.components import components
from termscale.llm.jaccard_join import jaccard_classes, one_of_each
from termscale.llm.partition_index import allocate, bands, signatures
from termscale.llm.queries import JACCARD_JOIN, op10_jaccard_join
from termscale.llm.shingles import shingle_codes


def shingles(text, size):
    words = [w.decode() for w in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_force(documents, size=4, numerator=85, denominator=100):
    sets = {i: shingles(t, size) for i, t in documents.items()}
    root = {i: i for i in documents}
    for a in sorted(documents):
        for b in sorted(documents):
            if a < b and sets[a] and denominator * len(sets[a] & sets[b]) >= numerator * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i: (len(sets[i]), root[i]) for i in documents}


def result(rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows.collect()}


@pytest.mark.parametrize(("numerator", "denominator"), [(85, 100), (80, 100), (1, 2)])
def test_similar_sets_share_a_signature(numerator, denominator):
    draw, met = np.random.default_rng(1), 0
    for trial in range(3000):
        size = int(draw.integers(1, 40 if trial % 2 else 400))
        one = np.unique(draw.integers(0, 1 << 62, size, dtype=np.uint64) << np.uint64(2))
        lost, added = draw.integers(0, 1 + size // 6, 2)
        other = np.union1d(one[lost:], draw.integers(0, 1 << 62, added, dtype=np.uint64) << np.uint64(2))
        common = len(np.intersect1d(one, other))
        every = len(one) + len(other) - common
        if denominator * common >= numerator * every and not np.array_equal(one, other):
            met += 1
            made = [signatures(codes, numerator, denominator) for codes in (one, other)]
            assert len(np.intersect1d(*made))
    assert met > 500


def test_allocation_meets_the_need_and_uses_deletions_where_they_are_cheaper():
    for apart in range(1, 200):
        near, exact = allocate(apart, 6 * apart)
        assert 2 * near + exact == apart + 1
    assert any(b.near for b in bands(5000, 85, 100)) and any(not b.near for b in bands(5000, 85, 100))


def near_copies(seed, groups, size, shared=()):
    draw, documents = random.Random(seed), {}
    for _ in range(groups):
        words = [f"w{draw.randrange(10_000)}" for _ in range(draw.randint(3, 60))] + list(shared)
        for _ in range(draw.randint(1, size)):
            copy = list(words)
            for _ in range(draw.randint(0, max(1, len(copy) // 25))):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(10_000)}"
            documents[len(documents)] = " ".join(copy)
    return documents


@pytest.mark.parametrize("options", [{}, {"size": 5, "similarity": (80, 100)}])
def test_against_brute_force(spark, options):
    passage = [f"p{i}" for i in range(25)]
    documents = near_copies(3, 12, 12) | {1000 + i: t for i, t in near_copies(4, 25, 3, passage).items()}
    table = spark.createDataFrame(list(documents.items()), "doc_id long, text string").repartition(5)
    found = result(jaccard_classes(table, **options))
    assert found == brute_force(documents, options.get("size", 4), *options.get("similarity", (85, 100)))
    kept = sorted(r.doc_id for r in one_of_each(table, **options).collect())
    assert kept == sorted({root for _, root in found.values()})


def test_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert spark_rows(op10_jaccard_join(spark, sf_dir)) == sql_rows(connection(sf_dir), JACCARD_JOIN)


def test_odd_rows(spark):
    rows = jaccard_classes(odd_documents(spark)).collect()
    expected = []
    for i, text in ODD:
        expected.append((i, len(shingles(text, 4)), 1 if i == 2 else i))
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    kept = one_of_each(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns and kept.count() == len(ODD) - 2
    assert jaccard_classes(no_documents(spark)).count() == 0


def in_batches(spark, *batches):
    """A table whose partitions are the batches."""
    rows = spark.sparkContext.parallelize(batches, len(batches)).flatMap(list)
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_null_ids_carry_no_signatures_of_other_rows(spark):
    words = [f"a{i}" for i in range(60)]
    text, last, first = " ".join(words), " ".join([*words[:-1], "z"]), " ".join(["y", *words[1:]])
    expected = {None: (57, None), 7: (57, 7), 9: (57, 7)}
    assert result(jaccard_classes(in_batches(spark, [(None, text), (7, text), (9, last)]))) == expected
    assert result(jaccard_classes(in_batches(spark, [(None, text), (7, text)], [(9, last)]))) == expected
    # All that rows 7 and 9 share is headed by the row with a null id.
    made = [set(signatures(shingle_codes(t, 4), 85, 100).tolist()) for t in (text, last, first)]
    assert made[1] & made[2] and made[1] & made[2] <= made[0]
    assert result(jaccard_classes(in_batches(spark, [(None, text), (7, last)], [(9, first)]))) == expected


def test_texts_of_one_id_are_judged_apart(spark):
    one, other = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    near_one, near_other = " ".join([*one[:-1], "z"]), " ".join([*other[:-1], "z"])
    rows = [(5, " ".join(one)), (5, " ".join(other)), (3, near_other), (8, near_one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.component_id) for r in jaccard_classes(docs).collect())
    assert found == [(3, 3), (5, 3), (5, 5), (8, 5)]
    assert sorted((r.doc_id, r.text) for r in one_of_each(docs).collect()) == [(3, near_other), (5, " ".join(one))]


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 199), (200, 199)]
    random.Random(2).shuffle(edges)
    found = components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()
    roots = {r.node: r.root for r in found}
    assert len(found) == len(roots) == 70 and all(roots[i] == 0 for i in range(1, 41))
    assert all(roots[100 + i] == 100 for i in range(1, 30)) and roots[200] == 199


@pytest.mark.parametrize(("size", "similarity"), [(5, (80, 100)), (4, (85, 100)), (2, (85, 100))])
def test_families_about_the_threshold(spark, size, similarity):
    """Variants of one text that are near enough to the leader or just not, alone and in clusters of their own, with passages in
    common that the leader lacks: links must not be lost among their differences."""
    draw = random.Random(size)
    base = [f"b{i}" for i in range(60)]
    passage = [f"p{i}" for i in range(8)]
    documents, number = {}, 0
    for _ in range(14):
        seed = list(base)
        for place in draw.sample(range(60), draw.randint(0, 4)):
            seed[place] = f"x{draw.randrange(40)}"
        if draw.random() < 0.5:
            seed = seed[: draw.randint(45, 60)]
        if draw.random() < 0.5:
            at = draw.randint(0, len(seed))
            seed[at:at] = passage[: draw.randint(1, 8)]
        for _ in range(draw.randint(1, 5)):
            words = list(seed)
            for place in draw.sample(range(len(words)), draw.randint(0, 2)):
                words[place] = f"y{draw.randrange(60)}"
            documents[number] = " ".join(words[draw.randint(0, 3) :])
            number += 1
    rows = spark.createDataFrame(list(documents.items()), "doc_id long, text string").repartition(3)
    found = result(jaccard_classes(rows, size=size, similarity=similarity))
    expected = brute_force(documents, size, *similarity)
    assert found == expected
    assert 1 < len({root for _, root in expected.values()}) < len(documents)
