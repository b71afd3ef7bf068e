"""Weights and rankings: a published ranking, a hand-made corpus, and brute force."""

import math
import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from termscale.functions import weights as W
from termscale.operators import blockmax as B
from termscale.operators import index as I
from termscale.operators import matrix as M
from termscale.operators import position as Po
from termscale.operators import ranking as R
from termscale.operators import scoring as S
from termscale.plans import ranking as P
from termscale.session import written
from termscale.sources.local import query_table

INDEX = "rec_id BIGINT, doc_id BIGINT, term STRING, tf BIGINT, first_pos BIGINT, doc_len BIGINT, max_tf BIGINT"

# A published ranking, its corpus statistics, the documents it names, and the scores it prints.
GOLDEN_DF = {"object-oriented": 211, "deductive": 49, "database": 1004, "language": 232}
GOLDEN_DOCS = {
    1: (5, 1, "oo ded db lang"),
    755: (7, 2, "oo ded lang"),
    762: (4, 1, "ded db lang"),
    775: (8, 1, "oo db lang"),
    811: (10, 2, "oo db lang"),
    1181: (6, 1, "oo ded"),
    1369: (12, 1, "oo ded db lang"),
    1871: (33, 1, "oo ded"),
    2520: (3, 1, "ded db"),
    2536: (6, 1, "oo ded db lang"),
    3254: (4, 1, "oo lang"),
    **{d: (4, 1, "oo") for d in (28, 52, 71, 122, 178)},
    **{d: (4, 1, "ded db") for d in (759, 829, 871, 1853)},
    **{d: (3, 1, "oo") for d in (1249, 1281, 1363, 2473, 2483)},
}
SHORT = {"oo": "object-oriented", "ded": "deductive", "db": "database", "lang": "language"}
GOLDEN_QUERIES = [
    ["object-oriented"],
    ["object-oriented", "deductive"],
    ["object-oriented", "deductive", "database"],
    ["object-oriented", "deductive", "database", "perform"],
    ["object-oriented", "deductive", "database", "perform", "language"],
]
GOLDEN_RANKS = [
    [1249, 1281, 1363, 2473, 2483, 28, 52, 71, 122, 178],
    [1, 1181, 2536, 1369, 755, 1871, 2520, 759, 762, 829],
    [1, 2536, 1369, 1181, 2520, 759, 762, 829, 871, 1853],
    [1, 2536, 1369, 1181, 2520, 759, 762, 829, 871, 1853],
    [1, 2536, 1369, 762, 755, 775, 1181, 2520, 811, 3254],
]
GOLDEN_BEST = [7.183918058240825, 16.119521990347589, 20.40915482858826, 20.40915482858826, 27.110795039278898]


def test_published_ranking(spark):
    rows = []
    for doc_id, (doc_len, max_tf, terms) in GOLDEN_DOCS.items():
        rows.append((doc_id, doc_id, None, 1, None, doc_len, max_tf))
        rows += [(doc_id, doc_id, SHORT[t], 1, 0, doc_len, max_tf) for t in terms.split()]
    index = spark.createDataFrame(rows, INDEX)
    corpus = spark.createDataFrame([(5000, 33.4834)], "n_docs BIGINT, avg_len DOUBLE")
    terms = (
        spark.createDataFrame(list(GOLDEN_DF.items()), "term STRING, df BIGINT")
        .crossJoin(corpus)
        .select("term", "df", W.idf(F.col("n_docs"), F.col("df")).alias("idf"))
    )
    queries = query_table(spark, GOLDEN_QUERIES)
    ranking = R.top_per_query(R.filled_scores(index, queries, corpus, terms=terms)).collect()
    for query_id, (docs, best) in enumerate(zip(GOLDEN_RANKS, GOLDEN_BEST), start=1):
        mine = sorted((r for r in ranking if r.query_id == query_id), key=lambda r: r.rank)
        assert [r.doc_id for r in mine] == docs
        assert mine[0].score == pytest.approx(best, abs=1e-9)
    last = next(r for r in ranking if r.query_id == 5 and r.rank == 10)
    assert last.score == pytest.approx(13.874359164787545, abs=1e-9)


def brute_force(docs, k1=1.6, b=0.75):
    """Weights by the definition: {position: {term: weight}}, from a list of term lists."""
    bags = [Counter(d) for d in docs]
    df = Counter(t for bag in bags for t in bag)
    avg_len = sum(sum(bag.values()) for bag in bags) / len(docs)
    weights = []
    for bag in bags:
        row = {}
        for term, f in bag.items():
            tf = 0.5 + 0.5 * f / max(bag.values())
            idf = 1 + math.log(len(docs) / df[term])
            length_norm = 1 - b + b * sum(bag.values()) / avg_len
            row[term] = idf * (tf * (k1 + 1)) / (tf + k1 * length_norm)
        weights.append(row)
    return weights


def corpus(spark, texts, ids=None):
    ids = ids or range(1, len(texts) + 1)
    return spark.createDataFrame(list(zip(ids, texts)), "doc_id BIGINT, text STRING")


HAND = ["aa aa bb", "aa", "", None]


@pytest.fixture(scope="module")
def hand(spark):
    return P.build_index(corpus(spark, HAND))


def test_hand_corpus_statistics(spark, hand):
    stats = I.corpus_stats(hand).first()
    assert (stats.n_docs, stats.total_len, stats.avg_len) == (4, 4, 1.0)
    lengths = {r.doc_id: (r.doc_len, r.max_tf) for r in hand.filter("term is null").collect()}
    assert lengths == {1: (3, 2), 2: (1, 1), 3: (0, 0), 4: (0, 0)}
    weights = {(r.doc_id, r.term): r.weight for r in S.okapi_weights(hand).collect()}
    expected = brute_force([["aa", "aa", "bb"], ["aa"], [], []])
    assert weights == {
        (i, t): pytest.approx(w, abs=1e-12) for i, row in enumerate(expected, 1) for t, w in row.items()
    }


def test_documents_without_a_match_fill_the_ranking(spark, hand):
    queries = query_table(spark, [["bb"], ["missing"], [], ["aa", "aa"], ["aa"], ["AA"]])
    rows = P.query_part(hand, queries)
    ranking = {}
    for r in sorted(R.top_documents(rows, queries, k=3).collect(), key=lambda r: (r.query_id, r.rank)):
        ranking.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert [d for d, _ in ranking[1]] == [1, 2, 3]
    assert ranking[1][1][1] == ranking[1][2][1] == 0
    assert ranking[2] == ranking[3] == ranking[6] == [(1, 0.0), (2, 0.0), (3, 0.0)]
    # A repeated term counts each time.
    assert [(d, pytest.approx(2 * s)) for d, s in ranking[5]] == ranking[4]
    single = R.top_documents_single(P.query_part(hand, query_table(spark, [["bb"]])), query_table(spark, [["bb"]]), k=3)
    assert [(r.doc_id, r.score) for r in single.collect()] == ranking[1]


TEXTS = [
    "zap zip zip pow, zap. Zip pow!",
    "zip zip zip",
    "",
    "kapow zap bang bang",
    "bang zip. pow bang",
    "the of and",
    "pow",
    "kapow kapow pow zip",
    "zap",
]
TERMS = [[w.strip(".,!").lower() for w in t.split() if w not in ("the", "of", "and")] for t in TEXTS]


@pytest.fixture(scope="module")
def index(spark):
    return P.build_index(corpus(spark, TEXTS))


def test_rankings_match_brute_force(spark, index):
    weights = brute_force(TERMS)
    asked = [["zip"], ["zap", "pow"], ["bang", "kapow", "zip", "zip"], ["none", "pow"]]
    queries = query_table(spark, asked)
    rows = P.query_part(index, queries)
    whole, split = (
        sorted(map(tuple, f(rows, queries, k=5).select("query_id", "rank", "doc_id", F.round("score", 9)).collect()))
        for f in (R.top_documents, P.rank_documents_split)
    )
    expected = []
    for query_id, terms in enumerate(asked, 1):
        scores = [(i, sum(w.get(t, 0) for t in terms)) for i, w in enumerate(weights, 1)]
        best = sorted(scores, key=lambda s: -round(s[1], 9))[:5]
        expected += [(query_id, rank, i, round(s, 9)) for rank, (i, s) in enumerate(best, 1)]
    assert whole == split == expected
    scores = R.query_scores(rows, queries, I.corpus_stats(rows)).collect()
    assert len(scores) == sum(any(t in d for t in terms) for terms in asked for d in TERMS)


def test_scores_add_up_over_terms(spark, index):
    queries = query_table(spark, [["zip"], ["pow"], ["zip", "pow"], ["zip", "none", "pow", "nothing"]])
    rows = P.query_part(index, queries)
    scores = {}
    for r in R.query_scores(rows, queries, I.corpus_stats(rows)).collect():
        scores.setdefault(r.query_id, {})[r.doc_id] = r.score
    docs = scores[1].keys() | scores[2].keys()
    total = {d: pytest.approx(scores[1].get(d, 0) + scores[2].get(d, 0)) for d in docs}
    assert scores[3] == total and scores[4] == total


def test_words_match_brute_force(spark, index):
    sums = {}
    for row in brute_force(TERMS):
        for term, weight in row.items():
            sums[term] = sums.get(term, 0) + weight  # dict order is first appearance
    expected = [(t, round(s, 9)) for t, s in sorted(sums.items(), key=lambda s: -round(s[1], 9))]
    for rank in (P.rank_words, P.rank_words_split):
        words = rank(index, k=100).orderBy("rank").collect()
        assert [(r.term, round(r.score, 9)) for r in words] == expected
        assert [r["rank"] for r in words] == list(range(1, len(words) + 1))
    assert [r.term for r in P.rank_words(index, k=2).collect()] == [t for t, _ in expected[:2]]


def test_vocabulary_and_matrix(spark, index):
    order = list(dict.fromkeys(t for d in TERMS for t in d))
    assert [r.term for r in M.vocabulary(index).orderBy("term_id").collect()] == order
    # `hot` 1 sends every term but one down the shuffle path.
    for hot in (1, 1000):
        matrix = M.document_term_matrix(index, hot=hot)
        cells = {(r.doc_id, order[r.term_id]): r.weight for r in matrix.collect()}
        expected = {(i, t): w for i, row in enumerate(brute_force(TERMS), 1) for t, w in row.items()}
        assert cells == {key: pytest.approx(w, abs=1e-12) for key, w in expected.items()}
    for r in M.sparse_vectors(matrix).collect():
        assert list(r.indices) == sorted(r.indices)
        assert {order[i]: v for i, v in zip(r.indices, r["values"])} == {
            t: pytest.approx(w) for t, w in brute_force(TERMS)[r.doc_id - 1].items()
        }
    dense = {r.doc_id: r.weights for r in M.dense_columns(index, ["zip", "none", "pow"]).collect()}
    for i, row in enumerate(brute_force(TERMS), 1):
        assert dense[i] == [pytest.approx(row.get("zip", 0)), 0, pytest.approx(row.get("pow", 0))]


def test_partitioning_does_not_matter(spark, index):
    again = P.build_index(corpus(spark, TEXTS).repartition(7))
    columns = ["doc_id", "term", "tf", "first_pos", "doc_len", "max_tf"]
    assert sorted(map(str, again.select(columns).collect())) == sorted(map(str, index.select(columns).collect()))


def test_equal_ids_are_separate_records(spark):
    """A third of the records and more may share one id."""
    texts = ["zip pow"] * 6 + ["zip"] * 3
    same = P.build_index(corpus(spark, texts, [7] * 6 + [1, 2, 3]))
    apart = P.build_index(corpus(spark, texts, [11, 12, 13, 14, 15, 16, 1, 2, 3]))
    queries = query_table(spark, [["pow"]])
    scores = [
        [round(r.score, 9) for r in R.top_documents(P.query_part(x, queries), queries).orderBy("rank").collect()]
        for x in (same, apart)
    ]
    assert scores[0] == scores[1] and len(scores[0]) == 9
    halves = Po.with_half(same).filter("term is null").groupBy("half").count().collect()
    assert {r.half: r["count"] for r in halves} == {1: 4, 2: 5}


def test_query_rows_are_a_filter(spark, index):
    queries = query_table(spark, [["zip", "pow"], ["none"], ["kapow"]])
    rows = R.query_rows(index, queries)
    wanted = [r for r in index.collect() if r.term in (None, "zip", "pow", "kapow")]
    assert sorted(map(str, rows.collect())) == sorted(map(str, wanted))
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("broadcast", [True, False])
def test_any_number_of_query_terms(spark, index, monkeypatch, broadcast):
    """200,000 terms, joined; the few that the corpus has, as constants."""
    words = ["zip", "pow", "kapow", "bang", "zap"]
    few = query_table(spark, [["zip", "zip", "pow"], ["kapow", "bang"], ["zap"], ["none"]])
    padding = spark.range(200_000).selectExpr("1 + id % 4 AS query_id", "id AS pos", "concat('w', id) AS term")
    many = few.unionByName(padding)
    if not broadcast:
        monkeypatch.setattr("termscale.sources.local.broadcast_if_small.__defaults__", (None, 1))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # `hot` 2 and 6 send some of the terms, or none, down the path of frequent ones.
        for hot in (2, 6, 1000):
            rows = written(R.query_rows(index, many, hot=hot), "rows")
            wanted = [r for r in index.collect() if r.term is None or r.term in words]
            assert sorted(map(str, rows.collect())) == sorted(map(str, wanted))
            corpus = I.known_corpus_stats(rows)
            terms = written(R.term_idf(rows, corpus), "terms")
            asked = many.select("query_id", "term").join(terms, "term")
            hits = rows.filter("term is not null")
            both = [
                sorted(map(str, R.join_queries(hits, asked, hot=hot, salts=3).select("query_id", "rec_id", "term", "idf").collect())),
                sorted(map(str, hits.join(asked, "term").select("query_id", "rec_id", "term", "idf").collect())),
            ]
            assert both[0] == both[1] and both[0]
        ranks = [
            sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in R.top_documents(x, y, k=4).collect())
            for x, y in ((rows, many), (P.query_part(index, few), few))
        ]
        assert ranks[0] == ranks[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def block_corpus(spark, n, seed=3):
    draw = random.Random(seed)
    vocabulary = ["zip", "pow", "bang", *[f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]]
    texts = []
    for _ in range(n):
        size = draw.choice([0, 1, 2, 5, 20, 60])
        texts.append(" ".join(vocabulary[min(int(draw.expovariate(0.12)), 62)] for _ in range(size)))
    return corpus(spark, texts, [i % (n - 7) for i in range(n)])


@pytest.mark.parametrize("first, span", [(4, 1), (16, 4), (1000, 7), (1, 1000)])
def test_pruned_rankings_are_the_whole(spark, first, span):
    built = P.build_index(block_corpus(spark, 300))
    asked = [["zip"], ["zip", "pow", "bang"], ["wordak", "zip", "zip"], ["wordjk", "wordbl"], ["none"], [], ["wordjo", "none"]]
    queries = query_table(spark, asked)
    blocks = B.build_blocks(built, first=first, span=span)
    assert blocks.blocks.agg(F.sum("n")).first()[0] == built.filter("term is not null").count()
    for k in (1, 5, 400):
        plain, pruned = (
            sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in x.collect())
            for x in (R.top_documents(P.query_part(built, queries), queries, k), B.top_documents_pruned(blocks, queries, k))
        )
        assert plain == pruned and len(plain) == len(asked) * min(k, 300)


def test_fewer_blocks_are_read(spark):
    built = P.build_index(block_corpus(spark, 2000))
    queries = query_table(spark, [["zip"], ["pow", "bang"], ["zip", "pow"]])
    blocks = B.build_blocks(built, first=32, span=8)
    reads = []
    pruned = B.top_documents_pruned(blocks, queries, 5, reads=reads).collect()
    plain = R.top_documents(P.query_part(built, queries), queries, 5).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in pruned) == sorted((r.query_id, r["rank"], r.doc_id) for r in plain)
    tiers = blocks.blocks.select("tier").distinct().count()
    asked = blocks.blocks.filter(F.col("term").isin("zip", "pow", "bang")).count()
    read = sum(n for _, n, _ in reads)
    # Each of the terms but one is in two queries, so a block may be read twice.
    assert read < asked / 2 and len(reads) < tiers
    plan = blocks.blocks.filter("tier = 1 AND term = 'zip'").select("top")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tier" in plan and "postings" not in plan


def test_blocks_of_an_empty_corpus(spark):
    blocks = B.build_blocks(P.build_index(corpus(spark, ["x"]).filter("doc_id < 0")))
    assert B.top_documents_pruned(blocks, query_table(spark, [["zip"], []])).count() == 0


@pytest.mark.parametrize("kind", ["string", "null", "equal"])
def test_split_is_the_whole_for_any_ids(spark, kind):
    """String ids, null ids and repeated ids; the halves are scored apart and merged."""
    texts = ["zip pow", "bang zap", "zip zip bang", "pow", "kapow zip", "", "zap bang pow"]
    ids = {"string": [f"d{i % 10}" for i in range(7)], "null": [None] * 4 + [3, 1, None], "equal": [7] * 5 + [1, 9]}[kind]
    schema = f"doc_id {'STRING' if kind == 'string' else 'BIGINT'}, text STRING"
    built = P.build_index(spark.createDataFrame(list(zip(ids, texts)), schema).repartition(3))
    queries = query_table(spark, [["zip"], ["pow", "bang"], ["none"]])
    rows = P.query_part(built, queries)
    for whole, split in (
        (R.top_documents(rows, queries, 4), P.rank_documents_split(rows, queries, 4)),
        (P.rank_words(built, 4), P.rank_words_split(built, 4)),
    ):
        rounded = [sorted(str((*r[:-1], round(r.score, 9))) for r in x.collect()) for x in (whole, split)]
        assert rounded[0] == rounded[1] and rounded[0]


def test_words_of_equal_ids_in_order_of_first_appearance(spark):
    docs = spark.createDataFrame([(7, "zip pow"), (7, "bang zap")], "doc_id BIGINT, text STRING").coalesce(1)
    built = P.build_index(docs)
    ordered = [r.term for r in M.vocabulary(built).orderBy("term_id").collect()]
    assert ordered == ["zip", "pow", "bang", "zap"]
    assert [r.term for r in P.rank_words(built).orderBy("rank").collect()] == ordered


def test_weight_parameters_are_checked():
    for k1, b in ((-0.1, 0.5), (1.2, 1.5), (1.2, -0.5)):
        with pytest.raises(ValueError):
            W.length_damped(None, None, None, k1, b)


def test_clustered_index_gives_the_same_ranking(spark, index):
    queries = query_table(spark, [["zip", "pow"], ["bang"]])
    clustered = P.cluster_index(index)
    first, second = (
        sorted(map(str, R.top_documents(P.query_part(x, queries), queries).collect())) for x in (index, clustered)
    )
    assert first == second
    plan = R.query_rows(clustered, queries)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(term),In(term, [" in plan


def test_bucketed_documents_are_not_shuffled(spark, index, tmp_path):
    spark.conf.set("spark.sql.legacy.createHiveTableByDefault", "false")
    docs = corpus(spark, TEXTS)
    docs.write.bucketBy(4, "doc_id").option("path", str(tmp_path / "docs")).saveAsTable("bucketed_docs")
    try:
        rows = I.joined_index_rows(spark.table("bucketed_docs"), bucketed=True)
        assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
        columns = ["doc_id", "term", "tf", "first_pos", "doc_len", "max_tf"]
        assert sorted(map(str, rows.select(columns).collect())) == sorted(map(str, index.select(columns).collect()))
    finally:
        spark.sql("DROP TABLE bucketed_docs")


def test_empty_corpus(spark):
    empty = P.build_index(corpus(spark, ["x"]).filter("doc_id < 0"))
    stats = I.corpus_stats(empty).first()
    assert (stats.n_docs, stats.total_len, stats.avg_len) == (0, 0, None)
    queries = query_table(spark, [["zip"]])
    rows = P.query_part(empty, queries)
    assert R.top_documents(rows, queries).count() == 0
    assert P.rank_documents_split(rows, queries).count() == 0
    assert P.rank_words(empty).count() == 0
    assert M.document_term_matrix(empty).count() == 0


def test_numbers_are_consecutive_over_partitions(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1009 AS doc_id").repartition(5)
    got = [(r.doc_id, r.doc_pos) for r in Po.document_positions(rows).orderBy("doc_pos").collect()]
    assert got == list(zip(sorted(r.doc_id for r in rows.collect()), range(1, 1001)))


def test_plan_shape(spark):
    docs = written(corpus(spark, TEXTS), "docs")
    plan = I.index_rows(docs)._jdf.queryExecution().executedPlan().toString()
    # Counting and document statistics need no shuffle; a small table is dealt out over the cores.
    assert "Exchange hashpartitioning" not in plan and plan.count("Exchange") <= 1
    assert "SortMergeJoin" not in plan and "Python" not in plan
    index = P.build_index(docs)
    words = P.rank_words(index)._jdf.queryExecution().executedPlan().toString()
    assert words.count("Exchange hashpartitioning") == 1 and "TakeOrderedAndProject" in words
    queries = query_table(spark, [["zip"]])
    ranks = R.top_documents(P.query_part(index, queries), queries)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in ranks


def test_words_are_summed_without_sorting(spark):
    """Only numbers are aggregated for all words; where a word is first is asked of those that can be among the best, ties included."""
    texts = [f"q{chr(97 + i)}q q{chr(97 + (i + 7) % 26)}q common" for i in range(26)]
    index = P.build_index(corpus(spark, texts))
    parts = R.word_parts(index, I.known_corpus_stats(index))
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    scores = written(R.word_scores(parts, I.known_corpus_stats(index)), "scores")
    assert R.with_first(index, scores, 1).count() < R.with_first(index, scores, 2).count() == 27
    for rank in (P.rank_words, P.rank_words_split):
        got = [row.term for row in rank(index, k=4).orderBy("rank").collect()]
        assert sorted(got) == sorted(set(got)) and len(got) == 4
        ties = [term for term in got if term != "common"]
        first = {row.term: row.at for row in index.filter("term is not null").groupBy("term").agg(F.expr("min(struct(doc_id, first_pos)) AS at")).collect()}
        assert ties == sorted(ties, key=first.get) and set(ties) <= set(sorted(first, key=first.get)[:5])


def test_terms_that_are_broadcast(spark):
    """A thousand terms hold few of the postings of a large vocabulary: many more are broadcast, and the rest is joined."""
    assert S.BROADCAST_TERMS > S.HOT_TERMS
    index = P.build_index(corpus(spark, TEXTS))
    rows = [sorted(map(str, S.okapi_weights(index, hot=hot).collect())) for hot in (1, S.HOT_TERMS, S.BROADCAST_TERMS)]
    assert rows[0] == rows[1] == rows[2]


def test_blocks_are_gathered_in_one_shuffle(spark):
    """Postings were shuffled by block, and the blocks once more by range."""
    postings = spark.range(500).selectExpr(
        "CAST(id % 3 AS INT) AS tier", "id % 5 AS span", "concat('t', id % 7) AS term", "id / 9 AS damped", "id AS rec_id", "id AS doc_id"
    )
    blocks = B.gathered(postings)
    assert blocks._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    rows = blocks.collect()
    assert len(rows) == 105 and sorted(p.rec_id for row in rows for p in row.postings) == list(range(500))
    assert all(row.n == len(row.postings) and row.top == row.postings[0].damped for row in rows)


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_first_places_without_sorting(spark, kind):
    ids = [None, 0, -1, 5, 7, 2**31 - 1, -(2**31)] + ([2**63 - 1, -(2**63)] if kind == "long" else [])
    places = [0, 3, (5 << 33) + 1, 2**62 - 1]
    draw = random.Random(kind)
    rows = [(f"t{t}", draw.choice(ids), rec, draw.randrange(9)) for t in range(40) for rec in draw.sample(places, 3)]
    postings = spark.createDataFrame(rows, "term string, doc_id long, rec_id long, first_pos long").repartition(3)
    postings = postings.withColumn("doc_id", F.col("doc_id").cast(kind))
    found = M.first_places(postings)
    first = F.min(F.struct("doc_id", "rec_id", "first_pos")).alias("first")
    expected = postings.groupBy("term").agg(F.count("*"), first).selectExpr("*", "first.*").drop("first")
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, expected.collect())))
    # The postings of a task are not sorted, whose memory would grow with them.
    assert ("SortAggregate" in found._jdf.queryExecution().executedPlan().toString()) == (kind == "string")
