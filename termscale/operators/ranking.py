"""Top-k documents for keyword queries and top-k words of the corpus."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termscale.functions import weights as W
from termscale.operators.index import known_corpus_stats
from termscale.operators.scoring import HOT_TERMS, term_idf, weigh
from termscale.sources.local import broadcast_if_small

K = 10
# Sums run in any order, so equal scores may differ in the last bits; ranks compare this many digits.
SCORE_DIGITS = 9
# Query terms become constants of the plan up to this number, and a table to join with beyond it.
MAX_CONSTANTS = 10_000
#: Parts into which the postings of a hot term are dealt where its queries are too many to broadcast.
SALTS = 64


def _score_order():
    return F.round("score", SCORE_DIGITS).desc()


def term_filter(asked: DataFrame, max_constants=MAX_CONSTANTS, hot=HOT_TERMS):
    """A function that keeps the rows whose `term` is among the distinct terms `asked`, for any number of them.

    A few terms become constants of a filter that reaches the scan. More are a table: broadcast if it is small, so that the rows
    stay in place; otherwise both sides are dealt by term, but for the terms that have more than 1/`hot` of the rows, of
    which there are fewer than `hot`: those are found by a count with map-side combine and filtered in place.
    """
    terms = [row.term for row in asked.limit(max_constants + 1).collect()]
    if len(terms) <= max_constants:
        return lambda rows: rows.filter(F.col("term").isin(terms))
    small = broadcast_if_small(asked)
    if small is not asked:
        return lambda rows: rows.join(small, "term", "left_semi")
    spark = asked.sparkSession

    def joined(rows):
        sizes = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        most = sizes.filter(F.col("n") * hot > rows.count()).select("term")
        names = F.broadcast(spark.createDataFrame(most.toArrow()))
        wanted = F.broadcast(spark.createDataFrame(asked.join(names, "term", "left_semi").toArrow()))
        rare = asked.join(names, "term", "left_anti")
        return rows.join(wanted, "term", "left_semi").unionByName(
            rows.join(names, "term", "left_anti").join(rare, "term", "left_semi")
        )

    return joined


def query_rows(index: DataFrame, queries: DataFrame, max_constants=MAX_CONSTANTS, hot=HOT_TERMS) -> DataFrame:
    """The part of an index that the queries can touch: the document rows, which hold what the
    corpus statistics need, and the postings of query terms.

    Up to `max_constants` terms this is one filter and nothing is shuffled, however many rows have no term or a
    frequent one. More terms are joined (`term_filter`); `index` should then be a written table, as it is read more than once.
    """
    asked = queries.select("term").filter("term is not null").distinct()
    terms = [row.term for row in asked.limit(max_constants + 1).collect()]
    if len(terms) <= max_constants:
        return index.filter(F.col("term").isNull() | F.col("term").isin(terms))
    postings = term_filter(asked, max_constants, hot)(index.filter("term is not null"))
    return index.filter("term is null").unionByName(postings)


def join_queries(
    hits: DataFrame, asked: DataFrame, measured: DataFrame = None, by="rec_id", hot=HOT_TERMS, salts=SALTS
) -> DataFrame:
    """`hits` (term, rec_id, ...) joined with `asked` (term, df, ...), which may have a term in many queries.

    A small `asked` is broadcast. Otherwise the hits of a hot term, one with more than 1/`hot` of all of them, are dealt out by
    the column `by` over `salts` parts, each of which gets that term's queries; the rest is joined by term.
    """
    small = broadcast_if_small(asked, measured=measured)
    if small is not asked:
        return hits.join(small, "term")
    total = asked.select("term", "df").distinct().agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    most = asked.select("term", "df").distinct().filter(F.col("df") * hot > total).select("term")
    names = F.broadcast(hits.sparkSession.createDataFrame(most.toArrow()))
    salted = hits.join(names, "term", "left_semi").withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    copies = asked.join(names, "term", "left_semi").withColumn("salt", parts)
    rare = hits.join(names, "term", "left_anti").join(asked.join(names, "term", "left_anti"), "term")
    return salted.join(copies, ["term", "salt"]).drop("salt").unionByName(rare)


def query_weights(
    rows: DataFrame, queries: DataFrame, corpus: DataFrame, k1=W.K1, b=W.B, terms: DataFrame = None, extra=()
) -> DataFrame:
    """(query_id, rec_id, doc_id, weight) and the `extra` columns of `rows` per matching query term, repeated terms repeated.

    Terms are compared as they are; a term the corpus lacks matches nothing. `terms` are the term
    statistics, where they are not those of `rows`.
    """
    asked = queries.filter("term is not null").select("query_id", "term")
    asked = asked.join(term_idf(rows, corpus) if terms is None else terms, "term")
    hits = join_queries(rows.filter("term is not null"), asked, queries)
    return weigh(hits, corpus, k1, b).select("query_id", "rec_id", "doc_id", *extra, "weight")


def query_scores(rows: DataFrame, queries: DataFrame, corpus: DataFrame, k1=W.K1, b=W.B) -> DataFrame:
    """(query_id, rec_id, doc_id, score) of every matching document."""
    return (
        query_weights(rows, queries, corpus, k1, b)
        .groupBy("query_id", "rec_id", "doc_id")
        .agg(F.sum("weight").alias("score"))
    )


def filled_scores(
    rows: DataFrame, queries: DataFrame, corpus: DataFrame, k=K, k1=W.K1, b=W.B, terms: DataFrame = None, extra=()
) -> DataFrame:
    """Scores of the matching documents and of enough others, at zero, to fill every ranking.

    Every document is in the ranking, without a match at score zero, ties in document order. A
    match scores above zero, so only the first k documents can fill a ranking that has fewer
    than k matches: k rows per query stand for the whole product of queries and documents.
    """
    documents = rows.filter("term is null").select("rec_id", "doc_id", *extra)
    if extra:
        place = F.row_number().over(Window.partitionBy(*extra).orderBy("doc_id", "rec_id"))
        first = documents.withColumn("place", place).filter(F.col("place") <= k).drop("place")
    else:
        first = documents.orderBy("doc_id", "rec_id").limit(k)
    fill = queries.select("query_id").distinct().crossJoin(F.broadcast(first)).withColumn("weight", F.lit(0.0))
    return (
        query_weights(rows, queries, corpus, k1, b, terms, extra)
        .unionByName(fill)
        .groupBy("query_id", "rec_id", "doc_id", *extra)
        .agg(F.sum("weight").alias("score"))
    )


def top_per_query(scores: DataFrame, k=K, extra=()) -> DataFrame:
    """(query_id, rank, doc_id, score). Each task keeps k rows per query before the shuffle. With `extra`
    columns, a ranking for each of their values too."""
    order = Window.partitionBy("query_id", *extra).orderBy(_score_order(), "doc_id", "rec_id")
    return (
        scores.withColumn("rank", F.row_number().over(order).cast("bigint"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "doc_id", "rec_id", "score")
    )


def top_documents(rows: DataFrame, queries: DataFrame, k=K, k1=W.K1, b=W.B) -> DataFrame:
    """The k best documents of each query, from a written table of `query_rows`."""
    scores = filled_scores(rows, queries, known_corpus_stats(rows), k, k1, b)
    return top_per_query(scores, k).drop("rec_id")


def top_documents_single(rows: DataFrame, query: DataFrame, k=K, k1=W.K1, b=W.B) -> DataFrame:
    """(doc_id, score) of the k best documents of one query, best first."""
    scores = filled_scores(rows, query, known_corpus_stats(rows), k, k1, b)
    return scores.orderBy(_score_order(), "doc_id", "rec_id").limit(k).select("doc_id", "score")


def word_parts(postings: DataFrame, corpus: DataFrame, k1=W.K1, b=W.B, half: str = None) -> DataFrame:
    """(term, damped, df): what each word's postings add to its score. With a column `half` of 1 and 2, the sums of both are built
    apart and then merged.

    The idf is the same in every document, so the column sum of weights is idf times the sum of
    the rest. df comes out of the same aggregate: no join of postings with term statistics. Numbers are all that is aggregated, so a task
    keeps one short row per word in a hash table and sorts nothing.
    """
    tf_part = W.augmented_tf(F.col("tf"), F.col("max_tf"))
    damped = W.length_damped(tf_part, F.col("doc_len"), F.col("avg_len"), k1, b)
    parts = [damped] if half is None else [F.when(F.col(half) == part, damped) for part in (1, 2)]
    sums = [F.coalesce(F.sum(part), F.lit(0.0)).alias(f"damped{i}") for i, part in enumerate(parts)]
    found = (
        postings.filter("term is not null")
        .crossJoin(F.broadcast(corpus.select("avg_len")))
        .groupBy("term")
        .agg(*sums, F.count(F.lit(1)).alias("df"))
    )
    return found.select("term", sum((F.col(f"damped{i}") for i in range(1, len(parts))), F.col("damped0")).alias("damped"), "df")


def word_scores(parts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, score)"""
    return parts.crossJoin(F.broadcast(corpus.select("n_docs"))).select(
        "term", (W.idf(F.col("n_docs"), F.col("df")) * F.col("damped")).alias("score")
    )


def with_first(index: DataFrame, scores: DataFrame, k=K) -> DataFrame:
    """(term, score, first) of the written (term, score) that can be among the k best: those that reach the k-th best score, ties
    included. `first` is where a word appears first in the written index."""
    rounded = F.round("score", SCORE_DIGITS)
    floor = scores.select(rounded.alias("score")).orderBy(F.desc("score")).limit(k).agg(F.min("score")).first()[0]
    best = scores.filter(rounded >= F.lit(floor))
    postings = term_filter(best.select("term"))(index.filter("term is not null"))
    first = postings.groupBy("term").agg(F.min(F.struct("doc_id", "rec_id", "first_pos")).alias("first"))
    return first.join(broadcast_if_small(best), "term").select("term", "score", "first")


def top_words(scores: DataFrame, k=K) -> DataFrame:
    """(rank, term, score) of the k best words; ties in order of first appearance."""
    order = (_score_order(), F.col("first"), F.col("term"))
    best = scores.orderBy(*order).limit(k)
    # The window sees the k rows that are left.
    return best.select(
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"), "term", "score"
    )
