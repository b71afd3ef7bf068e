"""Top-k documents that read only the postings which can still change the result.

Short documents have the larger weights, so documents are put in order of impact: tiers of growing length, each about
twice the size of the one before. Within a tier they are dealt into spans of a fixed number of documents. A block
holds the postings of one term in one span, highest weight first, and its maximum stands beside it in a column
that is read without the postings.

For each query and span the maxima add up to a bound on every score there. Tiers are worked off in order; after each of them the
k-th best score of a query so far is its threshold, and a span whose bound stays below it is never read. A tier is a
folder of its own, so what no query needs of it is not scanned either.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscale.functions import weights as W
from termscale.operators.index import known_corpus_stats
from termscale.operators.ranking import K, join_queries, term_filter, top_per_query
from termscale.session import written

#: Documents of the first tier, and of a span.
FIRST_TIER, SPAN = 1024, 128
#: Scores are sums in any order; a span is left out only if its bound is lower than the threshold by this share.
SLACK = 1e-9


@dataclass
class BlockIndex:
    """blocks: (tier, span, term, n, top, postings), `postings` as array<struct<damped, rec_id, doc_id>>, written by tier;
    documents: (rec_id, doc_id) of all records; n_docs: how many."""

    blocks: DataFrame
    documents: DataFrame
    n_docs: int


def _tiers(documents: DataFrame, n_docs: int, first: int) -> list[int]:
    """Document lengths at which a tier ends, the last tier apart: one approximate quantile for each doubling."""
    shares, end, size = [], first, first
    while end < n_docs:
        shares.append(end / n_docs)
        size *= 2
        end += size
    if not shares:
        return []
    cuts = documents.agg(F.percentile_approx("doc_len", shares, 10_000).alias("cuts")).first().cuts
    return sorted(set(cuts))


def gathered(postings: DataFrame) -> DataFrame:
    """(tier, span, term, n, top, postings) in order, from postings (tier, span, term, damped, rec_id, doc_id). They go to the range of their
    block at once: a block lies in one range, so it is gathered there without another shuffle."""
    order = ["tier", "term", "span"]
    blocks = postings.repartitionByRange(*order).groupBy(*order).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("damped").alias("top"),
        F.sort_array(F.collect_list(F.struct("damped", "rec_id", "doc_id")), asc=False).alias("postings"),
    )
    return blocks.sortWithinPartitions(*order).select("tier", "span", "term", "n", "top", "postings")


def build_blocks(index: DataFrame, k1=W.K1, b=W.B, first: int = FIRST_TIER, span: int = SPAN) -> BlockIndex:
    """The blocks of a written index. Postings are shuffled once; a group is one term in one span, so it is as small as that."""
    corpus = known_corpus_stats(index)
    n_docs = corpus.first().n_docs
    documents = index.filter("term is null")
    cuts = _tiers(documents, n_docs, first)
    tier = sum((F.when(F.col("doc_len") > cut, 1).otherwise(0) for cut in cuts), F.lit(0)).cast("int").alias("tier")
    sizes = {row.tier: row["count"] for row in documents.groupBy(tier).count().collect()}
    spans = F.lit(1)
    for number, size in sizes.items():
        spans = F.when(F.col("tier") == number, -(-size // span)).otherwise(spans)
    damped = W.length_damped(W.augmented_tf(F.col("tf"), F.col("max_tf")), F.col("doc_len"), F.col("avg_len"), k1, b)
    postings = (
        index.filter("term is not null")
        .crossJoin(F.broadcast(corpus.select("avg_len")))
        .select("term", "rec_id", "doc_id", damped.alias("damped"), tier)
        .withColumn("span", F.pmod(F.xxhash64("rec_id"), spans.cast("bigint")))
    )
    return BlockIndex(written(gathered(postings), "blocks", by=["tier"]), documents.select("rec_id", "doc_id"), n_docs)


def _floors(best: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): the score that a document has to reach, for queries with k documents already."""
    found = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
    return found.filter(F.col("n") == k).select("query_id", "floor")


def top_documents_pruned(index: BlockIndex, queries: DataFrame, k: int = K, reads: list = None) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query, as `ranking.top_documents` has them.

    What is kept between tiers is k rows per query, as a written table. `reads`, a list, gets one
    (tier, blocks read, blocks of these query terms in the tier) for each tier that was read; a block counts once for each query.
    """
    times = queries.filter("term is not null").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    of_terms = term_filter(times.select("term").distinct())
    maxima = written(of_terms(index.blocks.select("tier", "span", "term", "n", "top")), "block-maxima")
    df = maxima.groupBy("term").agg(F.sum("n").alias("df"))
    idf = W.idf(F.lit(index.n_docs), F.col("df"))
    asked = written(times.join(df, "term").select("query_id", "term", "df", (F.col("times") * idf).alias("factor")), "asked")
    bounds = (
        join_queries(maxima, asked, by="span")
        .groupBy("query_id", "tier", "span")
        .agg(F.sum(F.col("factor") * F.col("top")).alias("bound"), F.count(F.lit(1)).alias("n_blocks"))
    )
    bounds = written(bounds, "block-bounds")
    totals = {row.tier: row.n for row in bounds.groupBy("tier").agg(F.sum("n_blocks").alias("n")).collect()}
    best, done = None, -1
    while True:
        left = bounds.filter(F.col("tier") > done)
        if best is not None:
            reach = F.col("floor").isNull() | (F.col("bound") >= F.col("floor") * (1 - SLACK) - SLACK)
            left = left.join(_floors(best, k), "query_id", "left").filter(reach).drop("floor")
        tier = left.agg(F.min("tier")).first()[0]
        if tier is None:
            break
        live = left.filter(F.col("tier") == tier)
        if reads is not None:
            reads.append((tier, live.agg(F.sum("n_blocks")).first()[0], totals[tier]))
        blocks = of_terms(index.blocks.filter(F.col("tier") == tier).select("span", "term", "postings"))
        asked_blocks = join_queries(blocks, asked, by="span").join(live, ["query_id", "span"], "left_semi")
        scores = (
            asked_blocks.select("query_id", "factor", F.explode("postings").alias("p"))
            .groupBy("query_id", "p.rec_id", "p.doc_id")
            .agg(F.sum(F.col("factor") * F.col("p.damped")).alias("score"))
        )
        if best is not None:
            scores = scores.unionByName(best)
        best = written(top_per_query(scores, k).drop("rank"), "best-documents")
        done = tier
    first = index.documents.orderBy("doc_id", "rec_id").limit(k)
    fill = queries.select("query_id").distinct().crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))
    if best is not None:
        fill = fill.unionByName(best)
    whole = fill.groupBy("query_id", "rec_id", "doc_id").agg(F.sum("score").alias("score"))
    return top_per_query(whole, k).drop("rec_id")
