"""Okapi weights of index rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscale.functions import weights as W
from termscale.operators.index import document_frequency, known_corpus_stats
from termscale.session import written
from termscale.sources.local import broadcast_if_small

#: A term with more than one in so many postings is hot; there can be no more hot terms than this.
HOT_TERMS = 1000
#: The same where a per-term table meets all postings: the terms that are broadcast, some 20 MB of them, hold nearly all postings.
BROADCAST_TERMS = 200_000


def term_idf(counts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, df, idf): idf once per term, not once per posting."""
    return (
        document_frequency(counts)
        .crossJoin(F.broadcast(corpus.select("n_docs")))
        .select("term", "df", W.idf(F.col("n_docs"), F.col("df")).alias("idf"))
    )


def join_terms(postings: DataFrame, terms: DataFrame, hot=BROADCAST_TERMS) -> DataFrame:
    """`postings` inner-joined with a written per-term table that has a `df` column.

    A frequent term would send a large share of all postings to one task, and a shuffle of all postings is many times their
    size on disk. Terms with more than 1/hot of the postings, of which there are fewer than `hot`, are broadcast; the rest,
    few postings however many terms, is joined by a shuffle on the term.
    """
    total = terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    frequent = terms.filter(F.col("df") * hot > total)
    if hot > HOT_TERMS and broadcast_if_small(frequent) is frequent:
        return join_terms(postings, terms, HOT_TERMS)
    names = F.broadcast(frequent.select("term"))
    rare = terms.filter(F.col("df") * hot <= total)
    return postings.join(F.broadcast(frequent), "term").unionByName(
        postings.join(names, "term", "left_anti").join(rare, "term")
    )


def weigh(postings: DataFrame, corpus: DataFrame, k1=W.K1, b=W.B) -> DataFrame:
    """Add `weight` to postings that carry tf, max_tf, doc_len and idf."""
    tf_part = W.augmented_tf(F.col("tf"), F.col("max_tf"))
    weight = W.okapi(F.col("idf"), tf_part, F.col("doc_len"), F.col("avg_len"), k1, b)
    return postings.crossJoin(F.broadcast(corpus.select("avg_len"))).withColumn("weight", weight).drop("avg_len")


def okapi_weights(index: DataFrame, k1=W.K1, b=W.B, hot=BROADCAST_TERMS) -> DataFrame:
    """(rec_id, doc_id, term, weight) for every term of every document of a written index."""
    corpus = known_corpus_stats(index)
    terms = written(term_idf(index, corpus), "term-idf")
    postings = join_terms(index.filter("term is not null"), terms, hot)
    return weigh(postings, corpus, k1, b).select("rec_id", "doc_id", "term", "weight")
