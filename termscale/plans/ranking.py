"""The whole jobs: documents in, rankings out."""

from pyspark.sql import DataFrame

from termscale.functions import weights as W
from termscale.operators import ranking as R
from termscale.operators.index import clustered_by_term, index_rows, known_corpus_stats
from termscale.operators.position import with_half
from termscale.session import written


def build_index(docs: DataFrame, stop: DataFrame = None, lexicon: DataFrame = None, bucketed=False) -> DataFrame:
    """The index of (doc_id, text) documents as a written table, for any number of later jobs."""
    return written(index_rows(docs, stop, lexicon, bucketed), "index")


def cluster_index(index: DataFrame) -> DataFrame:
    """A written index once more, in term order, for query sets that come one after another."""
    return written(clustered_by_term(index), "index-by-term")


def query_part(index: DataFrame, queries: DataFrame) -> DataFrame:
    """The written part of an index, lazy or written, that the queries can touch."""
    return written(R.query_rows(index, queries), "query-rows")


def rank_documents(docs: DataFrame, queries: DataFrame, k=R.K, k1=W.K1, b=W.B, stop=None, lexicon=None) -> DataFrame:
    """(query_id, rank, doc_id, score). The corpus is analysed once; only the document rows and
    the postings of query terms are written."""
    return R.top_documents(query_part(index_rows(docs, stop, lexicon), queries), queries, k, k1, b)


def rank_words(index: DataFrame, k=R.K, k1=W.K1, b=W.B) -> DataFrame:
    """(rank, term, score) of a written index."""
    corpus = known_corpus_stats(index)
    scores = written(R.word_scores(R.word_parts(index, corpus, k1, b), corpus), "word-scores")
    return R.top_words(R.with_first(index, scores, k), k)


def rank_documents_split(rows: DataFrame, queries: DataFrame, k=R.K, k1=W.K1, b=W.B) -> DataFrame:
    """As `top_documents`, with the two halves of the corpus scored apart and their rankings merged.

    Term and corpus statistics are those of the whole.
    """
    corpus = known_corpus_stats(rows)
    terms = R.term_idf(rows, corpus)
    scores = R.filled_scores(with_half(rows), queries, corpus, k, k1, b, terms, extra=("half",))
    return R.top_per_query(R.top_per_query(scores, k, extra=("half",)).drop("rank"), k).drop("rec_id")


def rank_words_split(index: DataFrame, k=R.K, k1=W.K1, b=W.B) -> DataFrame:
    """As `rank_words`, with the column sums of the two halves built apart and merged."""
    corpus = known_corpus_stats(index)
    parts = R.word_parts(with_half(index), corpus, k1, b, half="half")
    scores = written(R.word_scores(parts, corpus), "word-scores")
    return R.top_words(R.with_first(index, scores, k), k)
