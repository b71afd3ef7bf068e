"""Vocabulary and document-term matrix."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscale.functions import weights as W
from termscale.operators.index import document_frequency, known_corpus_stats
from termscale.operators.position import number_rows
from termscale.operators.scoring import BROADCAST_TERMS, join_terms, term_idf, weigh
from termscale.session import written


#: doc_id and rec_id, which is below 2^62, as one number in order of both, null ids first; and both from that number.
NO_ID, PLACES = "-9223372036854775809BD", "4611686018427387904BD"
RECORD = f"coalesce(CAST(doc_id AS DECIMAL(20, 0)), {NO_ID}) * {PLACES} + rec_id"
RECORD_ID = f"CAST(pmod(record, {PLACES}) AS BIGINT)"
# The id that stands for null lies outside the range of the integers.
DOCUMENT_ID = f"CASE WHEN record >= ({NO_ID} + 1) * {PLACES} THEN (record - pmod(record, {PLACES})) div {PLACES} END"


#: The order of first appearance.
FIRST_ORDER = ["first_doc", "rec_id", "first_pos", "term"]


def first_places(postings: DataFrame) -> DataFrame:
    """(term, df, first_doc, rec_id, first_pos): where each term is first, in order of doc_id and rec_id.

    Ids that are whole numbers are compared as one number of fixed width, which a hash aggregate keeps in place, so that a task needs
    memory for its terms only. Other ids are compared as structs, for which the postings are sorted.
    """
    df = F.count(F.lit(1)).alias("df")
    kind = dict(postings.dtypes)["doc_id"]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        places = postings.selectExpr("term", "first_pos", f"{RECORD} AS record")
        found = places.groupBy("term").agg(df, F.min_by("first_pos", "record").alias("first_pos"), F.min("record").alias("record"))
        return found.selectExpr("term", "df", f"CAST({DOCUMENT_ID} AS {kind}) AS first_doc", f"{RECORD_ID} AS rec_id", "first_pos")
    found = postings.groupBy("term").agg(df, F.min(F.struct("doc_id", "rec_id", "first_pos")).alias("first"))
    return found.select("term", "df", F.col("first.doc_id").alias("first_doc"), "first.rec_id", "first.first_pos")


def vocabulary(counts: DataFrame) -> DataFrame:
    """(term, df, first_doc, first_pos, term_id): ids from 0 in order of first appearance."""
    terms = first_places(counts.filter("term is not null"))
    return number_rows(terms, FIRST_ORDER, "term_id", start=0).drop("rec_id")


def document_term_matrix(index: DataFrame, k1=W.K1, b=W.B, hot=BROADCAST_TERMS, ids: DataFrame = None) -> DataFrame:
    """(rec_id, doc_id, term_id, term, weight): the cells of the matrix that are not zero.

    `ids` (term, term_id) are ids that exist, for instance those of a `Dictionary`; terms without one have no column.
    """
    corpus = known_corpus_stats(index)
    named = vocabulary(index) if ids is None else document_frequency(index).join(ids, "term")
    terms = named.crossJoin(F.broadcast(corpus.select("n_docs")))
    terms = terms.select("term", "df", "term_id", W.idf(F.col("n_docs"), F.col("df")).alias("idf"))
    postings = join_terms(index.filter("term is not null"), written(terms, "vocabulary"), hot)
    return weigh(postings, corpus, k1, b).select("rec_id", "doc_id", "term_id", "term", "weight")


def sparse_vectors(matrix: DataFrame) -> DataFrame:
    """(rec_id, doc_id, indices, values) of each document with terms, indices ascending."""
    cells = F.array_sort(F.collect_list(F.struct("term_id", "weight")))
    rows = matrix.groupBy("rec_id", "doc_id").agg(cells.alias("cells"))
    return rows.select(
        "rec_id",
        "doc_id",
        F.transform("cells", lambda c: c["term_id"]).alias("indices"),
        F.transform("cells", lambda c: c["weight"]).alias("values"),
    )


def dense_columns(rows: DataFrame, terms, k1=W.K1, b=W.B) -> DataFrame:
    """(rec_id, doc_id, weights): for every document its weights of the given terms, zeros included.

    `terms` is a short list; `rows` is an index or the part of it that holds these terms.
    """
    corpus = known_corpus_stats(rows)
    asked = rows.filter(F.col("term").isin(list(terms)))
    idf = F.broadcast(term_idf(asked, corpus))
    cells = weigh(asked.join(idf, "term"), corpus, k1, b).select("rec_id", "doc_id", "term", "weight")
    documents = rows.filter("term is null").select(
        "rec_id", "doc_id", F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("weight")
    )
    picked = [F.coalesce(F.sum(F.when(F.col("term") == t, F.col("weight"))), F.lit(0.0)) for t in terms]
    return cells.unionByName(documents).groupBy("rec_id", "doc_id").agg(F.array(*picked).alias("weights"))
