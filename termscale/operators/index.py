"""Term frequencies and document statistics as one table.

An index row is (rec_id, doc_id, term, tf, first_pos, doc_len, max_tf). Each record has exactly
one row with a null term, its document row, so documents without terms count like all others.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscale.operators import inrow
from termscale.operators.lexicon import word_forms
from termscale.operators.tokens import by_record, term_stream

#: A caller's stop list or forms of at most so many rows become constants of the plan.
CONSTANT_ROWS = 2000


def term_counts(stream: DataFrame) -> DataFrame:
    """(rec_id, doc_id, term, tf, first_pos); the null term's tf counts the record and tokens that are no words.

    `first_pos` packs sentence and token position into one number.
    """
    return stream.groupBy("rec_id", "doc_id", "term").agg(
        F.expr("count(*) AS tf"),
        F.expr("min(shiftleft(CAST(sent_pos AS BIGINT), 32) + tok_pos) AS first_pos"),
    )


TERM_TF = "CASE WHEN term IS NOT NULL THEN tf END"


def with_document_stats(counts: DataFrame) -> DataFrame:
    return counts.selectExpr(
        "*",
        f"coalesce(sum({TERM_TF}) OVER (PARTITION BY rec_id), 0) AS doc_len",
        f"coalesce(max({TERM_TF}) OVER (PARTITION BY rec_id), 0) AS max_tf",
    )


def joined_index_rows(docs: DataFrame, stop: DataFrame = None, lexicon: DataFrame = None, bucketed=False) -> DataFrame:
    """The index by joins with the stop list and the forms, whatever their size: one shuffle, or none for a bucketed
    table (see `by_record`)."""
    rows = with_document_stats(term_counts(term_stream(by_record(docs, bucketed), stop, lexicon)))
    own = {"tf": "CASE WHEN term IS NULL THEN 1L ELSE tf END", "first_pos": "CASE WHEN term IS NOT NULL THEN first_pos END"}
    return rows.withColumns({name: F.expr(kept) for name, kept in own.items()})


def _constants(table: DataFrame, limit):
    """The rows of a short table, None for a longer one."""
    rows = [tuple(row) for row in table.limit(limit + 1).collect()]
    return rows if len(rows) <= limit else None


def index_rows(
    docs: DataFrame, stop: DataFrame = None, lexicon: DataFrame = None, bucketed=False, constant_rows=CONSTANT_ROWS
) -> DataFrame:
    """The index of (doc_id, text) documents, as a lazy plan.

    A document is analysed within its row and nothing is shuffled. A stop list or lexicon with more than `constant_rows`
    rows is joined instead (`joined_index_rows`), with the same result; `bucketed` serves those joins only.
    """
    words = forms = None
    if stop is not None:
        words = _constants(stop.select("word").filter("word is not null").distinct(), constant_rows)
    if lexicon is not None:
        forms = _constants(word_forms(lexicon), constant_rows)
    if (stop is not None and words is None) or (lexicon is not None and forms is None):
        return joined_index_rows(docs, stop, lexicon, bucketed)
    return inrow.index_rows(docs, None if words is None else [word for (word,) in words], forms)


def clustered_by_term(index: DataFrame) -> DataFrame:
    """A written index in term order, to be written again: the scan of a few terms then skips
    nearly all of it. A frequent term, or all document rows, may span any number of files."""
    order = ["term", "rec_id"]
    return index.repartitionByRange(*order).sortWithinPartitions(*order)


def term_frequencies(counts: DataFrame) -> DataFrame:
    return counts.filter("term is not null").select("rec_id", "doc_id", "term", "tf", "first_pos")


def document_stats(index: DataFrame) -> DataFrame:
    """(rec_id, doc_id, doc_len, max_tf), one row per record."""
    return index.filter("term is null").select("rec_id", "doc_id", "doc_len", "max_tf")


def document_frequency(counts: DataFrame) -> DataFrame:
    """(term, df): records that hold the term. Counted per partition before the shuffle."""
    return counts.filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row (n_docs, total_len, avg_len), from the document rows; an empty corpus has no average."""
    totals = index.filter("term is null").agg(
        F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len")
    )
    return totals.withColumn("avg_len", F.expr("total_len / nullif(n_docs, 0)").cast("double"))


def known_corpus_stats(index: DataFrame) -> DataFrame:
    """`corpus_stats`, computed now and kept as a one-row table, so that plans which use it in
    several places read the document rows once."""
    return index.sparkSession.createDataFrame(corpus_stats(index).toArrow())


def corpus_shape(counts: DataFrame) -> DataFrame:
    """One row (n_docs, total_len, avg_len, vocabulary_size) straight from term counts.

    Every record has one row with a null term, so that group's size is the number of documents.
    """
    per_term = counts.groupBy("term").agg(F.expr("count(*) AS n"), F.expr("sum(tf) AS tf"))
    totals = per_term.agg(
        F.expr("coalesce(max(CASE WHEN term IS NULL THEN n END), 0) AS n_docs"),
        F.expr(f"coalesce(sum({TERM_TF}), 0) AS total_len"),
        F.expr("count(term) AS vocabulary_size"),
    )
    return totals.withColumn("avg_len", F.expr("total_len / nullif(n_docs, 0)").cast("double"))
