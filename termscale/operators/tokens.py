"""From documents to a stream of normalised terms."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscale.functions import text as T
from termscale.operators.lexicon import checked_forms, default_forms, look_up_forms
from termscale.sources.local import broadcast_if_small, default_stop_words


def by_record(docs: DataFrame, bucketed=False) -> DataFrame:
    """(rec_id, doc_id, text), placed by record.

    One shuffle of the raw text, the smallest form the corpus ever has: counting terms, document
    lengths and maxima all group by record first and need no shuffle afterwards. `rec_id` is
    unique, so equal document ids are neither merged nor placed together. It is only meaningful
    inside one job; never join it with the ids of another run. A task that is run again must see
    its rows in the same order, so `docs` has to be a table as read; write other results first.

    With `bucketed`, `docs` is a table bucketed by a `doc_id` that is unique. It is in place
    already and nothing is shuffled.
    """
    if bucketed:
        return docs.selectExpr("doc_id AS rec_id", "doc_id", "text")
    return docs.selectExpr("monotonically_increasing_id() AS rec_id", "doc_id", "text").repartition("rec_id")


def sentence_rows(docs: DataFrame, keep_documents=False) -> DataFrame:
    """One row per sentence; with `keep_documents` also one row per document with a null sentence."""
    ids = [c for c in docs.columns if c != "text"]
    pieces = T.sentences("text")
    if keep_documents:
        pieces = f"concat(array(CAST(NULL AS STRING)), {pieces})"
    return docs.selectExpr(*ids, f"posexplode({pieces}) AS (sent_pos, sentence)")


def raw_tokens(docs: DataFrame, keep_documents=False) -> DataFrame:
    """One row per token as written, contractions expanded and digits removed."""
    rows = sentence_rows(docs, keep_documents)
    ids = [c for c in rows.columns if c != "sentence"]
    explode = "posexplode_outer" if keep_documents else "posexplode"
    return (
        rows.selectExpr(*ids, f"{T.expand_contractions(T.without_end_mark('sentence'))} AS sentence")
        .selectExpr(*ids, f"{T.strip_digits('sentence')} AS sentence")
        .selectExpr(*ids, f"{explode}({T.tokens('sentence')}) AS (tok_pos, token)")
    )


def sentence_tokens(docs: DataFrame) -> DataFrame:
    """One row per sentence with its lower-cased tokens as an array `surfaces`."""
    rows = sentence_rows(docs)
    kept = [c for c in rows.columns if c != "sentence"]
    plain = T.strip_digits(T.expand_contractions(T.without_end_mark("sentence")))
    return rows.selectExpr(*kept, f"transform({T.tokens(plain)}, t -> lower(t)) AS surfaces")


def drop_stop_words(tokens: DataFrame, stop: DataFrame) -> DataFrame:
    """Tokens not in the stop list; the test is case-sensitive."""
    return tokens.join(stop.select(F.col("word").alias("token")), "token", "left_anti")


def tagged_tokens(docs: DataFrame, stop: DataFrame, forms: DataFrame) -> DataFrame:
    """Lower-cased tokens outside the stop list with tag, class and lemma."""
    kept = drop_stop_words(raw_tokens(docs), stop)
    return look_up_forms(kept.selectExpr("*", "lower(token) AS surface"), forms)


def term_stream(docs: DataFrame, stop: DataFrame = None, lexicon: DataFrame = None) -> DataFrame:
    """The analyser: one row per token outside the stop list with its term, or a null term if it is no word.

    Every record also has one row without a token, so that records without terms stay visible.
    `stop` (word) and `lexicon` (surface, tag, lemma) default to the shipped tables.
    """
    spark = docs.sparkSession
    stop = F.broadcast(default_stop_words(spark)) if stop is None else broadcast_if_small(stop.distinct())
    forms = default_forms(spark) if lexicon is None else checked_forms(lexicon)
    # Stop words go before the look-up; the rows without a token match no stop word.
    kept = drop_stop_words(raw_tokens(docs, keep_documents=True), stop)
    found = look_up_forms(kept.selectExpr("*", "lower(token) AS surface"), forms)
    keep = f"class IS NOT NULL AND {T.is_word('surface')}"
    ids = [c for c in docs.columns if c != "text"]
    return found.selectExpr(*ids, "sent_pos", "tok_pos", f"CASE WHEN {keep} THEN lemma END AS term")
