"""Abbreviations learnt from a corpus, and sentences that do not end at them.

A word is an abbreviation if a full stop follows it far more often than chance: by a log-likelihood ratio, scaled down for long
words and for each time that it stands without the stop (Kiss and Strunk, Unsupervised Multilingual Sentence Boundary
Detection, 2006). One aggregate over all texts counts the words.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscale.functions import text as T
from termscale.session import written
from termscale.sources.local import broadcast_if_small

# The published threshold, and the share of an abbreviation's occurrences that have the stop.
THRESHOLD, WITH_STOP = 0.3, 0.99
#: Abbreviations up to this number are constants of the plan.
MAX_CONSTANTS = 10_000
# Characters that stand before or behind a word and are no part of it.
OPENING, CLOSING = "([{<\"'", ")]}>\"',;:"
BLANKS = " \t\r\n"


def word_stops(docs: DataFrame) -> DataFrame:
    """(word, n_stop, n): how often each word is followed by a full stop, and how often it occurs in all. A word has a letter and no
    white space; letters are lower-cased."""
    pieces = docs.selectExpr(f"explode(split(text, '[{T.literal(BLANKS)[1:-1]}]+')) AS piece")
    bare = f"rtrim({T.literal(CLOSING)}, ltrim({T.literal(OPENING)}, piece))"
    words = pieces.selectExpr(f"lower({bare}) AS word").selectExpr(
        "CASE WHEN endswith(word, '.') THEN left(word, length(word) - 1) ELSE word END AS word", "endswith(word, '.') AS stop"
    )
    words = words.filter(r"word RLIKE '\\p{L}'")
    return words.groupBy("word").agg(F.count_if("stop").alias("n_stop"), F.count(F.lit(1)).alias("n"))


def abbreviations(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(word, score) of the abbreviations of (text) documents, without their last stop; a written table."""
    stops = written(word_stops(docs), "word-stops")
    totals = stops.agg(F.sum("n_stop").alias("all_stop"), F.sum("n").alias("all_n"))
    chance = F.col("all_stop") / F.col("all_n")
    with_stop, without = F.col("n_stop"), F.col("n") - F.col("n_stop")
    common = with_stop * F.log(chance) + without * F.log(1 - chance)
    rare = with_stop * F.log(F.lit(WITH_STOP)) + without * F.log(1 - F.lit(WITH_STOP))
    inner = F.length("word") - F.length(F.translate("word", ".", ""))
    letters = F.length("word") - inner
    score = -2 * (common - rare) * F.exp(-letters) * (inner + 1) * F.pow(letters, -without)
    scored = stops.filter("n_stop > 0").crossJoin(F.broadcast(totals)).filter("all_stop < all_n")
    return written(scored.select("word", score.alias("score")).filter(F.col("score") >= threshold), "abbreviations")


def _last_word(piece: str) -> str:
    """The word before the one full stop that a piece ends with, null without such a stop."""
    last = f"substring_index(translate(rtrim({T.literal(BLANKS)}, {piece}), {T.literal(BLANKS[1:])}, '   '), ' ', -1)"
    bare = T.once(
        last,
        lambda it: f"CASE WHEN endswith({it}, '.') THEN lower(ltrim({T.literal(OPENING)}, left({it}, length({it}) - 1))) END",
    )
    return bare


def _merged(pieces: str) -> str:
    """array<string> of sentences from an array of (piece, short): a piece goes on behind one that ends in an abbreviation."""

    def cut(it):
        starts = f"filter(sequence(0, size({it}) - 1), i -> i = 0 OR NOT {it}[i - 1].short)"
        parts = f"slice({it}, start + 1, coalesce(get(starts, x + 1), size({it})) - start)"
        whole = f"rtrim({T.literal(BLANKS)}, array_join(transform({parts}, p -> p.piece), ''))"
        # The last sentence keeps its white space if no end mark closes it, as in a plain split.
        kept = f"CASE WHEN x = size(starts) - 1 AND NOT {it}[size({it}) - 1].ended THEN array_join(transform({parts}, p -> p.piece), '') ELSE {whole} END"
        sentences = f"transform(array({starts}), starts -> transform(starts, (start, x) -> {kept}))[0]"
        return f"CASE WHEN size({it}) = 0 THEN CAST(array() AS array<string>) ELSE {sentences} END"

    return T.once(pieces, cut)


def sentence_arrays(docs: DataFrame, known: DataFrame, max_constants: int = MAX_CONSTANTS) -> DataFrame:
    """`docs` with `sentences`, array<string>, in place of `text`: those of `text.sentences`, joined where one ends with a single full
    stop behind a word of `known` (word).

    A table of up to `max_constants` words becomes constants and no row is moved; a larger one is joined with the last words of
    the pieces, which are gathered again by document. A null or empty text has no sentences.
    """
    ids = [c for c in docs.columns if c != "text"]
    ended = f"regexp_like(p, {T.literal('(?:' + T.END_MARK + ')[ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n]*+' + chr(92) + 'z')})"
    split = f"transform(regexp_extract_all(coalesce(text, ''), {T.literal(T.SENTENCE)}, 0), p -> struct(p AS piece, %s AS short, {ended} AS ended))"
    words = [row.word for row in known.select("word").limit(max_constants + 1).collect()]
    if len(words) <= max_constants:
        named = ", ".join(T.literal(word) for word in words)
        short = f"coalesce({_last_word('p')} IN ({named}), false)" if words else "false"
        return docs.selectExpr(*ids, f"{_merged(split % short)} AS sentences")
    rows = written(docs.withColumn("row_id", F.monotonically_increasing_id()), "documents")
    pieces = rows.selectExpr("row_id", f"posexplode({split % _last_word('p')}) AS (place, p)")
    pieces = pieces.selectExpr("row_id", "place", "p.piece", "p.short AS word", "p.ended")
    found = known.select("word", F.lit(True).alias("found")).distinct()
    joined = pieces.join(broadcast_if_small(found), "word", "left")
    entry = F.expr("struct(place, piece, coalesce(found, false) AS short, ended)")
    whole = joined.groupBy("row_id").agg(F.sort_array(F.collect_list(entry)).alias("pieces"))
    whole = whole.selectExpr("row_id", f"{_merged('pieces')} AS sentences")
    none = F.array().cast("array<string>")
    return rows.join(whole, "row_id", "left").select(*ids, F.coalesce("sentences", none).alias("sentences"))
