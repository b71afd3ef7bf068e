"""The analyser within a row: a document's text becomes its counted terms by expressions, so no row leaves its place.

The stop list and the forms of the lexicon are constants of the plan here: a set, and a table hashed into buckets. Tables
of a caller that are too large for that go through the joins of `tokens`. The arrays of a row take about 100
bytes for each token of its document while the row is worked on.
"""

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscale import rules
from termscale.functions import text as T
from termscale.operators.lexicon import shipped_form_rows
from termscale.session import written
from termscale.sources.local import broadcast_if_small, spread

#: Buckets of the form table.
BUCKETS = 1024


def bucketed_forms(rows) -> str:
    """(surface, tag, lemma) rows as a constant array of buckets, by the crc32 of the surface. The lemma of an entry is null where its
    tag has no word class, as such words are no terms."""
    buckets = [[] for _ in range(BUCKETS)]
    for surface, tag, lemma in rows:
        kept = T.literal(lemma) if tag[:1] and tag[:1] in "JVNR" else "CAST(NULL AS STRING)"
        buckets[zlib.crc32(surface.encode()) % BUCKETS].append(f"struct({T.literal(surface)} AS surface, {kept} AS lemma)")
    # All buckets have one type, the empty ones too.
    none = "CAST(array() AS array<struct<surface: string, lemma: string>>)"
    return "array(" + ", ".join(f"array({', '.join(bucket)})" if bucket else none for bucket in buckets) + ")"


def token_arrays(text: str) -> str:
    """array<array<string>>: the tokens of each sentence of a text."""
    made = T.sentences(text)
    for step in (T.without_end_mark, T.expand_contractions, T.strip_digits, T.tokens):
        made = f"transform({made}, sentence -> {step('sentence')})"
    return made


def is_word(token: str) -> bool:
    """As `T.is_word`."""
    return len(token) >= 2 and token[0] not in T.EDGE_PUNCTUATION and token[-1] not in T.EDGE_PUNCTUATION


def runs(entries: str) -> str:
    """array<struct<term, tf, first_pos>> of a sorted array of entries whose first fields `0` and `1` are term and place: it is cut
    where the term changes."""
    starts = "filter(sequence(0, size(it) - 1), i -> i = 0 OR it[i].`0` <> it[i - 1].`0`)"
    tf = "CAST(coalesce(get(starts, x + 1), size(it)) - start AS BIGINT)"
    entry = f"struct(it[start].`0` AS term, {tf} AS tf, it[start].`1` AS first_pos)"
    cut = f"transform(array({starts}), starts -> transform(starts, (start, x) -> {entry}))[0]"
    none = "CAST(array() AS array<struct<term: string, tf: bigint, first_pos: bigint>>)"
    return f"transform(array({entries}), it -> CASE WHEN size(it) = 0 THEN {none} ELSE {cut} END)[0]"


def lemma_of(word: str, form_rows) -> str:
    """The lemma of a word in lower case: itself if it is unknown, null if its tag has no word class."""
    # Words that are their own lemma need no look-up.
    changed = [row for row in form_rows if row[2] != row[0] or not row[1][:1] or row[1][:1] not in "JVNR"]
    if not changed:
        return word
    known = ", ".join(T.literal(surface) for surface, _, _ in changed)
    bucket = f"get({bucketed_forms(changed)}, CAST(crc32({word}) % {BUCKETS} AS INT))"
    # Most words are unknown, and a set tells so faster than the table does.
    return f"CASE WHEN {word} IN ({known}) THEN get(filter({bucket}, e -> e.surface = {word}), 0).lemma ELSE {word} END"


def counted_terms(text: str, stop_words, form_rows) -> str:
    """array<struct<term, tf, first_pos>> of a text's terms, by term.

    Only what has to be done for each token is: all are lowered in one call, joined by a blank, which no token holds, and whether
    it is a word is asked of each distinct term.
    """
    # Sentences count from 1, as in an index made by joins, where 0 is the record itself. `pos` packs the places of sentence and token.
    first = "shiftleft(CAST(x + 1 AS BIGINT), 32)"
    none = "CAST(array() AS array<bigint>)"
    places = f"transform(it, (tokens, x) -> CASE WHEN size(tokens) > 0 THEN sequence({first}, {first} + size(tokens) - 1) ELSE {none} END)"
    # Only words have a lemma. Where no lemma of a word could be taken for something else, that can be told after the look-up.
    forms = [(surface, tag if is_word(surface) else "", lemma) for surface, tag, lemma in form_rows]
    late = all(is_word(lemma) for _, tag, lemma in forms if tag[:1] and tag[:1] in "JVNR")
    found = lemma_of("word", forms)
    if not late:
        found = f"CASE WHEN {T.is_word('word')} THEN {found} END"
    terms = "split(lower(array_join(flatten(it), ' ')), ' ', -1)"
    if found != "word":
        terms = f"transform({terms}, word -> {found})"
    # A text without tokens has one empty word in lower case, and no token beside it. The fields of a zip of expressions are
    # named by their numbers: term, place, token.
    stop = ", ".join(T.literal(word) for word in stop_words)
    kept = f"t.`0` IS NOT NULL AND t.`2` {f'NOT IN ({stop})' if stop_words else 'IS NOT NULL'}"
    tokens = f"sort_array(filter(arrays_zip({terms}, flatten({places}), flatten(it)), t -> {kept}))"
    counts = runs(f"transform(array({token_arrays(text)}), it -> {tokens})[0]")
    return f"filter({counts}, t -> {T.is_word('t.term')})" if late else counts


def record_terms(docs: DataFrame, stop_words=None, form_rows=None) -> DataFrame:
    """(rec_id, doc_id, terms): each record's terms as array<struct<term, tf, first_pos>>, in order of the terms.

    `stop_words` and `form_rows` (surface, tag, lemma) are short lists; the shipped ones by default. `rec_id` is unique and only
    meaningful inside one job. A task that is run again must see its rows in the same order, so `docs` has to be a table
    as read; write other results first.
    """
    stop_words = rules.stop_words() if stop_words is None else stop_words
    form_rows = shipped_form_rows(docs.sparkSession) if form_rows is None else form_rows
    counts = counted_terms("text", stop_words, form_rows)
    records = docs.selectExpr("monotonically_increasing_id() AS rec_id", "doc_id", "text")
    return spread(records).selectExpr("rec_id", "doc_id", f"{counts} AS terms")


def index_rows(docs: DataFrame, stop_words=None, form_rows=None) -> DataFrame:
    """The index of (doc_id, text) documents (see `termscale.operators.index`) without a shuffle."""
    records = record_terms(docs, stop_words, form_rows)
    sizes = ("aggregate(terms.tf, 0L, (n, tf) -> n + tf) AS doc_len", "coalesce(array_max(terms.tf), 0L) AS max_tf")
    own = "struct(CAST(NULL AS STRING) AS term, 1L AS tf, CAST(NULL AS BIGINT) AS first_pos)"
    # `inline` would have the optimiser test the size of the array, and so make it twice; a record has one row at least.
    rows = records.selectExpr("rec_id", "doc_id", *sizes, f"concat(array({own}), terms) AS rows")
    return rows.selectExpr("rec_id", "doc_id", "doc_len", "max_tf", "inline_outer(rows)").select(
        "rec_id", "doc_id", "term", "tf", "first_pos", "doc_len", "max_tf"
    )


def counted_tokens(text: str, stop_words, lowered=False) -> str:
    """array<struct<token, n>> of a text's tokens outside the stop list, in lower case if `lowered`."""
    stop = ", ".join(T.literal(word) for word in stop_words)
    kept = f"flatten({token_arrays(text)})"
    if stop_words:
        kept = f"filter({kept}, t -> t NOT IN ({stop}))"
    if lowered:
        kept = f"transform(array({kept}), it -> CASE WHEN size(it) > 0 THEN split(lower(array_join(it, ' ')), ' ', -1) ELSE it END)[0]"
    starts = "filter(sequence(0, size(it) - 1), i -> i = 0 OR it[i] <> it[i - 1])"
    entry = "struct(it[start] AS token, CAST(coalesce(get(starts, x + 1), size(it)) - start AS BIGINT) AS n)"
    cut = f"transform(array({starts}), starts -> transform(starts, (start, x) -> {entry}))[0]"
    none = "CAST(array() AS array<struct<token: string, n: bigint>>)"
    return f"transform(array(sort_array({kept})), it -> CASE WHEN size(it) = 0 THEN {none} ELSE {cut} END)[0]"


def token_counts(docs: DataFrame, stop_words=None, lowered=False) -> DataFrame:
    """(doc_id, token, n): the tokens of each document id outside the stop list, `stop_words` or the shipped one.

    A record's tokens are counted within its row, so an aggregate never holds the tokens of many records. Only the counts of ids that
    several records share, null included, are shuffled and added up.
    """
    counts = counted_tokens("text", rules.stop_words() if stop_words is None else stop_words, lowered)

    def counted(records):
        # The outer form, as others have the optimiser test the size of the array, and so make it twice.
        return records.selectExpr("doc_id", f"inline_outer({counts})").filter("n IS NOT NULL")

    shared = written(docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("shared")), "shared-ids")
    docs = spread(docs.select("doc_id", "text"))
    if shared.isEmpty():
        return counted(docs)
    ids = broadcast_if_small(shared)
    same = F.col("doc_id").eqNullSafe(F.col("shared"))
    added = counted(docs.join(ids, same, "left_semi")).groupBy("doc_id", "token").agg(F.sum("n").alias("n"))
    return counted(docs.join(ids, same, "left_anti")).unionByName(added)
