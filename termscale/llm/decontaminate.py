"""Benchmark decontamination by spaced seeds, tolerant of substituted words.

A seed is a fixed mask over word positions: it reads some of `span` neighbouring words and ignores the others,
so a replaced word hides only the seeds that read it. Seeds of all benchmark items and all documents are
hashed and joined; each hit names a document, an item and a diagonal (word position in the document less that
in the item). The words along every distinct diagonal that was hit are then compared.

Two words of a seed mask miss each other nowhere in a window of 13 words with at most two replaced: every
such window holds a seed that reads neither (tested by enumeration). So no overlap is lost.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscale.llm.columns import unused
from termscale.session import written

#: Word offsets that a seed reads, five words each.
MASKS = ((0, 1, 3, 6, 7),)
#: An overlap is so many neighbouring words of an item, of which so many stand at the same place in the document.
WINDOW, MATCHES = 13, 11
#: Shorter items give no evidence.
LEAST_WORDS = 8


def words(text):
    """Lower-cased runs of letters and digits; null for a null text, empty if there is none."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda word: word != "")


def seeds(table: DataFrame, keys: list[str], masks=MASKS) -> DataFrame:
    """keys, pos, seed: one row for each mask and position at which it lies within `words`."""
    hashed = table.select(*keys, F.transform("words", lambda word: F.xxhash64(word)).alias("codes"))

    def read(number, mask):
        last = F.size("codes") - F.lit(max(mask) + 1)

        def seed(place):
            return F.xxhash64(F.lit(number), *[F.get("codes", place + offset) for offset in mask])

        found = F.transform(F.sequence(F.lit(0), last), seed)
        return F.when(last >= 0, found).otherwise(F.array().cast("array<bigint>"))

    rows = [hashed.select(*keys, F.posexplode(read(n, mask)).alias("pos", "seed")) for n, mask in enumerate(masks)]
    union = rows[0]
    for more in rows[1:]:
        union = union.unionByName(more)
    return union


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_key, item_id, words of the items that are long enough; equal ids or texts stay separate."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("words"))
    return written(items.filter(F.size("words") >= LEAST_WORDS).withColumn("item_key", F.monotonically_increasing_id()), "items")


def _named(docs, id_col, text_col):
    """doc_id, text_key and text; rows with a null id are told apart by a hash of the text."""
    text, doc_id = F.col(text_col), F.col(id_col)
    key = F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.lit(0))
    return docs.select(doc_id.alias("doc_id"), key.alias("text_key"), text.alias("text"))


def _same_row(table):
    return table["hit_doc"].eqNullSafe(F.col("doc_id")) & (table["hit_key"] == F.col("text_key"))


def _best_overlaps(docs, benchmark, id_col, text_col, item_id_col, item_text_col, masks):
    items = items_of(benchmark, item_id_col, item_text_col)
    texts = _named(docs, id_col, text_col)
    by_row = ["doc_id", "text_key"]
    doc_seeds = seeds(texts.select(*by_row, words(F.col("text")).alias("words")), by_row, masks)
    item_seeds = seeds(items, ["item_key"], masks).select("item_key", F.col("pos").alias("item_at"), "seed")
    hits = doc_seeds.join(item_seeds, "seed")
    diagonal = (F.col("pos") - F.col("item_at")).alias("diagonal")
    hits = hits.select(F.col("doc_id").alias("hit_doc"), F.col("text_key").alias("hit_key"), "item_key", diagonal)
    hits = written(hits.distinct(), "seed-hits")

    # Only documents with a hit are split into words again.
    named = hits.select("hit_doc", "hit_key").distinct()
    hit = texts.join(named, _same_row(named), "left_semi").select(*by_row, words(F.col("text")).alias("doc_words"))
    pairs = hits.join(items, "item_key")
    pairs = pairs.join(hit, _same_row(pairs))
    same = F.transform(
        F.sequence(F.lit(0), F.size("words") - 1),
        lambda i: F.coalesce((F.get("words", i) == F.get("doc_words", i + F.col("diagonal"))).cast("int"), F.lit(0)),
    )
    pairs = pairs.select(*by_row, "item_id", "diagonal", same.alias("same"))
    width = F.least(F.lit(WINDOW), F.size("same"))
    sums = F.transform(
        F.sequence(F.lit(0), F.size("same") - width),
        lambda i: F.aggregate(F.slice("same", i + 1, width), F.lit(0), lambda a, b: a + b),
    )
    pairs = pairs.withColumns({"sums": sums, "need": F.when(width < WINDOW, width).otherwise(F.lit(MATCHES))})
    pairs = pairs.withColumn("n_matched", F.array_max("sums")).filter("n_matched >= need")
    window_at = F.array_position("sums", F.col("n_matched")).cast("int")
    first = window_at - 1 + F.array_position(F.slice("same", window_at, F.size("same")), 1).cast("int") - 1
    places = [first.alias("item_pos"), (first + F.col("diagonal")).alias("doc_pos")]
    found = pairs.select(*by_row, "item_id", "n_matched", *places)
    best = F.min(F.struct((-F.col("n_matched")).alias("n"), "doc_pos", "item_pos"))
    return found.groupBy(*by_row, "item_id").agg(best.alias("best"))


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    masks=MASKS,
) -> DataFrame:
    """doc_id, item_id, doc_pos, item_pos, n_matched: the best diagonal of each document and item that overlap.

    They overlap when, along a diagonal, 13 neighbouring words hold at least 11 that are equal; for an item of 8 to
    12 words, all its words. The best diagonal has most equal words in such a window, then the smallest position in
    the document. `doc_pos` and `item_pos` are the places of the first equal word of its first best window.
    Words are lower-cased runs of letters and digits. Null and empty texts, and items under 8 words, overlap with
    nothing. Rows that share doc_id (or, with a null id, the text) give one result row for each item.
    Other columns are not read. With an empty table on either side there are no rows.
    """
    best = _best_overlaps(docs, benchmark, id_col, text_col, item_id_col, item_text_col, masks)
    return best.select(
        "doc_id",
        "item_id",
        F.col("best.doc_pos").cast("long").alias("doc_pos"),
        F.col("best.item_pos").cast("long").alias("item_pos"),
        (-F.col("best.n")).cast("long").alias("n_matched"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that overlap with no item; rows with null ids are judged by text."""
    found = _best_overlaps(docs, benchmark, id_col, text_col, "item_id", "text", MASKS)
    leaking_id, leaking_key = unused(docs, "leaking_id"), unused(docs, "leaking_key")
    found = found.select(F.col("doc_id").alias(leaking_id), F.col("text_key").alias(leaking_key)).distinct()
    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col))).otherwise(F.lit(0))
    leaking = F.col(id_col).eqNullSafe(F.col(leaking_id)) & (key == F.col(leaking_key))
    return docs.join(found, leaking, "left_anti")
