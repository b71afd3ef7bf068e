"""Token counts by a map-side look-up in two tiers; no pre-token is shuffled.

First tier: the token counts of the corpus's frequent pre-tokens, broadcast as one small table. They are
found by a frequent-items sketch over all texts, whose size does not depend on the input. Second tier: a
cache in each worker, filled by encoding what the first tier lacks.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscale.llm.pretokens import PieceCache, lengths, tokenizer_at

#: Entries of the broadcast table, and of each sketch that selects them.
FREQUENT, TRACKED = 4096, 16384
#: Sketches are merged in so many groups before the last merge.
MERGES = 32


def frequent_words(texts: DataFrame, text_col: str = "text", size: int = FREQUENT, tracked: int = TRACKED) -> list[str]:
    """About the `size` most frequent letter runs of all texts: at most `size` words reach the driver."""
    words = texts.select(
        F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("part"),
        F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("word"),
    ).filter("word <> ''")
    parts = words.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(word, {tracked})").alias("sketch"))
    # Grouped by a constant, as the sketches of tasks without rows cannot be merged.
    top = parts.groupBy(F.lit(1)).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    top = top.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {size})")).alias("top"))
    return [row.word for row in top.select(F.col("top.item").alias("word")).collect()]


def token_counts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row per row of `docs`.

    `vocabulary` is the path of a tokenizer file that every executor can read. Counts equal the library's
    over the whole text, without added tokens. A null text counts as empty: 0 bytes, 0 tokens. Repeated
    rows stay, a null id stays null, other columns are not read, an empty table gives no rows.
    """
    words = frequent_words(docs, text_col)
    found = tokenizer_at(vocabulary).encode_batch(words, add_special_tokens=False) if words else []
    table = docs.sparkSession.sparkContext.broadcast({w: len(e.ids) for w, e in zip(words, found, strict=True)})

    def count(batches):
        cache = PieceCache(vocabulary, lengths, table.value)
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = cache.values(text)
                counts[i] = len(cache.encode(text)) if found is None else sum(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
