"""Packing documents into token sequences along a space-filling curve.

A document's hashed token vector is projected to three dimensions; documents are sorted by the Hilbert key
of that point, so neighbours on the curve use similar words, and the sorted stream of ids is cut every
`capacity` ids. Only the last sequence can be short. Positions come from a range partition of small rows
(no text, no ids) and one offset per partition.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termscale.llm.pretokens import PieceCache, packed_ids
from termscale.session import written

CAPACITY = 2048
END_ID = 1
#: Buckets of the hashed vector, dimensions of the projection, bits of each dimension.
BUCKETS, DIMENSIONS, BITS = 1024, 3, 10
#: Documents whose vectors are made at once.
AT_ONCE = 256


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row of whole coordinates below 2**bits on the Hilbert curve."""
    axes = points.astype(np.int64).T.copy()
    n = len(axes)
    # From the highest bit down, undo the turns and mirrorings that the curve makes in each sub-cube.
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            there = (axes[i] >> bit) & 1 == 1
            swap = np.where(there, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(there, axes[0] ^ low, axes[0] ^ swap)
            axes[i] ^= swap
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    turn = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((axes[n - 1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    axes ^= turn
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((axes[i] >> bit) & 1)
    return key


def curve_keys(documents: list[np.ndarray], seed: int = 7) -> np.ndarray:
    """Hilbert keys of documents given as arrays of ids; an empty document lies in the middle."""
    bucket_of = (np.arange(1 << 16, dtype=np.uint32) * np.uint32(2654435761)) >> np.uint32(22)
    axes = np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))
    keys = [np.zeros(0, np.int64)]
    for start in range(0, len(documents), AT_ONCE):
        some = documents[start : start + AT_ONCE]
        counts = np.stack([np.bincount(bucket_of[ids], minlength=BUCKETS) for ids in some])
        vectors = np.log1p(counts)
        vectors -= vectors.mean(axis=1, keepdims=True)
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        # A projection of a unit vector is about standard normal; three deviations cover the range.
        points = (vectors / np.where(norm > 0, norm, 1)) @ axes
        cells = np.clip((points + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        keys.append(hilbert_key(cells))
    return np.concatenate(keys)


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, doc_tokens, curve and ids (16 bits each, the end id last), written once."""

    def encode(batches):
        cache = PieceCache(vocabulary, packed_ids)
        end = np.uint16(END_ID).astype("<u2").tobytes()
        for batch in batches:
            packed = []
            for text in batch.column(1).to_pylist():
                found = cache.values(text)
                if found is None:
                    found = [np.array(cache.encode(text), "<u2").tobytes()]
                packed.append(b"".join(found) + end)
            keys = curve_keys([np.frombuffer(ids, "<u2") for ids in packed])
            sizes = pa.array([len(ids) // 2 for ids in packed], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(keys), pa.array(packed, pa.binary())],
                ["doc_id", "doc_tokens", "curve", "ids"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    made = rows.mapInArrow(encode, f"doc_id {kind}, doc_tokens long, curve long, ids binary")
    return written(made.withColumn("row_id", F.monotonically_increasing_id()), "encoded")


def positions(rows: DataFrame) -> DataFrame:
    """row_id and the number of ids before the row along the curve; ties go by doc_id and row_id."""
    order = ["curve", "doc_id", "row_id"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = rows.select(*order, "doc_tokens").repartitionByRange(parts, *order)
    small = written(small.withColumn("part", F.spark_partition_id()), "curve-order")
    # One row per range partition: their number is a setting and does not grow with the rows of a partition.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = small.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    offsets = sums.select("part", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("before_part"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("doc_tokens").over(within), F.lit(0)) + F.col("before_part")
    return small.join(F.broadcast(offsets), "part").select("row_id", before.alias("before"))


def pack(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and the end id. Pieces of a sequence lie one after the other from offset 0, and
    every sequence but the last holds `capacity` ids. A null or empty text is the end id alone. Repeated rows and rows
    with null or equal ids are documents of their own. Other columns are not read; an empty table gives no
    rows. Ids have to fit in 16 bits.
    """
    rows = encoded(docs, vocabulary, id_col, text_col)
    placed = rows.select("row_id", "doc_id", "doc_tokens", "ids").join(positions(rows), "row_id")

    def cut(batches):
        for batch in batches:
            source, start, length, check, total, sequence, offset = [], [], [], [], [], [], []
            befores, sizes = batch.column(3).to_pylist(), batch.column(1).to_pylist()
            for row, (packed, size, before) in enumerate(zip(batch.column(2), sizes, befores, strict=True)):
                ids = memoryview(np.frombuffer(packed.as_buffer(), "<u2").astype("<u4").tobytes())
                cuts = [0, *range(capacity - before % capacity, size, capacity), size]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    source.append(row)
                    start.append(a)
                    length.append(b - a)
                    check.append(zlib.crc32(ids[4 * a : 4 * b]))
                    total.append(size)
                    sequence.append((before + a) // capacity)
                    offset.append((before + a) % capacity)
            ids_of = batch.column(0).take(pa.array(source, pa.int64()))
            numbers = [pa.array(x, pa.int64()) for x in (start, length, check, total, sequence, offset)]
            yield pa.RecordBatch.from_arrays([ids_of, *numbers], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = dict(placed.dtypes)["doc_id"]
    inputs = placed.select("doc_id", "doc_tokens", "ids", "before")
    return inputs.mapInArrow(cut, f"doc_id {kind}, " + ", ".join(f"{name} long" for name in names[1:]))
