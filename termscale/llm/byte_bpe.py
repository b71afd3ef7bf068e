"""Byte-level BPE: texts to ids and ids to bytes.

A pre-token is looked up whole by a minimal perfect hash over the vocabulary. What it lacks is merged from
single bytes: the bytes are a linked list, the ranks of neighbouring pairs a heap, so a pre-token of n bytes
takes n log n steps, however long it is. Both tiers live in the tasks; nothing is shuffled.
"""

import base64
from functools import cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscale.llm.perfect_hash import PerfectHash
from termscale.llm.portions import portions

#: Characters of text that are split before their pre-tokens are looked up together.
AT_ONCE = 1 << 22
#: Merged pre-tokens that a task remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 1 << 19, 64


class Vocabulary:
    """The tokens of a rank file (base64 of the token, a space, its rank); a token's rank is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            rows = [line.split() for line in file if line.strip()]
        ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.tokens = list(ranks)
        self.ids = np.array(list(ranks.values()), np.int64)
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        #: The id of two neighbouring ids merged, by both in one number.
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        #: The rank of two bytes, -1 where they do not merge, by both in one number.
        self.two_bytes = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.whole = PerfectHash(self.tokens)
        by_id = dict(zip(ranks.values(), ranks, strict=True))
        #: Bytes by id; an id that is not in use has none.
        self.bytes_of = pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.binary())

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a pre-token: of all neighbours, those of the lowest rank are merged first, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in piece]
        pairs, two, n = self.pairs, self.two_bytes, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        #: The rank of each part merged with the next, -1 where they do not merge or the part is gone.
        rank_at = [two[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        rank_at.append(-1)
        heap = [rank << 32 | i for i, rank in enumerate(rank_at) if rank >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            if rank_at[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], rank_at[i], rank_at[j] = rank, -1, -1, -1
            if k < n:
                before[k] = i
                new = pairs.get(rank << 32 | ids[k])
                if new is not None:
                    rank_at[i] = new
                    heappush(heap, new << 32 | i)
            h = before[i]
            if h >= 0:
                new = pairs.get(ids[h] << 32 | rank)
                if new is None:
                    rank_at[h] = -1
                else:
                    rank_at[h] = new
                    heappush(heap, new << 32 | h)
        return [i for i in ids if i >= 0]


@cache
def vocabulary_at(path: str) -> Vocabulary:
    """The vocabulary of a file, made once per process."""
    return Vocabulary(path)


class Encoder:
    """Texts to packed ids (little-endian, 32 bits each), by one vocabulary and split pattern."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.split = vocabulary_at(path), regex.compile(pattern).findall
        self.remembered = {}

    def _merged(self, piece: bytes) -> bytes:
        found = self.remembered.get(piece)
        if found is None:
            ids = self.vocabulary.merged(piece)
            found = pack(f"<{len(ids)}i", *ids)
            if len(piece) <= LONGEST:
                if len(self.remembered) >= REMEMBERED:
                    self.remembered.clear()
                self.remembered[piece] = found
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(text) for text in texts]
        pieces = list(set().union(*split))
        raw = [piece.encode() for piece in pieces]
        places = self.vocabulary.whole.find(raw)
        whole = self.vocabulary.ids[places].astype("<i4").tobytes()
        packed = {
            piece: whole[4 * i : 4 * i + 4] if place >= 0 else self._merged(own)
            for i, (piece, own, place) in enumerate(zip(pieces, raw, places.tolist(), strict=True))
        }
        return [b"".join([packed[piece] for piece in found]) for found in split]


def encode_texts(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, ids (array of int), one row per row of `docs`.

    `vocabulary` is the path of a rank file that every executor can read; each match of `pattern` is encoded
    apart, strings of special tokens as ordinary text. A null or empty text has no ids. Repeated rows stay, a
    null id stays null, other columns are not read, an empty table gives no rows. No text or pre-token is
    too long; the texts of one step are bounded in characters.
    """

    def encode(batches):
        encoder = Encoder(vocabulary, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in portions([len(text) for text in texts], AT_ONCE):
                packed = encoder.encode(texts[part])
                ends = np.cumsum([0, *[len(ids) // 4 for ids in packed]]).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32())
                own = batch.column(0).slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(ends, ids)], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, data (binary): the bytes of each row's ids, one row per row of `encoded`.

    No ids give empty data. Null ids, and ids of which one is null or unknown to the vocabulary, give null.
    Bytes need not be valid UTF-8, as ids may end within a character.
    """

    def decode(batches):
        bytes_of = vocabulary_at(vocabulary).bytes_of
        for batch in batches:
            lists = batch.column(1)
            starts = lists.offsets.to_numpy()
            flat = lists.values.slice(starts[0], starts[-1] - starts[0])
            numbers = flat.fill_null(-1).to_numpy()
            known = (numbers >= 0) & (numbers < len(bytes_of))
            parts = bytes_of.take(pa.array(np.where(known, numbers, 0)))
            known &= parts.is_valid().to_numpy(zero_copy_only=False)
            starts = starts - starts[0]
            faults = np.concatenate([[0], np.cumsum(~known)])
            whole = lists.is_valid().to_numpy(zero_copy_only=False) & (faults[starts[1:]] == faults[starts[:-1]])
            ends = np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1, parts.offset * 4)[starts]
            valid = pa.py_buffer(np.packbits(whole, bitorder="little").tobytes())
            buffers = [valid, pa.py_buffer(ends.tobytes()), parts.buffers()[2]]
            data = pa.Array.from_buffers(pa.binary(), len(lists), buffers)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, data], ["doc_id", "ids", "data"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(decode, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, data binary")
