"""A Katz backoff language model over words, counted and evaluated without sending tokens through a shuffle.

Documents are kept as blocks: the block's distinct words and, for each token, the number of its word. One level after
the other, for n-grams of 1, 2, ... words:

* each block asks for its distinct n-grams, with how often the block's training documents hold them and the
  probability that the level below gives their last word;
* the partition that owns a context (hot contexts are dealt over all partitions, and their sums are added up apart)
  adds up the counts and writes them as one part of the level's table;
* from that table and the discounts of the whole level it answers with the count of each n-gram asked for, and with
  the size and the backed-off rest of each context, which give the block its probabilities.

Discounted probabilities of seen n-grams and the backed-off rest add up to one for every context.
"""

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from termscale.llm.shingles import mixed
from termscale.session import written

#: Counts above this are not discounted.
MOST_DISCOUNTED = 5
#: A context with more than one in so many training tokens is hot; there can be no more hot contexts than this.
HOT_CONTEXTS = 1000
#: Tokens of a block, about.
BLOCK_TOKENS = 2_000_000
END = 1


# --- packed arrays ------------------------------------------------------------------------------------------------


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0, in the smallest type that holds them, compressed: all low bytes first, all high ones last."""
    most = int(numbers.max()) if len(numbers) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    planes = numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return str(width).encode() + zlib.compress(planes.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    width = int(packed[:1])
    planes = np.frombuffer(zlib.decompress(packed[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def pack_rising(numbers: np.ndarray) -> bytes:
    """Whole numbers in ascending order."""
    return pack(np.diff(numbers, prepend=0))


def unpack_rising(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed))


def pack_floats(values: np.ndarray) -> tuple[bytes, bytes]:
    """The distinct values, and which of them each one is."""
    known, which = np.unique(values, return_inverse=True)
    return known.astype("<f8").tobytes(), pack(which)


def unpack_floats(known: bytes, which: bytes) -> np.ndarray:
    return np.frombuffer(known, "<f8")[unpack(which)]


# --- blocks -------------------------------------------------------------------------------------------------------


def word_codes(text: str | None) -> np.ndarray:
    """64-bit codes of the words between ASCII white space, A-Z lower-cased, and the end."""
    words = (text or "").encode().lower().split()
    return np.fromiter([*map(xxh3_64_intdigest, words), END], np.uint64, len(words) + 1)


def _blocks(docs: DataFrame, parts: int) -> DataFrame:
    """block, doc_ids, trains, sizes, words, tokens, train_tokens: a table bucketed by block, so that answers come to it."""

    def make(batches):
        for batch in batches:
            group, held = [], 0
            for row, text in enumerate(batch.column(2).to_pylist()):
                group.append((row, word_codes(text)))
                held += len(group[-1][1])
                if held >= BLOCK_TOKENS:
                    yield block(batch, group)
                    group, held = [], 0
            if group:
                yield block(batch, group)

    def block(batch, group):
        rows = [row for row, _ in group]
        words, tokens = np.unique(np.concatenate([codes for _, codes in group]), return_inverse=True)
        sizes = np.array([len(codes) for _, codes in group])
        trains = batch.column(1).take(pa.array(rows))
        train_tokens = int(sizes[trains.to_numpy(zero_copy_only=False)].sum())
        blob = zlib.compress(words.astype("<u8").tobytes(), 1)
        columns = {
            "doc_ids": pa.array([batch.column(0).take(pa.array(rows)).to_pylist()], pa.list_(batch.schema.field(0).type)),
            "trains": pa.array([trains.to_pylist()], pa.list_(pa.bool_())),
            "sizes": pa.array([pack(sizes)], pa.binary()),
            "words": pa.array([blob], pa.binary()),
            "tokens": pa.array([pack(tokens)], pa.binary()),
            "train_tokens": pa.array([train_tokens], pa.int64()),
        }
        return pa.RecordBatch.from_pydict(columns)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_ids array<{kind}>, trains array<boolean>, sizes binary, words binary, tokens binary, train_tokens long"
    made = docs.select("doc_id", "train", "text").mapInArrow(make, schema)
    name = f"katz_blocks_{uuid.uuid4().hex}"
    made.withColumn("block", F.monotonically_increasing_id()).write.bucketBy(parts, "block").saveAsTable(name)
    return docs.sparkSession.table(name)


class Block:
    """The tokens of a block, and what the levels answered so far."""

    def __init__(self, row: dict, answers: list[dict], sums: dict, parts: int):
        self.parts, self.sums = parts, sums
        self.words = np.frombuffer(zlib.decompress(row["words"]), "<u8")
        self.tokens, self.sizes = unpack(row["tokens"]), unpack(row["sizes"])
        self.trained = np.repeat(np.array(row["trains"], bool), self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        by_level = {}
        for answer in answers:
            by_level.setdefault(answer["level"], {})[answer["part"]] = answer
        # grams: number of each token's n-gram in the block, or -1; ids: the number of each in the level's table.
        self.grams, self.ids, self.chances = self.tokens, None, None
        self.level = 1
        if 1 not in by_level:
            return
        places = self.places(self.owners())
        self.ids, self.counts = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        for part, at in places.items():
            self.ids[at] = unpack(by_level[1][part]["ids"]) * parts + part
            self.counts[at] = unpack(by_level[1][part]["numbers"])
        self.word_ids = self.ids
        chance = (self.counts + 1) / (sums["tokens"] + sums["words"] + 1)
        self.chances = chance[self.tokens]
        for level in range(2, 1 + max(by_level)):
            self.climb()
            # The last place answers for tokens without an n-gram, whose number is -1.
            ids, chances = np.zeros(len(self.codes), np.int64), np.zeros(len(self.codes) + 1)
            for part, at in self.places(self.owners()).items():
                answer = by_level[level][part]
                counts, contexts = unpack(answer["numbers"]), self.contexts[at]
                run = np.cumsum(np.concatenate([[0], np.diff(contexts) != 0]))
                size, rest = unpack(answer["sizes"])[run], np.frombuffer(answer["rests"], "<f8")[run]
                kept, lower = discounted(counts, sums["factors"][level]), self.lower[at]
                seen = np.where(counts > 0, kept / np.maximum(size, 1), rest * lower)
                chances[at] = np.where(size == 0, lower, seen)
                if answer["ids"] is not None:
                    ids[at] = unpack_rising(answer["ids"])
            self.ids = ids
            self.chances = np.where(self.grams >= 0, chances[self.grams], self.chances)

    def owners(self):
        """The partition that each distinct n-gram of the level belongs to."""
        if self.level == 1:
            return (mixed(self.words) % np.uint64(self.parts)).astype(np.int64)
        key = mixed(self.contexts.astype(np.uint64))
        hot = np.isin(self.contexts, self.sums["hot"][self.level])
        key = np.where(hot, mixed(key + self.lasts.astype(np.uint64)), key)
        return (key % np.uint64(self.parts)).astype(np.int64)

    def places(self, owners):
        """For each partition, the n-grams it owns, in the order in which they are asked for."""
        if not len(owners):
            return {}
        order = np.argsort(owners, kind="stable") if self.level == 1 else np.lexsort((self.lasts, self.contexts, owners))
        found, starts = np.unique(owners[order], return_index=True)
        return dict(zip(found.tolist(), np.split(order, starts[1:]), strict=True))

    def climb(self):
        """Go on to the n-grams that are one word longer."""
        before = np.concatenate([[-1], self.grams[:-1]])
        before[self.first] = -1
        code = np.where(before >= 0, before * len(self.words) + self.tokens, -1)
        valid = code >= 0
        self.codes, inverse = np.unique(code[valid], return_inverse=True)
        context, last = np.divmod(self.codes, len(self.words))
        self.contexts, self.lasts = self.ids[context], self.word_ids[last]
        self.grams = np.full(len(code), -1)
        self.grams[valid] = inverse
        # Every occurrence of an n-gram has the same chance on the level below.
        self.lower = np.zeros(len(self.codes))
        self.lower[inverse] = self.chances[valid]
        self.level += 1

    def train_counts(self):
        size = len(self.words) if self.level == 1 else len(self.codes)
        there = self.grams >= 0
        return np.bincount(self.grams[there], self.trained[there], size).astype(np.int64)


# --- levels -------------------------------------------------------------------------------------------------------

_ASKED = "part long, block long, contexts binary, lasts binary, numbers binary, known binary, lower binary"
_ANSWER = "level int, block long, part long, ids binary, numbers binary, sizes binary, rests binary"


def _ask(block, number):
    """One row per partition that the block asks."""
    counts = block.train_counts()
    for part, at in block.places(block.owners()).items():
        row = {"part": part, "block": number, "numbers": pack(counts[at])}
        if block.level == 1:
            row |= {"lasts": zlib.compress(block.words[at].astype("<u8").tobytes(), 1)}
        else:
            row["contexts"], row["lasts"] = pack_rising(block.contexts[at]), pack(block.lasts[at])
            row["known"], row["lower"] = pack_floats(block.lower[at])
        yield row


def _table(rows, schema):
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[field.split()[1]] for field in schema.split(", ")]
    return pa.table({n: pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)})


def _with_answers(blocks, answers, work):
    """`work(block row, answers)` gives what each block asks for next."""

    def together(left, right):
        told = right.to_pylist()
        return _table([asked for row in left.to_pylist() for asked in work(row, told)], _ASKED)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(together, _ASKED)


def _first_level(blocks, parts, sums):
    """Answers with the number and count of each word; sums gets the number of distinct training words."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows = list(_ask(Block(row, [], sums, parts), row["block"]))
                yield from _table(rows, _ASKED).to_batches()

    def answer(table):
        rows = table.select(["part", "block", "lasts", "numbers"]).to_pylist()
        part = rows[0]["part"]
        codes = [np.frombuffer(zlib.decompress(row["lasts"]), "<u8") for row in rows]
        known, at = np.unique(np.concatenate(codes), return_inverse=True)
        counts = np.bincount(at, np.concatenate([unpack(row["numbers"]) for row in rows])).astype(np.int64)
        # Frequent words get small numbers, as most n-grams consist of them and small numbers take fewer bytes.
        rank = np.empty(len(known), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(known))
        ends = np.cumsum([len(c) for c in codes])
        out = []
        for row, place in zip(rows, np.split(at, ends[:-1]), strict=True):
            ids = pack(rank[place])
            out.append({"level": 1, "block": row["block"], "part": part, "ids": ids, "numbers": pack(counts[place])})
        hot = np.sort(rank[counts * HOT_CONTEXTS > sums["tokens"]])
        out.append({"level": 0, "block": int((counts > 0).sum()), "part": part, "ids": pack_rising(hot * parts + part)})
        return _table(out, _ANSWER)

    asked = blocks.select("block", "words", "tokens", "sizes", "trains").mapInArrow(ask, _ASKED)
    answers = written(asked.groupBy("part").applyInArrow(answer, _ANSWER), "katz-answers")
    # One row per partition: how many words it owns and which of them are hot.
    told = answers.filter("level = 0").select("block", "ids").collect()
    sums["words"] = sum(row["block"] for row in told)
    sums["hot"] = {2: np.concatenate([np.zeros(0, np.int64), *[unpack_rising(bytes(row["ids"])) for row in told]])}
    return answers.filter("level > 0")


def _merge(asked, parts, hot, tokens):
    """The level's table, a row per partition: its n-grams with counts, and where each asking block finds its own.

    `classes` counts the n-grams that occur 1, 2, ... times; `hot_*` are the sums of the partition's hot contexts.
    """
    schema = pa.schema(
        [(name, pa.binary()) for name in ("contexts", "lasts", "counts", "known", "lower", "next_hot")]
        + [("part", pa.int64()), ("blocks", pa.list_(pa.int64())), ("places", pa.list_(pa.binary()))]
        + [("classes", pa.list_(pa.int64())), ("hot_ids", pa.list_(pa.int64())), ("hot_sums", pa.list_(pa.list_(pa.float64())))]
    )
    text = (
        "contexts binary, lasts binary, counts binary, known binary, lower binary, next_hot binary, part long, "
        "blocks array<long>, places array<binary>, classes array<long>, hot_ids array<long>, hot_sums array<array<double>>"
    )

    def merge(table):
        rows = table.to_pylist()
        part = rows[0]["part"]
        sizes = [len(unpack(row["numbers"])) for row in rows]
        context = np.concatenate([unpack_rising(row["contexts"]) for row in rows])
        last = np.concatenate([unpack(row["lasts"]) for row in rows])
        count = np.concatenate([unpack(row["numbers"]) for row in rows])
        lower = np.concatenate([unpack_floats(row["known"], row["lower"]) for row in rows])
        order = np.lexsort((last, context))
        context, last = context[order], last[order]
        fresh = np.concatenate([[True], (context[1:] != context[:-1]) | (last[1:] != last[:-1])])
        counts = np.add.reduceat(count[order], np.flatnonzero(fresh))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(fresh) - 1
        context, last, lower = context[fresh], last[fresh], lower[order][fresh]
        is_hot = np.isin(context, hot)
        ids, which = np.unique(context[is_hot], return_inverse=True)
        seen = counts[is_hot] > 0
        kinds = [counts[is_hot], np.where(counts[is_hot] > MOST_DISCOUNTED, counts[is_hot], 0)]
        kinds += [counts[is_hot] == c for c in range(1, MOST_DISCOUNTED + 1)] + [np.where(seen, lower[is_hot], 0)]
        known, number = pack_floats(lower)
        row = {
            "part": part,
            "contexts": pack_rising(context),
            "lasts": pack(last),
            "counts": pack(counts),
            "known": known,
            "lower": number,
            "next_hot": pack_rising(np.flatnonzero(counts * HOT_CONTEXTS > tokens) * parts + part),
            "blocks": [r["block"] for r in rows],
            "places": [pack_rising(p) for p in np.split(place, np.cumsum(sizes)[:-1])],
            "classes": [int((counts == c).sum()) for c in range(1, MOST_DISCOUNTED + 2)],
            "hot_ids": ids.tolist(),
            "hot_sums": np.stack([np.bincount(which, k, len(ids)) for k in kinds], axis=1).tolist(),
        }
        return pa.Table.from_pylist([row], schema)

    return written(asked.groupBy("part").applyInArrow(merge, text), "katz-level")


def discounts(classes: list[int]) -> np.ndarray:
    """Good-Turing factors of counts 0..MOST_DISCOUNTED from how many n-grams occur 1, 2, ... times.

    Where the corpus is too small for the formula to lie between 0 and 1, half a count is taken off instead.
    """
    n = [0, *classes]
    most = MOST_DISCOUNTED
    factors = np.zeros(most + 1)
    rest = (most + 1) * n[most + 1] / n[1] if n[1] else 0.0
    for c in range(1, most + 1):
        factor = ((c + 1) * n[c + 1] / (c * n[c]) - rest) / (1 - rest) if n[c] and rest < 1 else 0.0
        factors[c] = factor if 0 < factor < 1 else (c - 0.5) / c
    return factors


def discounted(counts, factors):
    return np.where(counts > MOST_DISCOUNTED, counts, counts * factors[np.minimum(counts, MOST_DISCOUNTED)])


def context_sums(contexts, counts, lower, factors, hot):
    """For each context of the n-grams (sorted by context): its size, 0 if training lacks it, and the factor of what it
    leaves to the level below. `hot` has the sums of contexts that other partitions hold too."""
    starts = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
    kept = discounted(counts, factors)
    total, mass = np.add.reduceat(counts, starts).astype(float), np.add.reduceat(kept, starts)
    below = np.add.reduceat(np.where(counts > 0, lower, 0.0), starts)
    for i in np.flatnonzero(np.isin(contexts[starts], list(hot))).tolist():
        sums = hot[int(contexts[starts[i]])]
        total[i], below[i] = sums[0], sums[-1]
        mass[i] = sums[1] + sum(c * factors[c] * sums[1 + c] for c in range(1, MOST_DISCOUNTED + 1))
    # A context none of whose counts is discounted gets one more count, which it leaves to the level below.
    size = np.where(mass >= total, total + 1, total)
    rest = np.where(total > 0, (1 - mass / size) / (1 - below), 0.0)
    return np.where(total > 0, size, 0).astype(np.int64), rest


def _answers(table, level, factors, hot, parts, last_level):
    """What each block asked for: the counts of its n-grams, the sums of their contexts and, below the last level, the
    numbers of the n-grams in the table."""

    def answer(batches):
        for batch in batches:
            for row in batch.to_pylist():
                contexts, counts = unpack_rising(row["contexts"]), unpack(row["counts"])
                sizes, rests = context_sums(contexts, counts, unpack_floats(row["known"], row["lower"]), factors, hot)
                number = np.cumsum(np.concatenate([[0], np.diff(contexts) != 0]))
                out = []
                for block, place in zip(row["blocks"], row["places"], strict=True):
                    at = unpack_rising(place)
                    asked = np.unique(number[at])
                    told = {"level": level, "block": block, "part": row["part"], "numbers": pack(counts[at])}
                    told |= {"sizes": pack(sizes[asked]), "rests": rests[asked].astype("<f8").tobytes()}
                    if not last_level:
                        told["ids"] = pack_rising(at * parts + row["part"])
                    out.append(told)
                yield from _table(out, _ANSWER).to_batches()

    columns = ["part", "contexts", "counts", "known", "lower", "blocks", "places"]
    return table.select(*columns).mapInArrow(answer, _ANSWER)


def score_documents(docs: DataFrame, train, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score, score, one row per row of `docs`.

    `train` is a boolean column over `docs`: the rows that the model learns from; a null counts as true. Tokens are the
    words between ASCII white space, A-Z lower-cased, then one end. n_known counts tokens that training holds,
    base_score is the log10 probability by add-one unigrams, which are also the model's lowest level, and score that of
    the Katz model of `order`; the first words of a text use shorter contexts. A null or empty text is the end alone.
    Repeated rows and null ids stay; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(True)).alias("train"), F.col(text_col).alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = _blocks(rows, parts)
    sums = {"factors": {}, "tokens": blocks.agg(F.coalesce(F.sum("train_tokens"), F.lit(0))).first()[0]}
    answers = _first_level(blocks, parts, sums)
    for level in range(2, order + 1):

        def ask(row, told):
            block = Block(row, told, sums, parts)
            block.climb()
            return list(_ask(block, row["block"]))

        inputs = blocks.select("block", "words", "tokens", "sizes", "trains")
        asked = _with_answers(inputs, answers, ask)
        table = _merge(asked, parts, sums["hot"][level], sums["tokens"])
        # A row of class sums, and the hot contexts: at most HOT_CONTEXTS rows once they are added up.
        classes = table.select([F.sum(F.get("classes", F.lit(i))) for i in range(MOST_DISCOUNTED + 1)]).first()
        factors = sums["factors"][level] = discounts([n or 0 for n in classes])
        each = table.select(F.explode(F.arrays_zip("hot_ids", "hot_sums")).alias("x"))
        fields = [F.sum(F.get("x.hot_sums", F.lit(i))) for i in range(MOST_DISCOUNTED + 3)]
        hot = {row[0]: list(row[1:]) for row in each.groupBy("x.hot_ids").agg(*fields).collect()}
        if level < order:
            told = table.select("next_hot").collect()
            more = [unpack_rising(bytes(row["next_hot"])) for row in told]
            sums["hot"][level + 1] = np.concatenate([np.zeros(0, np.int64), *more])
        answers = answers.unionByName(written(_answers(table, level, factors, hot, parts, level == order), "katz-answers"))

    names = ["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def add_up(left, right):
        tables = []
        for at, row in enumerate(left.to_pylist()):
            block = Block(row, right.to_pylist(), sums, parts)
            base = np.log10((block.counts + 1) / (sums["tokens"] + sums["words"] + 1))[block.tokens]

            def per_document(values, first=block.first):
                return pa.array(np.add.reduceat(values, first))

            columns = [
                left.slice(at, 1).column("doc_ids").combine_chunks().flatten(),
                pa.array(row["trains"]),
                pa.array(block.sizes),
                per_document((block.counts > 0).astype(np.int64)[block.tokens]),
                pa.array(np.full(len(block.sizes), sums["tokens"], np.int64)),
                per_document(base),
                per_document(np.log10(block.chances)),
            ]
            tables.append(pa.Table.from_arrays(columns, names))
        return pa.concat_tables(tables)

    schema = f"doc_id {kind}, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    inputs = blocks.select("block", "words", "tokens", "sizes", "trains", "doc_ids")
    return inputs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, schema)
