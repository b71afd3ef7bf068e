"""Exact Jaccard join of documents on word shingles, for classes of linked documents.

Documents with the same shingles form one class, which is handled once. Classes that share a signature of the
universe partition (partition_index.py) form a bucket. Similar classes always share a bucket, so links need to be
sought inside buckets only, and of a bucket no pair is looked at whose ends are already connected:

1. each class is compared with one leader: of each of its buckets the member that shares buckets with most others,
   and of those leaders the most frequent one;
2. in buckets that are not connected by then, classes of different leaders are compared. Two classes of one leader
   differ at least by what only one of them adds to the leader, and by the difference of how much they lack of it.
   They are compared if that leaves them similar, or if they add a common shingle.

Rows of a frequent signature are combined in the map tasks, where all but one are marked to travel by themselves.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termscale.llm.columns import unused
from termscale.llm.components import components
from termscale.llm.partition_index import signatures
from termscale.llm.shingles import set_code, shingle_codes
from termscale.session import written

SHINGLE = 4
SIMILARITY = (85, 100)
#: A class stays with a leader that it is at least so similar to; other classes lead themselves.
FAMILY = (2, 10)


def _with_sets(texts: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """doc_id, text_key, n_shingles, code (null without shingles), bins, keys, heads: the signatures of each text.

    `bins` counts the shingles by range of their codes; sets differ at least by what their bins differ.

    `heads[i]` is the code itself for the first text with a signature in a batch, else that of the first one.
    """

    def made(batches):
        for batch in batches:
            numbers, codes, bins, keys, seen = [], [], [], [], {}
            for text in batch.column(2).to_pylist():
                found = shingle_codes(text, size)
                numbers.append(len(found))
                codes.append(set_code(found) if len(found) else None)
                bins.append(np.bincount((found >> np.uint64(58)).astype(np.int64), minlength=64).astype(np.int32))
                again = codes[-1] in seen
                seen[codes[-1]] = True
                # Equal sets have equal signatures: one of them is enough.
                keys.append(np.zeros(0, np.int64) if again else signatures(found, *similarity).view(np.int64))
            lengths = np.array([len(k) for k in keys])
            flat = np.concatenate([*keys, np.zeros(0, np.int64)])
            owners = np.repeat(np.array([c or 0 for c in codes], np.int64), lengths)
            _, first, place = np.unique(flat, return_index=True, return_inverse=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(numbers, pa.int64()),
                    pa.array(codes, pa.int64()),
                    pa.array(bins, pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(flat)),
                    pa.ListArray.from_arrays(offsets, pa.array(owners[first[place]] if len(flat) else flat)),
                ],
                ["doc_id", "text_key", "n_shingles", "code", "bins", "keys", "heads"],
            )

    kind = dict(texts.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text_key long, n_shingles long, code long, bins array<int>, keys array<long>, heads array<long>"
    return texts.select("doc_id", "text_key", "text").mapInArrow(made, schema)


def _counted(texts: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles of each text."""

    def count(batches):
        for batch in batches:
            numbers = [len(shingle_codes(text, size)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64())], ["doc_id", "n_shingles"])

    kind = dict(texts.dtypes)["doc_id"]
    return texts.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_shingles long")


def _buckets(sets: DataFrame) -> DataFrame:
    """key, code of the signatures that two classes or more have."""
    rows = sets.select("code", F.explode(F.arrays_zip("keys", "heads")).alias("x"))
    rows = rows.select(F.col("x.keys").alias("key"), "code", F.col("x.heads").alias("head"))
    # What follows another class of its batch knows its leader and can go anywhere.
    follows = F.when(F.col("head") != F.col("code"), F.col("code"))
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key", follows).sortWithinPartitions("key", "code")

    def lead(batches):
        last_key = last_leader = None
        for batch in batches:
            key, code, head = (batch.column(i).to_numpy() for i in range(3))
            apart = head != code
            # The first class of a key is written once for each batch that holds a class behind it.
            out = [(key[apart], code[apart]), (key[apart], head[apart])]
            key, code = key[~apart], code[~apart]
            if len(key):
                fresh = np.concatenate([[True], key[1:] != key[:-1]])
                run = np.cumsum(fresh) - 1
                leaders = code[fresh]
                if key[0] == last_key:
                    leaders[0] = last_leader
                leader = leaders[run]
                follow = code != leader
                runs = np.unique(run[follow])
                out.append((key[follow], code[follow]))
                out.append((key[fresh][runs], leaders[runs]))
                last_key, last_leader = key[-1], leader[-1]
            columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "code"])

    return written(dealt.mapInArrow(lead, "key long, code long").distinct(), "buckets")


def _verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """a, b, n_common, n_all of pairs (a, b) of classes, counted exactly; `texts` has code and text of a class."""
    left = texts.select(F.col("code").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("code").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").distinct().join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def compare(batches):
        kept, kept_set = None, None
        for batch in batches:
            common, every = [], []
            for text_a, text_b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if text_b != kept:
                    kept, kept_set = text_b, shingle_codes(text_b, size)
                codes = shingle_codes(text_a, size)
                common.append(len(np.intersect1d(codes, kept_set, assume_unique=True)))
                every.append(len(codes) + len(kept_set) - common[-1])
            counts = [pa.array(common, pa.int64()), pa.array(every, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts], ["a", "b", "n_common", "n_all"])

    return written(joined.mapInArrow(compare, "a long, b long, n_common long, n_all long"), "compared")


def _apart(table, end, *columns):
    return table.select(*[F.col(c).alias(f"{c}_{end}") for c in columns])


def _could_link(similarity):
    """Whether the bins of two sets leave them similar; true of all similar sets."""
    numerator, denominator = similarity
    apart = F.aggregate(
        F.zip_with("bins_a", "bins_b", lambda a, b: F.abs(a - b)), F.lit(0), lambda total, difference: total + difference
    )
    return apart * (denominator + numerator) <= (F.col("n_a") + F.col("n_b")) * (denominator - numerator)


def _several_roots(state, key):
    """The rows of `state` whose `key` has rows of several components."""
    found = state.groupBy(key).agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most")
    return state.join(found.select(key), key, "left_semi")


def _across_leaders(buckets, state, similarity):
    """Pairs of a bucket, of different components and leaders, that their distances and bins do not rule out."""
    numerator, denominator = similarity
    rows = written(_several_roots(buckets.join(state, "code"), "key"), "unsettled")
    rows = rows.withColumn("far", F.col("adds") + F.col("lacks"))
    columns = ["key", "code", "n", "root", "leader", "centre", "far", "bins"]
    both = _apart(rows, "a", *columns).join(_apart(rows, "b", *columns), F.col("key_a") == F.col("key_b"))
    pairs = both.filter(
        "root_a <> root_b and centre_a <> centre_b and code_a < code_b and code_a <> centre_b and code_b <> centre_a"
    )
    # How far two classes are apart is at least by how much their distances from a common leader differ.
    least = F.when(F.col("leader_a") == F.col("leader_b"), F.abs(F.col("far_a") - F.col("far_b"))).otherwise(F.lit(0))
    allowed = least * (denominator + numerator) <= (F.col("n_a") + F.col("n_b")) * (denominator - numerator)
    pairs = pairs.filter(allowed & _could_link(similarity))
    return pairs.select(F.col("code_a").alias("a"), F.col("code_b").alias("b")).distinct()


def _within_leaders(state, class_texts, size, similarity):
    """Pairs of one leader, of different components, that could be similar.

    Two classes differ by the same shingles as their differences from the leader do. The members of a family that are not in
    the leader's component are farther from it than similar sets are, so a similar pair has common
    differences: at least half of what both differences together exceed the distance of similar sets by. The rarest
    differences of each class come first, and a pair is made only where it meets among so many of the first that similar sets must
    meet there; what a whole family adds or lacks comes last and is no key.
    """
    numerator, denominator = similarity
    family = written(_several_roots(state.filter("code <> centre"), "centre"), "families")
    texts = class_texts.select("code", "text")
    beside = family.select("code", "centre").join(texts, "code")
    beside = beside.join(texts.select(F.col("code").alias("centre"), F.col("text").alias("centre_text")), "centre")

    def differences(batches):
        kept, kept_set = None, None
        for batch in batches:
            found = []
            for text, centre in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if centre != kept:
                    kept, kept_set = centre, shingle_codes(centre, size)
                found.append(np.setxor1d(shingle_codes(text, size), kept_set, assume_unique=True).view(np.int64))
            columns = [*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["centre", "code", "differs"])

    beside = beside.select("centre", "code", "text", "centre_text")
    found = beside.mapInArrow(differences, "centre long, code long, differs array<long>")
    found = found.select("centre", "code", F.explode("differs").alias("shingle"))
    found = written(found.join(family.select("code", "root", "n", (F.col("adds") + F.col("lacks")).alias("far")), "code"), "differences")
    common = found.groupBy("centre", "shingle").agg(
        F.count(F.lit(1)).alias("times"), F.min("root").alias("least"), F.max("root").alias("most")
    )
    placed = found.join(common, ["centre", "shingle"])
    order = Window.partitionBy("code").orderBy("times", "shingle")
    placed = placed.withColumn("place", F.row_number().over(order))
    # Similar sets of n and of at most n * denominator / numerator shingles differ by no more than this.
    distance = F.floor(F.col("n") * (denominator - numerator) / F.lit(float(numerator)) + F.lit(1e-9))
    placed = placed.filter((F.col("place") <= distance + 1) & (F.col("least") < F.col("most")))
    columns = ["centre", "shingle", "code", "root", "n", "far", "place"]
    placed = written(placed.select(*columns), "rare-differences")
    same = (F.col("centre_a") == F.col("centre_b")) & (F.col("shingle_a") == F.col("shingle_b"))
    # The common differences that the two need. One of them lies among as many rarest ones of either as would leave too few.
    excess = (F.col("far_a") + F.col("far_b")) * (denominator + numerator)
    excess -= (F.col("n_a") + F.col("n_b")) * (denominator - numerator)
    needed = F.greatest(F.lit(1), F.ceil(excess / F.lit(2.0 * (denominator + numerator)) - F.lit(1e-9)))
    met = F.lit(True)
    for end in "ab":
        met &= F.col(f"place_{end}") <= F.col(f"far_{end}") - needed + 1
    pairs = _apart(placed, "a", *columns).join(_apart(placed, "b", *columns), same & (F.col("root_a") < F.col("root_b")) & met)
    pairs = pairs.select("code_a", "code_b").distinct()
    for end in "ab":
        members = family.select(F.col("code").alias(f"code_{end}"), F.col("n").alias(f"n_{end}"), F.col("bins").alias(f"bins_{end}"))
        pairs = pairs.join(members, f"code_{end}")
    return pairs.filter(_could_link(similarity)).select(F.col("code_a").alias("a"), F.col("code_b").alias("b"))


def jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    similarity: tuple[int, int] = SIMILARITY,
) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of `docs`.

    Two documents link when similarity[1] * |common shingles| >= similarity[0] * |all shingles|; component_id is the
    smallest doc_id that links reach. Null, empty and wordless texts have no shingles and link with nothing; a text of
    fewer words than `size` is one shingle. Repeated rows stay and are of one component; different texts of one id are
    judged apart. A row with a null id has a null
    component and connects nothing; its shingles are counted. Other columns are not read. An empty table gives no rows.
    """
    return _classified(docs, id_col, text_col, size, similarity).drop("text_key")


def _text_key(text):
    """Tells texts of one id apart."""
    return F.xxhash64(text)


def _classified(docs, id_col="doc_id", text_col="text", size=SHINGLE, similarity=SIMILARITY):
    """The rows of `jaccard_classes` with their text_key."""
    numerator, denominator = similarity
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).alias("doc_id"), _text_key(text).alias("text_key"), text.alias("text"))
    # Rows with a null id connect nothing, so they must not be the ones that carry signatures for others of a batch.
    sets = _with_sets(texts.filter("doc_id is not null"), size, similarity)
    rows = written(sets, "signatures")
    known = rows.filter("code is not null")
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    classes = known.groupBy("code").agg(first, F.min("n_shingles").alias("n"), F.min("bins").alias("bins"))
    classes = classes.select("code", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"), "n", "bins")
    classes = written(classes, "classes")
    buckets = _buckets(known.select("code", "keys", "heads").filter("size(keys) > 0"))

    # The texts of the classes that share a bucket, by one row of each; an id can have several texts.
    shared = buckets.select("code").distinct().join(classes, "code")
    shared = shared.withColumnsRenamed({"first_id": "doc_id", "first_key": "text_key"})
    class_texts = texts.join(shared, ["doc_id", "text_key"]).select("code", "n", "bins", "text").dropDuplicates(["code"])
    class_texts = written(class_texts, "class-texts")
    sizes = class_texts.select("code", "n", "bins")

    # 1. Each class and its most frequent leader.
    widths = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("width"))
    fame = buckets.join(widths, "key").groupBy("code").agg(F.sum("width").alias("fame"))
    placed = written(buckets.join(fame, "code"), "famed-buckets")
    first = placed.groupBy("key").agg(F.max(F.struct("fame", "code"))["code"].alias("leader"))
    met = placed.join(first, "key").filter("code <> leader").groupBy("code", "leader").agg(F.count(F.lit(1)).alias("times"))
    chosen = met.groupBy("code").agg(F.max(F.struct("times", "leader"))["leader"].alias("b"))
    compared = _verified(chosen.select(F.col("code").alias("a"), "b"), class_texts, size)
    similar = F.col("n_common") * denominator >= F.col("n_all") * numerator
    led = compared.filter(similar).select("a", "b")
    roots = components(led)

    # 2. Buckets and leaders that hold several components.
    measured = compared.select(F.col("a").alias("code"), F.col("b").alias("leader"), "n_common", "n_all")
    state = sizes.join(roots.withColumnRenamed("node", "code"), "code", "left").join(measured, "code", "left")
    near = F.col("n_common") * FAMILY[1] >= F.col("n_all") * FAMILY[0]
    state = state.select(
        "code",
        "n",
        "bins",
        F.coalesce("root", "code").alias("root"),
        F.coalesce("leader", "code").alias("leader"),
        F.when(near, F.col("leader")).otherwise(F.col("code")).alias("centre"),
        (F.col("n") - F.coalesce("n_common", "n")).alias("adds"),
        (F.coalesce("n_all", "n") - F.col("n")).alias("lacks"),
    )
    state = written(state, "class-state")
    more = [
        _verified(pairs, class_texts, size).filter(similar).select("a", "b")
        for pairs in (
            _across_leaders(placed.select("key", "code"), state, similarity),
            _within_leaders(state, class_texts, size, similarity),
        )
    ]

    links = led.union(more[0]).union(more[1])
    # A node is a class, not an id: an id with several texts does not connect them.
    names = classes.select("code", F.struct("first_id", "code").alias("node"))
    links = links.join(names.toDF("a", "node_a"), "a").join(names.toDF("b", "node_b"), "b")
    linked = components(links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    linked = linked.select(F.col("node.code").alias("code"), F.col("root.first_id").alias("component_id"))
    named = classes.select("code", "first_id").join(linked, "code", "left")
    named = written(named.select("code", F.coalesce("component_id", "first_id").alias("component_id")), "class-components")
    # Rows that link with nothing take no part in the join, so no null key gathers them.
    alone = rows.filter("code is null").select("doc_id", "n_shingles")
    alone = alone.unionByName(_counted(texts.filter("doc_id is null"), size))
    alone = alone.select("doc_id", F.lit(None).cast("long").alias("text_key"), "n_shingles", F.col("doc_id").alias("component_id"))
    joined = known.select("doc_id", "text_key", "n_shingles", "code").join(named, "code")
    return joined.select("doc_id", "text_key", "n_shingles", "component_id").unionByName(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, with all their columns, whose id is that of their component; rows with a null id stay."""
    found = _classified(docs, id_col, text_col, **options).filter("component_id <> doc_id")
    lost_id, lost_key = unused(docs, "lost_id"), unused(docs, "lost_key")
    lost = found.select(F.col("doc_id").alias(lost_id), F.col("text_key").alias(lost_key)).distinct()
    same = (F.col(id_col) == F.col(lost_id)) & (_text_key(F.col(text_col)) == F.col(lost_key))
    return docs.join(lost, same, "left_anti")
