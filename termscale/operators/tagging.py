"""Tags from context: a hidden Markov model learnt by aggregation from tagged sentences, and Viterbi within a row.

Transitions of tags are a small matrix and become constants of the plan. What a word or an ending says about tags is a
table, as large as the vocabulary, that is joined with the tokens: broadcast if it is small, else by word. The best path of
a sentence is one pass over its array of candidates; a word has the few tags it was seen with, so the pass is short.
"""

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termscale.functions.text import literal, once
from termscale.session import written
from termscale.sources.local import broadcast_if_small

#: Longest ending, and the greatest count of a word whose endings stand for unknown words.
ENDING, RARE = 3, 10
#: Added to each count of a transition.
SMOOTHING = 1.0
#: Tokens that are tagged together; a longer sentence is tagged in pieces of this length, as paths grow with their square.
PIECE = 1000
#: A set of tags is no vocabulary; more than this are refused.
MOST_TAGS = 500

CANDIDATES = "array<struct<tag: int, score: double>>"


@dataclass
class Tagger:
    """tags: names, by number; transitions: log chances by tag before (the last row: at the start) and tag; words and endings:
    (surface or ending, candidates), written tables. `candidates` is an array of (tag, score) in order of the tags."""

    tags: list[str]
    transitions: list[list[float]]
    words: DataFrame
    endings: DataFrame


def _candidates(counts: DataFrame, key: str, score) -> DataFrame:
    entry = F.struct(F.col("number").alias("tag"), score.alias("score"))
    return counts.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("candidates"))


def train_tagger(sentences: DataFrame, smoothing: float = SMOOTHING) -> Tagger:
    """A tagger from `sentences` with a column `tokens`, array<struct<surface, tag>>.

    Everything is counted by aggregates with map-side combine: neighbours of tags, words with tags, endings of rare words
    with tags. A word scores log P(word | tag) with each tag it was seen with; an unknown word, by its longest
    known ending of up to three characters, log P(tag | ending) / P(tag). Null tokens, surfaces and tags are left out.
    """
    spark = sentences.sparkSession
    usable = "filter(tokens, t -> t.surface IS NOT NULL AND t.tag IS NOT NULL)"
    entry = "struct(CASE WHEN i > 0 THEN kept[i - 1].tag END AS before, t.surface AS surface, t.tag AS tag)"
    entries = f"transform(array({usable}), kept -> transform(kept, (t, i) -> {entry}))[0]"
    # One pass over the tokens serves words and transitions. A filter on the size of the array would be pushed below what makes
    # it, and so make it again; the outer form has none.
    tokens = sentences.selectExpr(f"explode_outer({entries}) AS t").filter("t.tag IS NOT NULL").select("t.*")
    seen = written(tokens.groupBy("before", "surface", "tag").agg(F.count(F.lit(1)).alias("n")), "tag-pairs")
    counts = written(seen.groupBy("surface", "tag").agg(F.sum("n").alias("n")), "word-tags")
    totals = counts.groupBy("tag").agg(F.sum("n").alias("total")).orderBy("tag").limit(MOST_TAGS + 1).collect()
    if len(totals) > MOST_TAGS:
        raise ValueError(f"more than {MOST_TAGS} tags")
    tags = [row.tag for row in totals]
    number = {tag: i for i, tag in enumerate(tags)}
    pairs = seen.groupBy("before", "tag").agg(F.sum("n").alias("n")).collect()
    followed = {(row.before, row.tag): row.n for row in pairs}
    transitions = []
    for before in [*tags, None]:
        row = [followed.get((before, tag), 0) + smoothing for tag in tags]
        transitions.append([math.log(n / sum(row)) for n in row])

    names = F.broadcast(
        spark.createDataFrame([(row.tag, number[row.tag], row.total) for row in totals], "tag string, number int, total long")
    )
    counts = counts.join(names, "tag")
    words = _candidates(counts, "surface", F.log(F.col("n") / F.col("total")))
    # Endings of words that are rare in all; of all words together, the empty ending.
    size = F.sum("n").over(Window.partitionBy("surface"))
    rare = counts.withColumn("size", size).filter(F.col("size") <= RARE)
    cut = "transform(sequence(1, %d), k -> right(surface, k))" % ENDING
    ends = rare.selectExpr("number", "n", "total", f"explode(array_distinct(filter({cut}, e -> length(e) < length(surface)))) AS ending")
    every = counts.selectExpr("number", "n", "total", "'' AS ending")
    ends = ends.unionByName(every).groupBy("ending", "number", "total").agg(F.sum("n").alias("n"))
    n_all = sum(row.total for row in totals) or 1
    whole = F.sum("n").over(Window.partitionBy("ending"))
    ends = ends.withColumn("chance", F.col("n") / whole)
    endings = _candidates(ends, "ending", F.log(F.col("chance") / (F.col("total") / F.lit(float(n_all)))))
    return Tagger(tags, transitions, written(words, "tag-words"), written(endings, "tag-endings"))


def _best_path(candidates: str, transitions: str, start: int) -> str:
    """The number of the chosen candidate at each place: the path of the highest score, of equals the lowest tags from the end on."""
    first = f"transform({candidates}[0], c -> struct(c.tag AS tag, {transitions}[{start}][c.tag] + c.score AS score))"
    way = f"transform(state.scores, (s, j) -> struct(s.score + {transitions}[s.tag][c.tag] AS score, -j AS j))"
    best = f"transform(here, c -> struct(c.tag AS tag, c.score AS own, array_max({way}) AS way))"
    step = once(
        best,
        lambda it: f"named_struct('scores', transform({it}, b -> struct(b.tag AS tag, b.way.score + b.own AS score)),"
        f" 'back', concat(state.back, array(transform({it}, b -> -b.way.j))))",
    )
    begun = f"named_struct('scores', {first}, 'back', CAST(array() AS array<array<int>>))"
    forward = f"aggregate(slice({candidates}, 2, size({candidates})), {begun}, (state, here) -> {step})"
    last = "-array_max(transform(walk.scores, (s, j) -> struct(s.score AS score, -j AS j))).j"
    # Back from the last place: the numbers are gathered in reverse.
    chosen = f"aggregate(reverse(walk.back), array({last}), (path, back) -> concat(path, array(back[element_at(path, -1)])))"
    return f"transform(array({forward}), walk -> reverse({chosen}))[0]"


def tag_sentences(sentences: DataFrame, tagger: Tagger) -> DataFrame:
    """`sentences` (keys, and `surfaces`, array<string>) with `tags`, array<string> of the same length; one row per row.

    A null surface has a null tag and does not part its neighbours. A null or empty array has no tags. Tokens are joined
    with the tables of the tagger and gathered again by sentence, so a group is one sentence of at most `PIECE` tokens.
    """
    keys = [c for c in sentences.columns if c != "surfaces"]
    rows = written(sentences.withColumn("row_id", F.monotonically_increasing_id()), "sentences")
    kept = "filter(transform(surfaces, (s, i) -> struct(s AS surface, i AS i)), t -> t.surface IS NOT NULL)"
    tokens = rows.selectExpr("row_id", f"posexplode({kept}) AS (place, t)").selectExpr("row_id", "place", "t.surface", "t.i")
    found = tokens.join(broadcast_if_small(tagger.words), "surface", "left")
    choices = ["candidates"]
    for k in range(ENDING, -1, -1):
        own = tagger.endings.filter(F.length("ending") == k)
        own = broadcast_if_small(own.select(F.col("ending").alias(f"e{k}"), F.col("candidates").alias(f"c{k}")))
        # Known words look for no ending; the empty one is for all others.
        open_word = F.col("candidates").isNull() & (F.length("surface") > k if k else F.lit(True))
        found = found.withColumn("end", F.when(open_word, F.right("surface", F.lit(k))))
        found = found.join(own, F.col("end") == F.col(f"e{k}"), "left").drop("end", f"e{k}")
        choices.append(f"c{k}")
    found = found.selectExpr("row_id", f"place div {PIECE} AS piece", "place", "i", f"coalesce({', '.join(choices)}) AS candidates")
    entry = F.sort_array(F.collect_list(F.struct("place", "i", "candidates")))
    pieces = found.groupBy("row_id", "piece").agg(entry.alias("tokens"))
    matrix = "array(" + ", ".join(f"array({', '.join(f'CAST({x!r} AS DOUBLE)' for x in row)})" for row in tagger.transitions) + ")"
    path = _best_path("lattice", matrix, len(tagger.tags))
    names = f"array({', '.join(literal(tag) for tag in tagger.tags)})"
    inner = f"transform(array(transform(tokens, t -> t.candidates)), lattice -> {path})[0]"
    named = f"zip_with(tokens, {inner}, (t, c) -> struct(t.i AS i, {names}[t.candidates[c].tag] AS tag))"
    tagged = pieces.selectExpr("row_id", "piece", f"{named} AS chosen")
    in_order = F.array_sort(F.collect_list(F.struct("piece", "chosen")))["chosen"]
    whole = tagged.groupBy("row_id").agg(F.flatten(in_order).alias("chosen"))
    # In order of their places, with nulls where the surface was null.
    some = "transform(array(map_from_entries(chosen)), at -> transform(sequence(0, size(surfaces) - 1), i -> at[i]))[0]"
    filled = f"CASE WHEN size(chosen) = size(surfaces) THEN transform(chosen, c -> c.tag) ELSE {some} END"
    joined = rows.join(whole, "row_id", "left")
    none = "CASE WHEN surfaces IS NOT NULL THEN transform(surfaces, s -> CAST(NULL AS STRING)) END"
    return joined.selectExpr(*keys, "surfaces", f"CASE WHEN chosen IS NULL THEN {none} ELSE {filled} END AS tags")
