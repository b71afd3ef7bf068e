"""The tagger against all paths of short sentences, and counts by definition."""

import itertools
import math
import random
from collections import Counter

import pytest

from termscale.operators import tagging as G

WORDS = {"the": "D", "a": "D", "run": "NV", "runs": "NV", "dog": "N", "light": "NVJ", "old": "JN", "fast": "JR", "eat": "V"}
FOLLOWS = {"": "DJN", "D": "NJ", "N": "VRN", "V": "DRJ", "J": "NN", "R": "VD"}


def drawn(draw, n):
    rows = []
    for _ in range(n):
        tag, sentence = "", []
        for _ in range(draw.randint(1, 7)):
            tag = draw.choice(FOLLOWS[tag])
            fits = [w for w, tags in WORDS.items() if tag in tags] + [f"zz{draw.choice('abc')}{tag.lower()}y"]
            sentence.append((draw.choice(fits), tag))
        rows.append(sentence)
    return rows


@pytest.fixture(scope="module")
def corpus():
    return drawn(random.Random(3), 300)


@pytest.fixture(scope="module")
def tagger(spark, corpus):
    rows = [([*s, (None, "N"), ("dog", None)],) for s in corpus] + [([],), (None,)]
    return G.train_tagger(spark.createDataFrame(rows, "tokens array<struct<surface: string, tag: string>>").repartition(5))


def by_definition(corpus):
    tags = sorted({t for s in corpus for _, t in s})
    pairs = Counter(p for s in corpus for p in zip([None, *[t for _, t in s]], [t for _, t in s]))
    words = Counter(x for s in corpus for x in s)
    total, size = Counter(t for s in corpus for _, t in s), Counter(w for s in corpus for w, _ in s)
    moves = {}
    for before in [*tags, None]:
        whole = sum(pairs[before, t] + 1 for t in tags)
        for t in tags:
            moves[before, t] = math.log((pairs[before, t] + 1) / whole)
    ends = Counter()
    for (word, tag), n in words.items():
        ends["", tag] += n
        if size[word] <= 10:
            for k in range(1, min(3, len(word) - 1) + 1):
                ends[word[-k:], tag] += n

    def scores(word):
        if word in size:
            return {t: math.log(words[word, t] / total[t]) for t in tags if words[word, t]}
        for k in range(min(3, len(word) - 1), -1, -1):
            end = word[len(word) - k :]
            whole = sum(ends[end, t] for t in tags)
            if whole:
                n = sum(total.values())
                return {t: math.log(ends[end, t] / whole / (total[t] / n)) for t in tags if ends[end, t]}
        raise AssertionError

    def score(sentence, path):
        return sum(moves[b, t] + scores(w)[t] for b, t, w in zip([None, *path], path, sentence))

    return scores, score


def test_every_path_of_short_sentences(spark, corpus, tagger):
    draw = random.Random(8)
    scores, score = by_definition(corpus)
    sentences = [[w for w, _ in s] for s in drawn(draw, 40)]
    sentences += [[draw.choice([*WORDS, "newly", "x", "qqq", "zzany"]) for _ in range(draw.randint(1, 6))] for _ in range(40)]
    table = spark.createDataFrame(list(enumerate(sentences)), "id int, surfaces array<string>")
    rows = {r.id: r for r in G.tag_sentences(table, tagger).collect()}
    for i, sentence in enumerate(sentences):
        best = max(score(sentence, path) for path in itertools.product(*[scores(w) for w in sentence]))
        assert score(sentence, rows[i].tags) == pytest.approx(best, abs=1e-9)


def test_context_decides(spark, tagger):
    rows = spark.createDataFrame([(1, ["the", "light"]), (2, ["dog", "light", "the", "dog"])], "id int, surfaces array<string>")
    second = {r.id: r.tags[1] for r in G.tag_sentences(rows, tagger).collect()}
    assert second[1] in "JN" and second[2] == "V"


def test_odd_sentences(spark, tagger, monkeypatch):
    rows = [(1, ["the", None, "dog"]), (2, []), (3, None), (4, [None]), (5, ["the", "dog", "runs"] * 40), (5, ["the"]), (None, ["dog"])]
    table = spark.createDataFrame(rows, "row_id int, surfaces array<string>").withColumnRenamed("row_id", "key")
    found = sorted(((r.key, r.surfaces, r.tags) for r in G.tag_sentences(table, tagger).collect()), key=str)
    whole = {str((k, s)): t for k, s, t in found}
    assert whole[str((1, ["the", None, "dog"]))] == ["D", None, "N"]
    assert whole[str((2, []))] == [] and whole[str((3, None))] is None and whole[str((4, [None]))] == [None]
    assert len(whole[str((5, ["the", "dog", "runs"] * 40))]) == 120 and len(found) == len(rows)
    monkeypatch.setattr(G, "PIECE", 30)
    again = {str((r.key, r.surfaces)): r.tags for r in G.tag_sentences(table, tagger).collect()}
    assert again[str((5, ["the", "dog", "runs"] * 40))] == whole[str((5, ["the", "dog", "runs"] * 40))]
    assert G.tag_sentences(table.limit(0), tagger).count() == 0


def test_too_many_tags_are_refused(spark):
    rows = spark.range(600).selectExpr("array(struct('w' AS surface, string(id) AS tag)) AS tokens")
    with pytest.raises(ValueError):
        G.train_tagger(rows)


def test_tokens_are_made_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(G, "written", lambda df, label, write=G.written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, label))
    texts = spark.range(9).selectExpr("concat('the dog ', id) AS text", "'N' AS tag").repartition(2)
    G.train_tagger(texts.selectExpr("transform(split(text, ' '), s -> struct(s AS surface, tag)) AS tokens"))
    assert sum(plan.count("split(") for plan in plans) == 1
