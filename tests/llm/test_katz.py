import math
import random
import zlib
from collections import Counter

import pytest
from odd import no_documents, odd_documents
from pyspark.sql import functions as F

from termscale.llm import katz
from termscale.llm.katz import MOST_DISCOUNTED, discounts, score_documents
from termscale.llm.queries import op2_katz
from termscale.session import written

WORDS = ["the", "of", "Tree", "tree", "bark", "leaf", "root", "é"]


def tokens_of(text):
    folded = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [w.decode() for w in folded.encode().split()] + ["</end>"]


class BruteForce:
    """The model from its definition, with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            words = tokens_of(text)
            for n in range(1, order + 1):
                self.counts[n].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        self.total, self.size = sum(self.counts[1].values()), len(self.counts[1])
        self.factors = {}
        for n in range(2, order + 1):
            found = Counter(self.counts[n].values())
            self.factors[n] = discounts([found[c] for c in range(1, MOST_DISCOUNTED + 2)])

    def chance(self, gram):
        n = len(gram)
        if n == 1:
            return (self.counts[1][gram] + 1) / (self.total + self.size + 1)
        followers = {g: c for g, c in self.counts[n].items() if g[:-1] == gram[:-1]}
        if not followers:
            return self.chance(gram[1:])
        kept = {g: c if c > MOST_DISCOUNTED else c * self.factors[n][c] for g, c in followers.items()}
        size = sum(followers.values()) + (sum(kept.values()) >= sum(followers.values()))
        if gram in kept:
            return kept[gram] / size
        rest = (1 - sum(kept.values()) / size) / (1 - sum(self.chance(g[1:]) for g in kept))
        return rest * self.chance(gram[1:])

    def score(self, text):
        words = tokens_of(text)
        grams = [tuple(words[max(0, i - self.order + 1) : i + 1]) for i in range(len(words))]
        return sum(math.log10(self.chance(g)) for g in grams)


def corpus(seed, size):
    draw = random.Random(seed)
    return [" ".join(draw.choices(WORDS, weights=range(len(WORDS), 0, -1), k=draw.randint(0, 9))) for _ in range(size)]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("hot", [1000, 8])
def test_against_brute_force(spark, monkeypatch, order, hot):
    # With one token in eight as the bound there are hot contexts.
    monkeypatch.setattr(katz, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 40)
    texts = corpus(order, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in score_documents(docs, F.col("doc_id") % 4 != 1, order).collect()}
    model = BruteForce([t for i, t in enumerate(texts) if i % 4 != 1], order)
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        words = tokens_of(text)
        assert (rows[i].n_tokens, rows[i].train_tokens) == (len(words), model.total)
        assert rows[i].n_known == sum((w,) in model.counts[1] for w in words)
        assert rows[i].base_score == pytest.approx(sum(math.log10(model.chance((w,))) for w in words))
        assert rows[i].score == pytest.approx(model.score(text), rel=1e-9)
        assert rows[i].trained == (i % 4 != 1)


def test_chances_add_up_to_one():
    model = BruteForce(corpus(5, 60), 3)
    unknown = ("never seen",)
    for context in [(), ("the",), ("the", "of"), ("bark", "leaf"), ("zzz",)]:
        total = sum(model.chance((*context, *word)) for word in [*model.counts[1], unknown])
        assert total == pytest.approx(1)


def test_odd_rows(spark):
    rows = score_documents(odd_documents(spark), F.lit(None).cast("boolean")).collect()
    assert len(rows) == 13 and all(r.score < 0 and r.trained for r in rows)
    empty = [r.n_tokens for r in rows if r.doc_id in (3, 4, 5)]
    assert empty == [1, 1, 1]
    assert score_documents(no_documents(spark), F.lit(True)).count() == 0


def test_table_and_held_out_rows(spark):
    rows = op2_katz(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    trained = [r for r in rows if not r.held_out]
    assert sum(r.n_tokens for r in trained) == trained[0].train_tokens
    assert sum(r.score for r in trained) > sum(r.base_score for r in trained)


def test_frequent_words_have_small_numbers(spark, monkeypatch):
    answers = []

    def noted(df, label, by=()):
        made = written(df, label, by)
        answers.append(made) if label == "katz-answers" else None
        return made

    monkeypatch.setattr(katz, "written", noted)
    draw = random.Random(7)
    texts = [" ".join(f"w{int(draw.paretovariate(0.7))}" for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    katz.score_documents(docs, F.lit(True)).collect()
    counts = {}
    for row in answers[0].filter("level = 1").collect():
        for number, count in zip(katz.unpack(bytes(row.ids)).tolist(), katz.unpack(bytes(row.numbers)).tolist(), strict=True):
            assert counts.setdefault(row.part, {}).setdefault(number, count) == count
    assert counts
    for found in counts.values():
        assert sorted(found) == list(range(len(found)))
        assert [found[n] for n in sorted(found)] == sorted(found.values(), reverse=True)
