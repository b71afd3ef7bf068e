"""Abbreviations by the published formula, and sentences that go on behind them."""

import math
import random

import pytest

from termscale.functions import text as T
from termscale.operators import abbreviations as A

PIECES = ["Dr. Smith", "e.g. this", "(approx. five)", "the end.", "Stop!", "no mark", "He said.", "etc.", '"Prof. X."', "v1.2", "...", "a\n", "the end was", "so it was said"]


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(4)
    texts = [" ".join(draw.choice(PIECES) for _ in range(draw.randint(0, 30))) for _ in range(200)]
    texts += [None, "", "  ", ".", "Dr.", "Dr.  ", "a. b. c. Dr. x", "One. Dr. two.\n\nThree", "Mid e.g.) x. Y"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)


def test_scores_by_definition(spark, docs):
    counts = {}
    for row in docs.collect():
        for piece in (row.text or "").split():
            word = piece.lstrip("([{<\"'").rstrip(")]}>\"',;:").lower()
            stop = word.endswith(".")
            word = word[:-1] if stop else word
            if any(c.isalpha() for c in word):
                n = counts.setdefault(word, [0, 0])
                n[0] += stop
                n[1] += 1
    p = sum(s for s, _ in counts.values()) / sum(n for _, n in counts.values())
    expected = {}
    for word, (s, n) in counts.items():
        ratio = -2 * (s * math.log(p) + (n - s) * math.log(1 - p) - s * math.log(0.99) - (n - s) * math.log(1 - 0.99))
        letters = len(word.replace(".", ""))
        score = ratio * math.exp(-letters) * (word.count(".") + 1) / letters ** (n - s)
        if s and score >= 0.3:
            expected[word] = pytest.approx(score)
    found = {r.word: r.score for r in A.abbreviations(docs).collect()}
    assert found == expected and {"e.g", "dr", "etc"} <= set(found) and "end" not in found


def split_by_definition(pieces, known):
    made, going = [], False
    for piece in pieces:
        made.append((made.pop() if going else "") + piece)
        last = piece.rstrip(" \t\r\n").replace("\t", " ").replace("\r", " ").replace("\n", " ").rsplit(" ", 1)[-1]
        going = last.endswith(".") and last[:-1].lstrip("([{<\"'").lower() in known
    return made


def test_sentences_go_on(spark, docs):
    known = spark.createDataFrame([("dr",), ("e.g",), ("prof",), ("prof",)], "word string")
    pieces = docs.selectExpr("doc_id", f"regexp_extract_all(coalesce(text, ''), {T.literal(T.SENTENCE)}, 0) AS p").collect()
    plain = {r.doc_id: r.s for r in docs.selectExpr("doc_id", f"{T.sentences('text')} AS s").collect()}
    for limit in (100, 0):
        rows = {r.doc_id: r.sentences for r in A.sentence_arrays(docs, known, max_constants=limit).collect()}
        for doc_id, own in pieces:
            assert [s.rstrip() for s in rows[doc_id]] == [s.rstrip() for s in split_by_definition(own, {"dr", "e.g", "prof"})]
        assert len(rows) == len(pieces)
    none = {r.doc_id: r.sentences for r in A.sentence_arrays(docs, known.limit(0)).collect()}
    assert none == plain
    sample = spark.createDataFrame([("I met Dr. Who. See e.g. this! Then Prof. X left. ",)], "text string")
    assert A.sentence_arrays(sample, known).first().sentences == ["I met Dr. Who.", "See e.g. this!", "Then Prof. X left."]


def test_no_texts(spark, docs):
    assert A.abbreviations(docs.limit(0)).count() == 0
    assert A.abbreviations(docs.filter("text = '.'")).count() == 0
    assert A.sentence_arrays(docs.limit(0), A.abbreviations(docs)).count() == 0
