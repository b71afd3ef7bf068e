"""Text functions and the analyser against plain Python and the sample records."""

import random
import re
import time
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from termscale import rules
from termscale.functions import text as T
from termscale.operators import index as I
from termscale.operators import lexicon as L
from termscale.operators import tokens as K
from termscale.sources import local


def evaluate(spark, expression, values):
    """The expression over a column `x`, one result per value."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, x STRING")
    return [r.y for r in rows.selectExpr("i", f"{expression} AS y").orderBy("i").collect()]


def replaced(text):
    for search, replacement in rules.contraction_rules():
        text = text.replace(search, replacement)
    return text


CONTRACTIONS = {
    "she'll say it's the author's": "she shall say it is the author is",
    "let's": "let is",
    "'data' DON'T": " hadata' DON'T",
    "y'all're here": "you all're here",
    "i'Didn'tShe'll've": "i hadid notShe shall have",
    "don’t": "don’t",
    "": "",
}


def test_rule_table_sizes():
    assert len(rules.contraction_rules()) == 236
    assert len(rules.stop_words()) == len(set(rules.stop_words())) == 181
    surfaces = [row[0] for row in rules.lexicon_rows()]
    assert len(surfaces) == len(set(surfaces)) < 200


def test_contractions(spark):
    assert evaluate(spark, T.expand_contractions("x"), CONTRACTIONS) == list(CONTRACTIONS.values())


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.lists(st.sampled_from([k for k, _ in rules.contraction_rules()] + ["a", "I", " ", "'", "n't"]), max_size=6),
        min_size=20,
        max_size=40,
    )
)
def test_contractions_are_sequential_replacement(spark, pieces):
    texts = ["".join(p) for p in pieces]
    assert evaluate(spark, T.expand_contractions("x"), texts) == [replaced(t) for t in texts]


def test_digits(spark):
    every = [chr(c) for c in range(0x110000) if chr(c).isdigit()]
    others = ["½", "a", "Ⅷ", "一", "٪"]
    got = evaluate(spark, T.strip_digits("x"), ["a1b²c٣d①e½", "12 ab 3", *every, *others])
    assert got[:2] == ["abcde½", " ab "]
    assert len(every) > 700 and got[2 : 2 + len(every)] == [""] * len(every)
    assert got[2 + len(every) :] == others


def test_sentences(spark):
    texts = ["One. Two!  Three", "v1.2 is (out.) now", "", None, "End.", "...", "A?\nB."]
    assert evaluate(spark, T.sentences("x"), texts) == [
        ["One.", "Two!", "Three"],
        ["v1.2 is (out.)", "now"],
        [],
        [],
        ["End."],
        ["..."],
        ["A?", "B."],
    ]
    quoted = 'He left (early.) Then "why?" she asked [twice!] ... No mark '
    assert evaluate(spark, T.sentences("x"), [quoted]) == [
        ["He left (early.)", 'Then "why?"', "she asked [twice!]", "...", "No mark "]
    ]
    assert evaluate(spark, T.without_end_mark("x"), ["a (b.)", 'c?!"', "d. e", ""]) == ["a (b", "c", "d. e", ""]


LAZY_SENTENCE = re.compile(r"""(.+?(?:[.!?]+["')\]}>]*|\Z))(?:[ \t\r\n]+|\Z)""", re.DOTALL)
LAZY_END_MARK = re.compile(r"""[.!?]+["')\]}>]*\Z""")


def test_sentences_equal_the_lazy_definition(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choice(".!?\")' \n\tab") for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    assert evaluate(spark, T.sentences("x"), texts) == [LAZY_SENTENCE.findall(text) for text in texts]
    assert evaluate(spark, T.without_end_mark("x"), texts) == [LAZY_END_MARK.sub("", text) for text in texts]


# Texts that make a backtracking pattern deep or slow; each took minutes or ended the process.
HARD = ["." * 10**6 + "a", ("." + ")" * 10) * 10**5 + "a", "a'" * 10**6 + "a", "'" * 10**6, "a. " * 10**5, "!" * 10**6, "a" * 10**6]


def test_long_runs_take_linear_time(spark):
    begun = time.monotonic()
    for expression in (T.sentences("x"), T.without_end_mark("x"), T.tokens("x"), T.expand_contractions("x")):
        assert len(evaluate(spark, f"length(CAST({expression} AS STRING))", HARD)) == len(HARD)
    assert evaluate(spark, T.tokens("x"), ["b'" * 10**6 + "c 'd'"]) == [["b'" * 10**6 + "c", "d"]]
    assert evaluate(spark, f"size({T.sentences('x')})", HARD) == [1, 1, 1, 1, 10**5, 1, 1]
    assert time.monotonic() - begun < 120


def test_tokens(spark):
    texts = ["Bill-of-Material, O'Brien's 'x' a/b foo@bar.com", "Title, General Chairman is", "-a- ''", "été où"]
    assert evaluate(spark, T.tokens("x"), texts) == [
        ["Bill-of-Material", "O'Brien's", "x", "a/b", "foo", "bar.com"],
        ["Title", "General", "Chairman", "is"],
        ["-a-"],
        ["été", "où"],
    ]


def test_word_shape(spark):
    words = ["ab", "a", "", "a-b", "-ab", "ab-", "ab.", "(ab", "a\\", "\\a", "ab'", "_a", "éa", "^a", "a%"]
    expected = [
        len(w) >= 2 and w[0] not in T.EDGE_PUNCTUATION and w[-1] not in T.EDGE_PUNCTUATION for w in words
    ]
    assert len(set(T.EDGE_PUNCTUATION)) == 22
    assert evaluate(spark, T.is_word("x"), words) == expected


def test_word_class(spark):
    tags = ["JJ", "JJR", "VBD", "NN", "NNP", "RB", "RP", "DT", "IN", "", "PRP"]
    assert evaluate(spark, T.word_class("x"), tags) == ["a", "a", "v", "n", "n", "r", "r"] + [None] * 4


LEXICON = [
    ("city", "NN", "city"),
    ("glass", "NN", "glass"),
    ("gla", "NN", "gla"),
    ("make", "VB", "make"),
    ("mak", "VB", "mak"),
    ("large", "JJ", "large"),
    ("men", "NNS", "man"),
    ("the", "DT", "the"),
    ("ran", "VBD", "run"),
]


def test_word_forms(spark):
    lexicon = spark.createDataFrame(LEXICON, "surface STRING, tag STRING, lemma STRING")
    forms = {r.surface: (r.tag, r.lemma) for r in L.word_forms(lexicon).collect()}
    assert forms["cities"] == ("NNS", "city")
    assert forms["glasses"] == ("NNS", "glass")
    assert forms["making"] == ("VBG", "mak")  # the shorter of the two lemmas
    assert forms["larger"] == ("JJR", "large")
    assert forms["men"] == ("NNS", "man")
    assert forms["runs"] == ("VBZ", "run")
    assert forms["the"] == ("DT", "the") and "thes" not in forms


def test_unknown_words_are_nouns_and_large_lexicons_join_the_same_way(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The cities making glasses. Zork zorks")], "doc_id BIGINT, text STRING")
    lexicon = spark.createDataFrame(LEXICON, "surface STRING, tag STRING, lemma STRING")
    few = sorted(r.term or "" for r in K.term_stream(docs, lexicon=lexicon).collect())
    monkeypatch.setattr(local.broadcast_if_small, "__defaults__", (None, 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = sorted(r.term or "" for r in K.term_stream(docs, lexicon=lexicon).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert few == many
    assert [t for t in few if t] == ["city", "glass", "mak", "zork", "zorks"]


def test_stop_words_are_case_sensitive(spark):
    tokens = spark.createDataFrame([("the",), ("The",), ("file",)], "token STRING")
    kept = K.drop_stop_words(tokens, local.default_stop_words(spark))
    assert sorted(r.token for r in kept.collect()) == ["The", "file"]


# The first document and its terms are a known result.
SAMPLE = {
    1: (
        "A Rule-based Language for Deductive Object-Oriented Databases.",
        ["rule-based", "language", "deductive", "object-oriented", "database"],
    ),
    2: ("Quux-based Zorks, the Blarg.", ["quux-based", "zorks", "blarg"]),
    3: ("Snarf! A zip2 of 7 wibbles; (grue) and -frob- again.", ["snarf", "zip", "wibbles", "grue"]),
}


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame([(i, t) for i, (t, _) in SAMPLE.items()], "doc_id BIGINT, text STRING")


def test_sample_records(spark, sample):
    counts = I.term_frequencies(I.index_rows(sample)).collect()
    for doc_id, (_, terms) in SAMPLE.items():
        rows = sorted((r for r in counts if r.doc_id == doc_id), key=lambda r: r.first_pos)
        assert {r.term: r.tf for r in rows} == dict(Counter(terms))
        assert [r.term for r in rows] == list(dict.fromkeys(terms))


def test_analysis_in_the_row_equals_the_joins(spark):
    draw = random.Random(6)
    pieces = ["the", "The", "cities", "glass", "isn't", "zork.", "e.g.", "a1b2", "'quoted'", "x-", "-", "!!", "?\n", "half-way", "(men)", "é"]
    texts = [" ".join(draw.choice(pieces) for _ in range(draw.randint(0, 40))) for _ in range(60)] + [None, "", "...", "a"]
    docs = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "doc_id INT, text STRING").coalesce(1)
    lexicon = spark.createDataFrame(LEXICON, "surface STRING, tag STRING, lemma STRING")
    stop = spark.createDataFrame([("the",), ("isn",), (None,), ("the",)], "word STRING")
    for tables in ({}, {"stop": stop}, {"lexicon": lexicon}, {"stop": stop, "lexicon": lexicon}):
        within = I.index_rows(docs, **tables)
        joined = I.joined_index_rows(docs, **tables)
        columns = ["doc_id", "term", "tf", "first_pos", "doc_len", "max_tf"]
        rows = [sorted(map(str, x.select(columns).collect())) for x in (within, joined)]
        assert rows[0] == rows[1] and len(rows[0]) > 60
        assert I.index_rows(docs, **tables, constant_rows=0).columns == within.columns


def test_a_table_in_many_files_is_not_shuffled(spark, sample, tmp_path):
    sample.repartition(9).write.parquet(str(tmp_path / "many"))
    sample.union(sample).repartition(9).write.mode("append").parquet(str(tmp_path / "many"))
    docs = spark.read.parquet(str(tmp_path / "many"))
    assert len(docs.inputFiles()) >= spark.sparkContext.defaultParallelism
    plan = I.term_frequencies(I.index_rows(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan
    few = I.index_rows(spark.read.parquet(str(tmp_path / "many")).limit(3)).filter("term is null")
    assert few.count() == 3
