"""Edit rules by definition, and how well they do on words that were left out."""

import zlib
from collections import Counter

import pytest

from pyspark.sql import functions as F

from termscale.operators import lemmas as M
from termscale.operators.lexicon import shipped_form_rows
from termscale.sources.local import form_table

CLASS = {"J": "a", "V": "v", "N": "n", "R": "r"}


def rules_by_definition(rows):
    counts = Counter()
    for surface, tag, lemma in set(rows):
        kind = CLASS.get(tag[:1])
        if kind is None or not surface or not lemma:
            continue
        p = 0
        while p < min(len(surface), len(lemma)) and surface[p] == lemma[p]:
            p += 1
        for k in range(len(surface) - p, 6):
            if k <= len(surface):
                counts[kind, surface[len(surface) - k :], surface[p:], lemma[p:]] += 1
    best = {}
    for (kind, ending, cut, add), n in counts.items():
        key = (-n, len(cut), cut, add)
        if (kind, ending) not in best or key < best[kind, ending]:
            best[kind, ending] = key
    return {at: (key[2], key[3]) for at, key in best.items()}


def lemma_by_definition(surface, kind, rules, known):
    if (surface, kind) in known:
        return min(known[surface, kind], key=lambda x: (len(x), x))
    for k in range(min(5, len(surface)), -1, -1):
        cut, add = rules.get((kind, surface[len(surface) - k :]), (None, None))
        if cut is not None and (len(cut) < len(surface) or add):
            return surface[: len(surface) - len(cut)] + add
    return surface


LEXICON = [
    ("cities", "NNS", "city"), ("parties", "NNS", "party"), ("ties", "NNS", "tie"), ("dogs", "NNS", "dog"), ("cats", "NNS", "cat"),
    ("running", "VBG", "run"), ("walking", "VBG", "walk"), ("talking", "VBG", "talk"), ("went", "VBD", "go"), ("men", "NNS", "man"),
    ("larger", "JJR", "large"), ("the", "DT", "the"), ("saw", "VBD", "see"), ("saw", "NN", "saw"), ("dogs", "NNS", "dog"),
]


def applied(spark, words, lexicon, rules, with_lexicon=True):
    table = spark.createDataFrame(words, "surface string, class string")
    rows = M.lemmatize_words(table.withColumn("other", F.lit(1)), rules, lexicon if with_lexicon else None).collect()
    return {(r.surface, r["class"]): r.lemma for r in rows}


@pytest.mark.parametrize("rows", [LEXICON, None])
def test_rules_and_lemmas_by_definition(spark, rows):
    rows = rows or shipped_form_rows(spark)
    table = form_table(spark, rows)
    rules = M.lemma_rules(table)
    expected = rules_by_definition(rows)
    assert {(r["class"], r.ending): (r.cut, r["add"]) for r in rules.collect()} == expected
    known = {}
    for surface, tag, lemma in rows:
        known.setdefault((surface, CLASS.get(tag[:1])), []).append(lemma)
    words = [(w, c) for w in ["ponies", "saw", "went", "walking", "ing", "s", "", "zorks", "x", "men", "larger", "é", "tallies"] for c in "nvar"]
    words += [(s, c) for s, c in known if c]
    for with_lexicon in (True, False):
        found = applied(spark, words, table, rules, with_lexicon)
        assert found == {(w, c): lemma_by_definition(w, c, expected, known if with_lexicon else {}) for w, c in words}


def test_odd_words(spark):
    table = form_table(spark, LEXICON)
    rules = M.lemma_rules(table)
    found = applied(spark, [("dogs", None), (None, "n"), ("dogs", "x"), ("dogs", "n")], table, rules)
    assert found == {("dogs", None): "dogs", (None, "n"): None, ("dogs", "x"): "dogs", ("dogs", "n"): "dog"}
    assert M.lemma_rules(table.limit(0)).count() == 0
    assert applied(spark, [("dogs", "n")], table.limit(0), rules.limit(0)) == {("dogs", "n"): "dogs"}


def test_words_that_were_left_out(spark):
    """Five folds over the forms of the shipped lexicon; a word that stays as it is would be right far less often."""
    rows = [r for r in shipped_form_rows(spark) if CLASS.get(r[1][:1])]
    right = plain = 0
    for fold in range(5):
        out = [r for r in rows if zlib.crc32(r[2].encode()) % 5 == fold]
        table = form_table(spark, [r for r in rows if r not in out])
        found = applied(spark, [(s, CLASS[t[:1]]) for s, t, _ in out], table, M.lemma_rules(table))
        right += sum(found[s, CLASS[t[:1]]] == lemma for s, t, lemma in out)
        plain += sum(s == lemma for s, t, lemma in out)
    print(f"left out: {right} of {len(rows)} right, {plain} as they are")
    assert right > 0.7 * len(rows) and right > 1.5 * plain
