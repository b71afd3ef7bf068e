"""Readers for the rule tables kept as text next to this module."""

from pathlib import Path

HERE = Path(__file__).parent


def read_rows(name):
    """Rows of a tab-separated rule table, without its comment lines."""
    lines = (HERE / name).read_text(encoding="utf-8").splitlines()
    return [tuple(line.split("\t")) for line in lines if line and not line.startswith("#")]


def contraction_rules():
    """Ordered (search, replacement) pairs: each key capitalised, then as written.

    A key whose capitalised form is itself appears once, at its first place.
    """
    pairs = {}
    for key, expansion in read_rows("contractions.tsv"):
        pairs[key.capitalize()] = expansion
        pairs[key] = expansion
    return list(pairs.items())


def stop_words():
    return [word for (word,) in read_rows("stopwords.txt")]


def lexicon_rows():
    """(surface, tag, lemma)"""
    return read_rows("lexicon.tsv")


def detachment_rows():
    """(class, suffix, replacement, tag)"""
    return read_rows("detachment.tsv")
