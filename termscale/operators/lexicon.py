"""Word forms: which tag and lemma a surface form has."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscale.functions.text import word_class
from termscale.sources.local import broadcast_if_small, default_lexicon, detachment_rules, form_table

UNKNOWN_TAG = "NN"


def word_forms(lexicon: DataFrame) -> DataFrame:
    """(surface, tag, lemma), one row per surface form.

    Instead of cutting suffixes off every token and looking the rest up, the suffix rules are
    applied to the lexicon: each lemma yields the forms that would be cut back to it. The result
    is at most (rules per class + 1) times the lexicon, and a token needs one look-up. An entry
    of the lexicon itself wins over a derived form, then the shortest lemma wins.
    """
    entries = lexicon.selectExpr("surface", "tag", "lemma", "0 AS source")
    bases = lexicon.selectExpr("lemma", f"{word_class('tag')} AS class").filter("class IS NOT NULL").distinct()
    inflected = (
        bases.join(F.broadcast(detachment_rules(lexicon.sparkSession)), "class")
        .filter("endswith(lemma, replacement)")
        .selectExpr(
            "concat(left(lemma, length(lemma) - length(replacement)), suffix) AS surface",
            "rule_tag AS tag",
            "lemma",
            "1 AS source",
        )
    )
    best = "row_number() OVER (PARTITION BY surface ORDER BY source, length(lemma), lemma, tag)"
    return (
        entries.unionByName(inflected)
        .selectExpr("*", f"{best} AS choice")
        .filter("choice = 1")
        .select("surface", "tag", "lemma")
    )


_SHIPPED = []


def shipped_form_rows(spark) -> list:
    """(surface, tag, lemma) of the forms of the shipped lexicon: some hundred rows, a fixed number, kept after the first call."""
    if not _SHIPPED:
        _SHIPPED.extend(tuple(row) for row in word_forms(default_lexicon(spark)).collect())
    return _SHIPPED


def default_forms(spark) -> DataFrame:
    return F.broadcast(form_table(spark, shipped_form_rows(spark)))


def checked_forms(lexicon: DataFrame) -> DataFrame:
    """The forms of a caller's lexicon, broadcast only if they are few."""
    return broadcast_if_small(word_forms(lexicon))


def look_up_forms(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """Add `tag`, `class` and `lemma` by `surface`; an unknown word is a noun and its own lemma."""
    kept = [c for c in tokens.columns if c != "surface"]
    known = tokens.join(forms, "surface", "left").selectExpr(
        *kept, "surface", f"coalesce(tag, '{UNKNOWN_TAG}') AS tag", "coalesce(lemma, surface) AS lemma"
    )
    return known.selectExpr("*", f"{word_class('tag')} AS class")
