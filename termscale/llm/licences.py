"""Licence notices in documents, by the Dice coefficient of word bigrams.

Every line, and every paragraph of several lines, is compared with those templates whose size allows the wanted
coefficient. Only bigrams that a template holds go on to the count, so most text ends in the join with the
templates' bigrams.

A notice can also share its line or paragraph with other text, or go over several of them. So windows of as many
words as a template has are compared with it, wherever in the text so many of its bigrams stand together that the
coefficient can be reached. Texts that hold too few bigrams of every template are left out within their row, so that they
are not shuffled.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termscale.session import written
from termscale.sources.local import broadcast_if_small

SIMILARITY = 0.8
#: Templates of so many bigrams in all, at most, are compared with each text within its row.
IN_ROW = 2_000
#: What parts lines and paragraphs.
LINE, PARAGRAPH = "\n", "\n[ \t\r]*\n"

# Notices as their licences ask for them or as they are commonly written.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
    ("All-Rights-Reserved", "All rights reserved."),
]


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template_id, licence, template."""
    rows = [(i, licence, text) for i, (licence, text) in enumerate(templates)]
    return spark.createDataFrame(rows, "template_id int, licence string, template string")


def words_of(text):
    """The lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda word: word != "")


def pairs_of(words):
    """The pairs of neighbouring words, as 64-bit codes; none for fewer than two words."""

    def paired(codes):
        n = F.greatest(F.size(codes) - 1, F.lit(0))
        return F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: F.xxhash64(a, b))

    # As the variable of a function the codes are made once, however often they are named.
    return F.transform(F.array(F.transform(words, lambda word: F.xxhash64(word))), paired)[0]


def bigrams_of(words):
    """The distinct ones of `pairs_of`."""
    return F.array_distinct(pairs_of(words))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, text_key, kind, number, unit: the lines (kind line) and paragraphs of several lines of each text."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("text_key"),
        F.col(text_col).alias("text"),
    )

    def numbered(kind, found):
        return F.transform(found, lambda unit, at: F.struct(F.lit(kind).alias("kind"), at.alias("number"), unit.alias("unit")))

    lines = numbered("line", F.split("text", LINE))
    paragraphs = numbered("paragraph", F.split("text", PARAGRAPH))
    found = rows.select("row_id", "doc_id", "text_key", F.explode(F.concat(lines, paragraphs)).alias("x"))
    found = found.select("row_id", "doc_id", "text_key", "x.*")
    return found.filter("kind = 'line' or contains(unit, '\n')")


def _plain_words(text):
    """The words of a text without the words that mark lines as comments; other comment marks are no words."""
    return words_of(F.regexp_replace(text, r"(?im)^[ \t]*(?:dnl|rem)\b", " "))


def _texts_that_hold(texts, known):
    """`texts` with `words`, and a function of the words that gives the pairs of a text, or null if no window of it can reach
    the similarity: it has fewer than `need` of the bigrams of every template. More than `IN_ROW` bigrams of templates are not
    looked for here, and all pairs are given."""
    texts = texts.withColumn("words", _plain_words(F.col("text")))
    known = known.filter("n_template > 0")
    if (known.agg(F.sum("n_template")).first()[0] or 0) > IN_ROW:
        return texts, pairs_of
    sought = F.collect_list(F.struct("template_bigrams", "need")).alias("sought")
    sought = known.agg(sought).select("sought", F.array_distinct(F.flatten("sought.template_bigrams")).alias("sought_bigrams"))

    def holds(pairs):
        def enough(common):
            return F.exists("sought", lambda t: F.size(F.array_intersect(common, t["template_bigrams"])) >= t["need"])

        # As in `pairs_of`: what all templates share with the text is made once.
        return F.exists(F.array(F.array_intersect(pairs, F.col("sought_bigrams"))), enough)

    def held_pairs(words):
        return F.transform(F.array(pairs_of(words)), lambda pairs: F.when(holds(pairs), pairs))[0]

    return texts.crossJoin(F.broadcast(sought)), held_pairs


def _windows(docs, templates, noticed, id_col, text_col, similarity):
    """The rows of `licence_notices` for windows; `noticed` has the notices that are lines and paragraphs."""
    known = templates.select("template_id", "licence", _plain_words(F.col("template")).alias("template_words"))
    known = known.withColumn("template_bigrams", bigrams_of(F.col("template_words")))
    known = known.select(
        "template_id",
        "licence",
        "template_bigrams",
        F.size("template_bigrams").alias("n_template"),
        F.size("template_words").alias("width"),
        # Of a window with c common bigrams the coefficient is at most 2 c / (c + n_template).
        F.ceil(F.size("template_bigrams") * (similarity / (2 - similarity)) - 1e-9).cast("int").alias("need"),
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    row = ["doc_id", "text_key"]

    # Where the bigrams of each template stand in each text.
    texts, held_pairs = _texts_that_hold(texts, known)
    at = texts.select(*row, F.posexplode(held_pairs(F.col("words"))).alias("at", "bigram"))
    wanted = known.select("template_id", "width", "need", F.explode("template_bigrams").alias("bigram"))
    hits = at.join(broadcast_if_small(wanted, measured=wanted), "bigram")
    places = hits.groupBy(*row, "template_id", "width", "need").agg(F.sort_array(F.collect_set("at")).alias("places"))
    # A window starts at a bigram of its template and has to hold enough places.
    starts = F.filter("places", lambda p, i: F.get("places", i + F.col("need") - 1) <= p + F.col("width") - 2)
    starts = places.select(*row, "template_id", starts.alias("starts")).filter(F.size("starts") > 0)
    found = written(starts, "licence-windows").join(known, "template_id")
    fields = ["template_id", "licence", "template_bigrams", "n_template", "width", "starts"]
    found = found.groupBy(*row).agg(F.collect_list(F.struct(*fields)).alias("templates"))
    fields = ["kind", "number", "licence", "dice"]
    noticed = noticed.groupBy(*row).agg(F.collect_set(F.struct(*fields)).alias("noticed"))

    # All texts are split into words again, so that only those that can hold a window are shuffled.
    if held_pairs is not pairs_of:
        texts = texts.filter(held_pairs(F.col("words")).isNotNull())
    texts = texts.select(*row, "text")
    found, noticed = found.toDF("hit_doc", "hit_key", "templates"), noticed.toDF("unit_doc", "unit_key", "noticed")
    texts = texts.join(found, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("text_key") == F.col("hit_key")))
    same = F.col("doc_id").eqNullSafe(F.col("unit_doc")) & (F.col("text_key") == F.col("unit_key"))
    texts = texts.join(noticed, same, "left")

    def words_before(kind, number):
        """How many words stand before a line or paragraph."""
        lines = F.array_join(F.slice(F.split("text", LINE), 1, number.cast("int")), "\n")
        paragraphs = F.array_join(F.slice(F.split("text", PARAGRAPH), 1, number.cast("int")), "\n\n")
        return F.size(_plain_words(F.when(kind == "line", lines).otherwise(paragraphs)))

    taken = F.transform(
        F.coalesce("noticed", F.array().cast(noticed.schema["noticed"].dataType)),
        lambda u: F.struct(
            u["licence"], u["dice"], words_before(u["kind"], u["number"]), words_before(u["kind"], u["number"] + 1)
        ),
    ).cast("array<struct<licence: string, dice: double, start: int, end: int>>")
    texts = texts.select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        _plain_words(F.col("text")).alias("words"),
        taken.alias("taken"),
        F.explode("templates").alias("t"),
    )
    windows = texts.select("row_id", "doc_id", "words", "taken", "t", F.explode("t.starts").alias("start"))
    windows = windows.withColumn("words", F.slice("words", F.col("start") + 1, F.col("t.width")))
    windows = windows.withColumn("bigrams", bigrams_of(F.col("words"))).withColumn("n_unit", F.size("bigrams"))
    windows = windows.withColumn("n_common", F.size(F.array_intersect("bigrams", "t.template_bigrams")))
    windows = windows.withColumn("dice", 2 * F.col("n_common") / (F.col("n_unit") + F.col("t.n_template")))
    windows = windows.withColumn("end", F.col("start") + F.size("words")).filter(F.col("dice") >= similarity)
    # What a line or paragraph says as well is not said again.
    said = F.exists(
        "taken",
        lambda u: (u["start"] < F.col("end"))
        & (F.col("start") < u["end"])
        & ((u["licence"] == F.col("t.licence")) | (u["dice"] >= F.col("dice"))),
    )
    fields = [(-F.col("dice")).alias("least"), F.col("t.template_id").alias("template_id"), "start", "end"]
    fields += [F.col("t.licence").alias("licence"), "n_common", "n_unit", F.col("t.n_template").alias("n_template"), "dice"]
    fields += [F.array_join("words", " ").alias("unit")]
    windows = windows.filter(~said).select("row_id", "doc_id", F.struct(*fields).alias("w"))
    windows = windows.groupBy("row_id", "doc_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    # Of windows that overlap the best stays.
    best = F.aggregate(
        "w",
        F.array().cast(windows.schema["w"].dataType),
        lambda kept, w: F.when(
            F.exists(kept, lambda k: (k["start"] < w["end"]) & (w["start"] < k["end"])), kept
        ).otherwise(F.concat(kept, F.array(w))),
    )
    return windows.select("doc_id", F.explode(best).alias("w")).select(
        "doc_id",
        F.lit("window").alias("kind"),
        F.col("w.start").cast("long").alias("number"),
        "w.licence",
        F.col("w.template_id").cast("long").alias("template_id"),
        F.col("w.n_common").cast("long").alias("n_common"),
        F.col("w.n_unit").cast("long").alias("n_unit"),
        F.col("w.n_template").cast("long").alias("n_template"),
        "w.dice",
        "w.unit",
    )


def licence_notices(
    docs: DataFrame,
    templates: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """doc_id, kind, number, licence, template_id, n_common, n_unit, n_template, dice, unit: the best template of each unit.

    `number` counts lines or paragraphs of the text from 0. A unit of kind window is as many neighbouring words as the
    template has (fewer at the end of the text), wherever they stand, and starts with a bigram of the template; `number`
    counts the words before it, without `dnl` and `rem` at the start of a line. Of windows that overlap the one with the
    largest dice stays (then of the smallest template_id, then the first); a window that overlaps a reported line or
    paragraph is left out if that has the same licence or no smaller dice. Units and templates are sets of word bigrams; dice is
    2 n_common / (n_unit + n_template), and is `similarity` or more. Of equal coefficients the smallest template_id is
    taken. Null and empty texts, and units of fewer than two words, have no notice. Repeated rows are reported each,
    null ids as null; other columns are not read. An empty table or no template gives no rows.
    """
    if templates is None:
        templates = template_table(docs.sparkSession)
    known = templates.select("template_id", "licence", bigrams_of(words_of(F.col("template"))).alias("bigrams"))
    known = known.withColumn("n_template", F.size("bigrams"))
    known = known.select("template_id", "licence", "n_template", F.explode("bigrams").alias("bigram"))
    # Dice of sets of sizes m <= n is at most 2 m / (m + n), which bounds n by (2 - s) / s times m.
    factor = (2 - similarity) / similarity
    # Units of too few words, or of so many different ones that they have too many bigrams, end here.
    found = units(docs, id_col, text_col).withColumn("words", words_of(F.col("unit")))
    bounds = known.agg(F.min("n_template").alias("least"), F.max("n_template").alias("most"))
    # A condition without a bound would be pushed below the split into words, and so make it again; a filter on the size of
    # the array, which `explode` has and its outer form has not, too.
    enough = F.size("words") - 1 >= F.greatest(F.col("least") / factor, F.lit(1))
    few = F.size(F.array_distinct("words")) - 1 <= F.col("most") * factor
    found = found.join(F.broadcast(bounds), enough & few)
    # The size is never null here; as it is declared so, no filter on that is pushed either.
    n_unit = F.coalesce(F.size("bigrams"), F.lit(0))
    found = found.withColumn("bigrams", bigrams_of(F.col("words"))).withColumn("n_unit", n_unit)
    key = ["row_id", "doc_id", "text_key", "kind", "number", "unit", "n_unit"]
    larger, smaller = F.greatest("n_unit", "n_template"), F.least("n_unit", "n_template")
    pairs = found.select(*key, F.explode_outer("bigrams").alias("bigram")).filter("bigram IS NOT NULL")
    # Left to sizes seen in the run, all bigrams of all units are shuffled where `bounds` is there before the templates' stage ends.
    pairs = pairs.join(broadcast_if_small(known), "bigram").filter(larger <= smaller * factor)
    counted = pairs.groupBy(*key, "template_id", "licence", "n_template").agg(F.count(F.lit(1)).alias("n_common"))
    counted = counted.withColumn("dice", 2 * F.col("n_common") / (F.col("n_unit") + F.col("n_template")))
    counted = counted.filter(F.col("dice") >= similarity)
    fields = [(-F.col("dice")).alias("least"), "template_id", "licence", "n_common", "n_template", "dice"]
    best = counted.groupBy(*key).agg(F.min(F.struct(*fields)).alias("best"))
    best = best.select(
        "doc_id",
        "text_key",
        "kind",
        F.col("number").cast("long").alias("number"),
        "best.licence",
        F.col("best.template_id").cast("long").alias("template_id"),
        "best.n_common",
        F.col("n_unit").cast("long").alias("n_unit"),
        F.col("best.n_template").cast("long").alias("n_template"),
        "best.dice",
        "unit",
    )
    best = written(best, "licence-units")
    windows = _windows(docs, templates, best.select("doc_id", "text_key", "kind", "number", "licence", "dice"), id_col, text_col, similarity)
    return best.drop("text_key").unionByName(windows)
