"""Lemmas of unknown words by edit rules that a lexicon teaches.

A rule cuts an ending off and puts another on. For each word class and each ending of up to five characters the table
has the rule that most lexicon words with that ending follow; a word takes the rule of its longest known ending. Words of the
lexicon itself are exceptions: they have their own lemma.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termscale.functions.text import word_class
from termscale.sources.local import broadcast_if_small

LONGEST_ENDING = 5


def lemma_rules(lexicon: DataFrame) -> DataFrame:
    """(class, ending, cut, add, n) from (surface, tag, lemma): one rule for each class and ending, with the words that follow it.

    Of rules that are equally frequent the one with the shorter cut wins, then in alphabetical order. Tags without a
    word class and null surfaces or lemmas teach nothing; an entry counts once, however often it is listed.
    """
    words = lexicon.selectExpr("surface", f"{word_class('tag')} AS class", "lemma").dropna().distinct()
    shared = (
        "aggregate(sequence(1, least(length(surface), length(lemma))), 0, (shared, i) -> "
        "CASE WHEN shared = i - 1 AND substring(surface, i, 1) = substring(lemma, i, 1) THEN i ELSE shared END)"
    )
    words = words.filter("surface <> '' AND lemma <> ''").withColumn("shared", F.expr(shared))
    words = words.selectExpr("surface", "class", "substring(surface, shared + 1) AS cut", "substring(lemma, shared + 1) AS `add`")
    ends = f"transform(sequence(length(cut), least(length(surface), greatest({LONGEST_ENDING}, length(cut)))), k -> right(surface, k))"
    counts = words.selectExpr("class", "cut", "`add`", f"explode({ends}) AS ending").filter(F.length("ending") <= LONGEST_ENDING)
    counts = counts.groupBy("class", "ending", "cut", "add").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("class", "ending").orderBy(F.desc("n"), F.length("cut"), "cut", "add")
    ranked = counts.withColumn("place", F.row_number().over(best))
    return ranked.filter("place = 1").select("class", "ending", "cut", "add", "n")


def lemmatize_words(words: DataFrame, rules: DataFrame, lexicon: DataFrame = None) -> DataFrame:
    """`words` (surface, class, ...) with `lemma`, one row per row.

    A word of `lexicon` in its class has that lemma (the shortest, then the first, of several). Others take the rule of their
    longest ending that leaves a character; without a rule or a class a word is its own lemma. Tables are broadcast
    if they are small.
    """
    found = words.withColumn("lemma", F.lit(None).cast("string"))
    if lexicon is not None:
        own = lexicon.selectExpr("surface", f"{word_class('tag')} AS class", "lemma").dropna()
        own = own.groupBy("surface", "class").agg(F.min(F.struct(F.length("lemma"), "lemma"))["lemma"].alias("own"))
        found = words.join(broadcast_if_small(own), ["surface", "class"], "left").withColumnRenamed("own", "lemma")
    found = found.select(*words.columns, "lemma")
    for k in range(LONGEST_ENDING, -1, -1):
        rule = rules.filter(F.length("ending") == k).selectExpr("class AS rule_class", "ending", "cut", "`add`")
        end = F.when(F.col("lemma").isNull() & (F.length("surface") >= k), F.right("surface", F.lit(k)))
        found = found.withColumn("end", end)
        same = (F.col("class") == F.col("rule_class")) & (F.col("end") == F.col("ending"))
        found = found.join(broadcast_if_small(rule), same, "left")
        made = "CASE WHEN length(cut) < length(surface) OR `add` <> '' THEN concat(left(surface, length(surface) - length(cut)), `add`) END"
        found = found.withColumn("lemma", F.coalesce("lemma", F.expr(made))).select(*words.columns, "lemma")
    return found.withColumn("lemma", F.coalesce("lemma", "surface"))
