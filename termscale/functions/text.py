"""Text preparation as Spark SQL expressions: each function maps expression text to expression text,
for `selectExpr` and `F.expr`, so they nest. All of them run inside the JVM."""

import re
import string
import sys
from functools import cache

from termscale.rules import contraction_rules

# Every repeat below is possessive: none gives back what it took, so a match takes a time in proportion to its text and no
# stack, whatever the text repeats.
#
# An end mark is a run of closing punctuation with the quotes and brackets behind it.
END_MARK = r"""[.!?]++["')\]}>]*+"""
# A sentence runs to the first end mark, which it keeps, followed by white space or the end of the text. One
# mark that begins a sentence does not end it.
SENTENCE = (
    rf"(?!\z)((?:[.!?](?![.!?]))?+(?:[^.!?]++|{END_MARK}(?![ \t\r\n]|\z))*+(?:{END_MARK})?+)(?:[ \t\r\n]++|\z)"
)

# White space and the characters that a Treebank-style tokeniser splits off as tokens of their own.
SEPARATORS = r"""\p{Z}\x01-\x20",;:@#$%&?!()\[\]{}<>`"""
# A token is a run of other characters; an apostrophe belongs to it only between two of them.
TOKEN = f"[^'{SEPARATORS}]++(?:'[^'{SEPARATORS}]++)*+"

def _ranges(characters) -> str:
    """Ascending code points as the inside of a character class."""
    found = []
    for code in characters:
        if found and found[-1][1] == code - 1:
            found[-1][1] = code
        else:
            found.append([code, code])
    return "".join(rf"\x{{{first:04X}}}-\x{{{last:04X}}}" for first, last in found)


# All characters with a digit value, spelt out: the classes of regular expressions follow the Unicode version of
# the engine.
DIGIT = f"[{_ranges(code for code in range(sys.maxunicode + 1) if chr(code).isdigit())}]"
# The digits among the Latin letters, and everything behind those: a short class that is true of every digit.
LATIN = 0x250
MAYBE_DIGIT = rf"[{_ranges(code for code in range(LATIN) if chr(code).isdigit())}\x{{{LATIN:04X}}}-\x{{10FFFF}}]"

# A word neither starts nor ends with one of these.
EDGE_PUNCTUATION = r".<>-{}[]/:;\@!#$%^&*()"


def literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def sentences(text: str) -> str:
    """array<string> of the sentences with their end marks; none for an empty or missing text."""
    return f"regexp_extract_all(coalesce({text}, ''), {literal(SENTENCE)}, 1)"


def once(expression: str, body) -> str:
    """`body` of a variable that holds the value of `expression`, which is computed once however often it is named. A name is used
    as it is."""
    return body(expression) if expression.isidentifier() else f"transform(array({expression}), it -> {body('it')})[0]"


def without_end_mark(sentence: str) -> str:
    """A sentence as it is tokenised: the end mark is no part of its last word."""

    def cut(it):
        # Most sentences end with a single full stop or with no mark at all, which needs no search.
        plain = " AND ".join(f"NOT endswith({it}, {literal(c)})" for c in ".!?\"')]}>")
        single = f"endswith({it}, '.') AND NOT endswith({it}, '..') AND NOT endswith({it}, '!.') AND NOT endswith({it}, '?.')"
        other = f"regexp_replace({it}, {literal('(?<![.!?])' + END_MARK + chr(92) + 'z')}, '')"
        return f"CASE WHEN {single} THEN left({it}, length({it}) - 1) WHEN {plain} THEN {it} ELSE {other} END"

    return once(sentence, cut)


# A run of letters and apostrophes, with one apostrophe at least.
CLUSTER = "(?<![A-Za-z])[A-Za-z]*+'[A-Za-z']*+"
# In such a run only what has an apostrophe before a small letter can be a contraction.
CONTRACTED = "'[a-z]"
CLUSTER_CHARACTERS = string.ascii_letters + "'"


@cache
def _contraction_tables() -> tuple[list, str, str]:
    """The rules that come before all others and begin with an apostrophe; the others as a constant array; and what the
    others make of each of their keys, as a constant map."""
    rules = contraction_rules()
    n = next(i for i, (key, _) in enumerate(rules) if not key.startswith("'"))
    first, rest = rules[:n], rules[n:]
    if any(set(key) - set(CLUSTER_CHARACTERS) or not re.search(CONTRACTED, key) for key, _ in rest):
        raise ValueError("a contraction has other characters than letters, or no apostrophe before a small letter")
    made = {}
    for key, _ in rest:
        made[key] = key
        for search, replacement in rest:
            made[key] = made[key].replace(search, replacement)
    pairs = [f"struct({literal(k)} AS search, {literal(v)} AS replacement)" for k, v in rest]
    known = [literal(text) for pair in made.items() for text in pair]
    return first, f"array({', '.join(pairs)})", f"map({', '.join(known)})"


def expand_contractions(text: str) -> str:
    """Apply every contraction rule in table order, each to the result of the one before, in one pass over the text.

    The first rules are a few endings and are applied as they are. The keys of all others consist of
    letters and apostrophes, so a match lies within a run of such characters, before and after any
    replacement; what the rules make of a text is what they make of each run. Runs that are a key are looked up,
    others are short, and the rest of the text is only copied.
    """
    first, rules, known = _contraction_tables()
    fold = f"aggregate({rules}, cluster, (done, rule) -> replace(done, rule.search, rule.replacement))"
    found = f"coalesce(element_at({known}, cluster), {fold})"
    expanded = f"cluster -> CASE WHEN cluster RLIKE {literal(CONTRACTED)} THEN {found} ELSE cluster END"

    def rewritten(it):
        clusters = f"transform(regexp_extract_all({it}, {literal(CLUSTER)}, 0), {expanded})"
        gaps = f"split({it}, {literal(CLUSTER)}, -1)"
        joined = f"array_join(zip_with({gaps}, {clusters}, (gap, word) -> concat(gap, coalesce(word, ''))), '')"
        return f"CASE WHEN contains({it}, {literal(chr(39))}) THEN {joined} ELSE {it} END"

    def begun(it):
        for search, replacement in first:
            it = f"replace({it}, {literal(search)}, {literal(replacement)})"
        return it

    return once(text, lambda it: f"CASE WHEN contains({it}, {literal(chr(39))}) THEN {once(begun(it), rewritten)} ELSE {it} END")


def strip_digits(text: str) -> str:
    # The long class is slow to test, so ASCII texts skip it and the look-ahead skips ASCII characters. Most sentences have neither
    # a digit nor a character of the scripts that could have others, and stay as they are.
    every_digit = rf"[0-9]|(?![\x00-\x7F]){DIGIT}"
    removed = (
        f"CASE WHEN octet_length(%s) > length(%s) THEN regexp_replace(%s, {literal(every_digit)}, '')"
        " ELSE translate(%s, '0123456789', '') END"
    )
    return once(text, lambda it: f"CASE WHEN {it} RLIKE {literal(MAYBE_DIGIT)} THEN {removed.replace('%s', it)} ELSE {it} END")


def tokens(text: str) -> str:
    return f"regexp_extract_all({text}, {literal(TOKEN)}, 0)"


def is_word(token: str) -> str:
    """Two characters or more, with no punctuation at either end."""
    edges = literal(EDGE_PUNCTUATION)
    return (
        f"(length({token}) >= 2 AND NOT contains({edges}, left({token}, 1))"
        f" AND NOT contains({edges}, right({token}, 1)))"
    )


def word_class(tag: str) -> str:
    """WordNet class of a Penn tag: adjective a, verb v, noun n, adverb r, otherwise null."""
    return (
        f"CASE WHEN startswith({tag}, 'J') THEN 'a' WHEN startswith({tag}, 'V') THEN 'v'"
        f" WHEN startswith({tag}, 'N') THEN 'n' WHEN startswith({tag}, 'R') THEN 'r' END"
    )
