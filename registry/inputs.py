"""Parameters shared by the registered queries and their SQL counterparts."""

LADDER = ["ononst", "orre", "thatin", "rewh", "er"]

# One to five terms, then an unknown term, a repeated term and a mix.
QUERIES = [LADDER[:n] for n in range(1, 6)] + [
    ["zzz-missing"],
    ["er", "er", "ononst"],
    ["zzz-missing", "orre"],
]
SINGLE_QUERY = ["rewh", "thatin"]
DENSE_TERMS = LADDER + ["zzz-missing"]

# The documents hold no apostrophes: frequent words are swapped for contractions and quoted words.
CONTRACTION_SWAPS = [
    (" the ", " they're "),
    (" of ", " shouldn't've "),
    (" and ", " y'all'd've "),
    (" to ", " 'system' "),
    (" que ", " Let's "),
    (" die ", " o'clock "),
    (" la ", " i'Didn'tShe'll've "),
    (" el ", " DON'T "),
]

# The documents hold no abbreviations either.
ABBREVIATION_SWAPS = [(" the ", " e.g. "), (" of ", " (approx. "), (" de ", " Dr. "), (" und ", " z.B. ")]
