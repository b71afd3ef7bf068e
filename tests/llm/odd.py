"""Rows that every operator has to take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

LONG = " ".join(f"w{i % 977}" for i in range(30_000))

ODD = [
    (1, "The same line of plain words, once more."),
    (2, "The same line of plain words, once more."),
    (2, "The same line of plain words, once more."),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "!!! ??? ..."),
    (7, LONG),
    (None, "a row without an id of its own"),
    (None, "another row without an id of its own"),
    (None, None),
    (8, "один два три — ½ naïve Straße <|endoftext|> İstanbul"),
    (9, "word"),
]


def odd_documents(spark, rows=ODD):
    """The rows with columns beside doc_id and text whose names operators might use inside."""
    clashing = ["code", "key", "keys", "digest", "block", "part", "row_id", "words", "bigrams", "label", "keep_id", "kept"]
    clashing += ["kept_id", "lost_id", "text_key", "leaking_id", "curve", "train", "lang", "score", "ids", "unit"]
    made = [(*row, *["x"] * len(clashing)) for row in rows]
    return spark.createDataFrame(made, "doc_id long, text string, " + ", ".join(f"{c} string" for c in clashing))


def no_documents(spark):
    return odd_documents(spark, []).limit(0)
