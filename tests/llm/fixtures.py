"""Awkward documents: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "two words"), (6, "same text here now"), (7, "same  text here\nnow"), (7, "same text here now"),
    (7, "same text here now"), (None, "same text here now"), (None, None), (8, "é ß 日本 🎉 " * 50), (9, "x" * 5000), (10, "secret: abcdefgh " * 300),
]


def documents(spark, rows=AWKWARD):
    """The rows with columns whose names are those that operators use inside and return."""
    full = [(i, t, "src", "en" if k % 2 else None, 7, k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, source string, lang string, row int, spans int")


def prose(seed, n, words=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(n)]
