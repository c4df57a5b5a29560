"""Small frames that hold the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

CLASHES = ["key", "text2", "row", "body", "bucket", "fp", "record", "n_words", "kept", "places", "number", "label", "score", "ids", "at", "slot"]


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    syllables = ["an", "the", "or", "ing", "tion", "ré", "ßen", "ou", "st", "er"]
    out = []
    for i in range(words):
        out.append("".join(pick.choice(syllables) for _ in range(pick.randint(1, 4))))
        if pick.random() < 0.15:
            out.append(pick.choice(["the", "of", "and", "to"]))
    return " ".join(out[:words]) + "."


def documents(spark, rows, clash=True):
    extra = CLASHES if clash else []
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in extra)
    return spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t), *("x" for _ in extra)) for k, t in rows], schema)


def awkward():
    """Rows (doc_id, text) with every awkward case."""
    shared = prose(99, 90)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, prose(1, 120)), (4, prose(1, 120)), (None, prose(2, 60)), (None, None),
            (7, prose(3, 40) + " " + shared), (8, shared + "\n" + prose(4, 50)), (9, prose(1, 120)), (10, "x" * 5000),
            (11, prose(5, 6000)), (12, "😀 ▁ é\x00 z" * 30), (13, "one two"), (14, "a a a a a a a a a a a a a a a a a a a a a a a a")]
    return rows
