"""Small frames with the cases that every operator must bear."""

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, score string"


def documents(spark, rows):
    """Documents from (doc_id, text[, lang[, source]]), with extra columns whose names clash."""
    full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] is not None else None, -1, "x", "y") for r in rows]
    return spark.createDataFrame(full, DOCUMENT)


ODD = [
    (1, None), (2, ""), (2**60 + 1, "an id that no double holds"), (3, " \n\t "), (None, "no id here"), (4, "same text twice"), (4, "same text twice"),
    (5, "!!! 123 ???"), (6, "word " * 30_000), (7, "x" * 100_000), (8, "é\u00a0ß \u2028 Ωμ"), (9, "one"), (10, "two words"),
]
