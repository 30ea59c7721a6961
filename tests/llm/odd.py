"""Tables with nulls, empty and long texts, ties, repeated rows and extra columns with awkward names."""

LONG = "palavra " * 40_000
ROWS = [(5, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
        (5, "another text under the same number"), (None, "a text without a number, quite alone"), (None, None), (7, None), (8, ""), (9, " \n\t "),
        (10, LONG), (11, "x"), (-3, "é" * 300 + " ß"), (12, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (13, "日本語 " * 50), (14, "\x00\x01 nul"),
        (2 ** 62, "a very large number")]
#: Names that the operators give to columns of their own.
CLASHES = ["toxicity", "simhash", "_least", "leaks", "removed", "kept", "_rd", "_rt", "_spans", "bucket", "copy", "key", "d", "u", "v", "node",
           "root", "score", "winnow_hashes", "a.b", "Count"]


def odd(spark):
    """(doc_id, text, lang, source, n_chars) and the clashing names, all strings."""
    rows = [(i, t, "en", None, len(t or ""), *[f"{c}-{n}" for c in CLASHES]) for n, (i, t) in enumerate(ROWS)]
    fields = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, fields).repartition(3)


def plain(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
