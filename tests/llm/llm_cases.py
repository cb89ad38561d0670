"""Rows that every operator must take, and the folder of the smallest tables."""

SF_SMALL = "/root/testdata/sf0.001"

#: null id, null text, empty, repeated rows, ties, punctuation only, very long texts
EDGES = [(None, "null id text here"), (1, None), (2, ""), (3, "same row"), (3, "same row"), (4, "!!! ???"),
         (4, "tie of one id"), (5, "long " * 30_000), (6, "x" * 60_000), (None, None)]


def make_docs(spark, rows):
    """Documents from (doc_id, text) pairs, with the other columns of the table."""
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t) if t else None) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
