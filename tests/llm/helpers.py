"""A table with what data may hold: nulls, blanks, repeats, a null id, a very long text, and columns whose names operators use too."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id long, `key` string, fp long, n int, line int, hash string, label int, component_id long, vector string, score double"
EXTRA = (7, "k", 1, 2, 3, "h", 1, 5, "v", 0.5)


def docs(spark, rows):
    """rows: (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), *EXTRA) for i, t in rows], SCHEMA)


def odd(spark):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return docs(spark, [(1, "A b c d e"), (2, None), (3, ""), (4, " \t\n "), (5, "A b c d e"), (6, "a B c d e"), (6, "a B c d e"), (None, "x y z"), (7, long), (8, "é ß 日本 x"), (9, "one")])


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")
