"""Small documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, h string, rep string, row string, start int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(spark, texts, **extra):
    """(doc_id, text) pairs as a table with columns whose names the operators use inside."""
    rows = [(i, t, extra.get("lang"), extra.get("source"), None if t is None else len(t), 1, "h", "rep", "row", 0) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def edge_texts():
    rng = random.Random(5)
    long = " ".join(words(rng, 3000))
    same = " ".join(words(rng, 40))
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, same), (6, same), (6, same), (7, long), (None, same), (9, same.replace("w1", "x1", 1)), (10, "!!! ... 123"), (11, "Ünï cödé 漢字 " + same)]
