"""Small document tables for the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    """rows: (doc_id, text); extra adds columns whose names clash with the operators' own."""
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    if extra:
        from pyspark.sql import functions as F

        d = d.withColumns({c: F.lit("x") for c in ("fp", "key", "length", "start", "piece", "score", "component_id", "_b", "_key", "ids", "word", "label")})
    return d


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


def edge_rows():
    """Nulls, blanks, ties, repeats, long and odd texts."""
    long = prose(1, 30_000)
    return [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "one"), (4, "one"), (5, long), (6, long), (7, "Ünïcode — ‘quotes’ 日本語 <|endoftext|>"), (8, "a" * 5000), (None, "no id"), (9, "tie tie tie tie tie")]
