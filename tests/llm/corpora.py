"""Small hand-made tables for the corpus operators."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_df(spark, texts, extra=False, first=0):
    """texts: strings or (doc_id, text, lang, source)."""
    rows = []
    for k, t in enumerate(texts):
        doc_id, text, lang, source = t if isinstance(t, tuple) else (first + k, t, "en", f"s{k % 3}")
        rows.append((doc_id, text, lang, source, None if text is None else len(text)))
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("key", "size", "kept", "path", "digest", "slot", "place", "level", "start", "items"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


EDGES = [
    (None, None, None, None), (None, "no number", "en", None), (1, "", "en", "a"), (2, None, "fr", "a"), (3, "a", None, None),
    (4, "same text here", "en", "b"), (4, "same text here", "en", "b"), (5, "SAME text here", "en", "b"), (6, "\n\n\n", "de", "b"),
    (7, "12 34 !? %%", "de", "c"), (8, "Ünï cödé 漢字 🙂 " * 3, "de", "c"), (9, "long " * 30_000, "en", "c"),
]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
