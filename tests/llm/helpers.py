"""Documents with every awkward case, for all operators."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, recipe string, shard string, key string, `a.b` int"
PLAIN = "the house by the river is old and the garden behind it is full of apple trees that nobody has cut for many years"


def docs(spark, texts, first=0, langs=None):
    rows = [(i + first, t, (langs or {}).get(i, "en"), "s", len(t or ""), "r", "x", "y", "z", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, clashing names."""
    texts = [None, "", " \t\n", PLAIN, PLAIN, PLAIN + " ", "12 34 %%", "é" * 50, "x" * 30_000, PLAIN * 400, "<|endoftext|>", "two\x00\u2028words"]
    df = docs(spark, texts)
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None, None, None, None), (None, PLAIN, None, None, None, None, None, None, None, None)], SCHEMA)
    return df.unionByName(df.where("doc_id IN (3, 9)")).unionByName(nulls)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]
