"""Small tables with every awkward case, and plain Python versions to compare with."""

import re

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def docs(spark, rows, extra=()):
    """Documents from (doc_id, text[, lang[, source]]), with extra string columns of the given names."""
    schema = T.StructType([*DOCS, *[T.StructField(n, T.StringType()) for n in extra]])
    full = [(r + (None,) * 4)[:4] for r in rows]
    table = [(i, t, g, s, None if t is None else len(t), *["x"] * len(extra)) for i, t, g, s in full]
    return spark.createDataFrame(table, schema).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


class Union:
    def __init__(self, items):
        self.of = {i: i for i in items}

    def find(self, x):
        while self.of[x] != x:
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)
