import random

import pytest
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


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text), or with lang and source; any column may be null."""

    def make(rows, extra=()):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, *("en", "src0")[len(row) - 2 :])[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text), *extra))
        schema = T.StructType([*DOCS.fields, *[T.StructField(f"_{i}", T.StringType()) for i in range(len(extra))]])
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def prose():
    """A text of n words that another seed does not share."""

    def make(n, seed=0, words=400):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(words)}" for _ in range(n))

    return make
