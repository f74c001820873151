import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
#: Columns with names that operators use themselves.
CLASH = ["n_words", "kept", "node", "component", "tab", "text_key", "label", "x", "keys", "len", "prefix", "num", "score", "words", "lines", "__d", "__k", "__t", "__key", "__keep"]


@pytest.fixture(scope="session")
def table(spark):
    """Makes a documents table of (id, text) pairs, with more columns whose names clash."""

    def make(rows, clash=True):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
        return df.withColumns({c: F.lit("clash") for c in CLASH}) if clash else df

    return make


@pytest.fixture(scope="session")
def prose():
    """Texts of ``n`` distinct invented words, the same for the same seed."""

    def make(n, seed=0):
        import random

        r = random.Random(seed)
        return " ".join("".join(r.choice("aeiouklmnrst") for _ in range(r.randint(3, 9))) + (". Next" if k % 9 == 8 else "") for k in range(n)) + "."

    return make
