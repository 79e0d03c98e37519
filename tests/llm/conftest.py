import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("id", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names clash with those inside the operators."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "x", None, len(t or "")) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, repeated rows, nulls, empty and long texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(300), prose(90)
    near = base.split()
    rows = [(0, base), (1, base), (2, None), (3, ""), (4, "  \n"), (5, "one two"), (6, "one two"), (7, prose(20))]
    for k in range(8, 20):
        changed = list(near)
        for _ in range(k - 7):
            changed[rng.randrange(len(changed))] = word()
        rows.append((k, " ".join(changed)))
    rows += [(k, prose(60) + " " + passage + "\n" + prose(40)) for k in range(20, 32)]
    rows += [(32, "ab" * 900), (33, "x" * 1500), (34, prose(5000)), (35, passage), (36, "é" * 400 + prose(3)), (37, "ê" + "é" * 350)]
    twice = prose(120)
    rows += [(38, prose(120)), (38, prose(120)), (39, twice), (39, twice), (None, prose(100)), (None, base), (40, passage + " " + passage)]
    return rows
