"""SQL of the query catalogue against plain Python, and joins with models that fail."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cdrloom import constants as K
from cdrloom.functions import alignment as A, special
from cdrloom.operators import joins
from cdrloom.plans.queries_models import PAM30_EDIT, alignment_sql
from cdrloom.plans.queries_stats import corr_tail_sql, stars_sql, tail_sql


@pytest.mark.parametrize("t,dof", [(0.0, 1), (0.3, 2), (-1.7, 5.5), (2.4, 48), (3.1, 2700), (12.0, 10), (0.02, 60000)])
def test_tail_in_sql(t, dof):
    found = duckdb.sql(f"SELECT {tail_sql('t', 'dof')} FROM (SELECT {t}::DOUBLE AS t, {dof}::DOUBLE AS dof)").fetchall()[0][0]
    assert found == pytest.approx(special.t_two_sided(t, dof), abs=1e-8)


def test_perfect_correlation_and_stars_in_sql():
    assert duckdb.sql(f"SELECT {corr_tail_sql('r', 'n')} FROM (SELECT 1.0::DOUBLE AS r, 9 AS n)").fetchall()[0][0] == 0
    marks = duckdb.sql(f"SELECT {stars_sql('p')} FROM (SELECT unnest([0.0001, 0.001, 0.01, 0.05]) AS p)").fetchall()
    assert [m for m, in marks] == ["***", "**", "*", "ns"]


@pytest.mark.parametrize("matrix,unknown,gap_open,array", [(K.BLOSUM62, -4, -10, A.BLOSUM62_ARRAY), (K.PAM30, -17, -9, A.PAM30_ARRAY)])
def test_alignment_in_sql(matrix, unknown, gap_open, array):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(K.AMINO_ACIDS) for _ in range(rng.randint(1, 14)))
    pairs = [(str(k), word(), word()) for k in range(60)]
    pairs += [(f"n{k}", a, a[:3] + word()[:2] + a[5:]) for k, a, _ in pairs[:20] if len(a) > 6]
    con = duckdb.connect()
    con.execute("CREATE TABLE p (id VARCHAR, a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?)", pairs)
    found = dict(con.sql(f"WITH RECURSIVE {alignment_sql('p', 'id', matrix, unknown, gap_open, -1)} SELECT id, score FROM aligned").fetchall())
    scores = A.global_scores([a for _, a, _ in pairs], [b for _, _, b in pairs], array, gap_open, -1)
    assert found == {k: int(v) for (k, _, _), v in zip(pairs, scores)}


def test_an_edit_costs_what_the_join_assumes():
    """No alignment scores above the mean of both self scores minus the cost of its edits."""
    rng = random.Random(5)
    cells = K.triangle(K.PAM30)
    own = lambda s: sum(cells[x, x] for x in s)
    word = lambda n: "".join(rng.choice(K.AMINO_ACIDS) for _ in range(n))
    pairs = [(word(rng.randint(1, 12)), word(rng.randint(1, 12))) for _ in range(300)]
    pairs += [(a, a[:2] + word(1) + a[3:]) for a, _ in pairs[:100] if len(a) > 3]
    scores = A.global_scores([a for a, _ in pairs], [b for _, b in pairs], A.PAM30_ARRAY, -9, -1)

    def edits(a, b):
        row = np.arange(len(b) + 1)
        for i, x in enumerate(a, 1):
            last, row = row, np.array([i] + [0] * len(b))
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return int(row[-1])

    assert all(s <= (own(a) + own(b)) / 2 - PAM30_EDIT * edits(a, b) for (a, b), s in zip(pairs, scores))


def test_models_that_fail_early_or_while_scoring_are_left_out(spark):
    base = spark.createDataFrame([("a",), ("b",)], "barcode string")

    def early():
        raise RuntimeError("no stored model")

    late = lambda: base.select("barcode", F.raise_error(F.lit("broken model")).cast("double").alias("score"))
    twice = lambda: spark.createDataFrame([("a", 0.2), ("a", 0.9)], "barcode string, score double")
    wide, failed = joins.multi_model_scores(base, {"early": early, "late": late, "twice": twice})
    assert sorted(failed) == ["early", "late"] and "broken model" in failed["late"]
    rows = {r.barcode: (r.twice_score, r.twice_label) for r in wide.collect()}
    assert rows == {"a": (0.9, 1), "b": (None, None)}
    nothing, failed = joins.multi_model_scores(base, {"early": early})
    assert nothing.columns == ["barcode"] and list(failed) == ["early"]
