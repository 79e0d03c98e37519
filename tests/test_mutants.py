from pyspark.sql import functions as F

from cdrloom.functions.sequence import residues
from cdrloom.operators import mutants as U

ROWS = [("a", "ACD", "QQACDWW"), ("a", "WY", "QWYQ"), ("b", "acx", None), ("c", "XX", "QXXQ"), (None, "AC", "AC"), ("d", "", "Q")]


def table(spark):
    return spark.createDataFrame(ROWS, "barcode string, cdr3 string, hseq string")


def tryptophans(df):
    """No score where the loop holds an R."""
    return df.withColumn("score", F.when(~F.col("cdr3").contains("R"), residues(F.col("cdr3"), "W") + F.length("cdr3") / 10))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def expected():
    score = lambda s: None if "R" in s else s.count("W") + len(s) / 10
    made = [(k, i + 1, s[i], m, s[:i] + m + s[i + 1:]) for k, s, _ in [(k, s.upper(), h) for k, s, h in ROWS] for i in range(len(s)) for m in U.AMINO_ACIDS]
    parent = {}
    for k, _, wt, m, s in made:
        if k is not None and wt == m and score(s) is not None:
            parent[k] = max(parent.get(k, -1.0), score(s))
    out = []
    for k, i, wt, m, s in made:
        own = parent.get(k) if score(s) is None else score(s)
        out.append((k, i, wt, m, own, None if own is None or k not in parent else own - parent[k]))
    return out


def ordered(rows):
    return sorted([tuple("" if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in rows], key=str)


def test_residues_counts_each_letter(spark):
    df = spark.createDataFrame([("DDEKA",), ("",), (None,)], "s string")
    assert [r["n"] for r in df.select(residues(F.col("s"), "DE").alias("n")).collect()] == [3, 0, None]


def test_scan_equals_brute_force_with_repeated_and_null_keys(spark):
    assert ordered(U.scan(table(spark), tryptophans).collect()) == ordered(expected())


def test_scan_shuffles_antibodies_and_no_mutants(spark):
    text = plan(U.scan(table(spark), tryptophans))
    assert text.index("transform([A,C,D") < text.index("Exchange")  # mutants are made above every exchange


def test_matrix_moves_no_mutant_by_position(spark):
    out = U.scan_matrix(U.scan(table(spark), tryptophans))
    assert "pivotfirst" not in plan(out)
    assert out.columns == ["barcode", "mut", "1", "2", "3"]
    got = {(r["barcode"], r["mut"]): (r["1"], r["2"], r["3"]) for r in out.where("barcode = 'a'").collect()}
    assert len(got) == 20 and got["a", "W"] == (1.3, 2.2, 1.3) and got["a", "R"] == (1.2, 1.2, 1.2)


def test_summary_of_a_scan_shuffles_no_mutants(spark):
    out = U.scan_summary(U.scan(table(spark).where("barcode = 'b'"), tryptophans))
    text = plan(out)
    assert text.index("transform([A,C,D") < text.index("Exchange")
    row = out.first()
    assert (row["n"], row["best_mut"], row["worst_mut"], row["worst_pos"], round(row["best_delta"], 9)) == (60, "W", "A", 1, 1.0)
