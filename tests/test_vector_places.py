from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cdrloom.operators import features as X
from cdrloom.plans import queries_sequence as Q

LOOPS = [("1", "ACDEFW"), ("2", "WWWWWW"), ("3", "AC"), ("4", None), ("5", "aXCD*W"), ("6", "GGGG")]


def test_kmer_l2_blosum_reads_stored_places_only(spark, monkeypatch):
    table = spark.createDataFrame(LOOPS, "barcode string, cdr3 string")
    monkeypatch.setattr(Q, "antibodies", lambda spark, sf: table)
    out = Q.kmer_l2_blosum(spark, "")
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "unwrap_udt" in text and "element_at(UDF" not in text  # no array of 8,441 places
    got = {r["barcode"]: (r["filled"], r["total"], r["blosum"]) for r in out.collect()}
    dense = X.kmer_l2_vectors(table, "cdr3", "v", use_blosum=True).select("barcode", vector_to_array("v").alias("x"))
    want = {r["barcode"]: (sum(v != 0 for v in r["x"]), round(sum(r["x"]), 6), round(r["x"][-1], 6)) for r in dense.collect()}
    assert got.keys() == want.keys()
    assert all(abs(g - w) < 2e-6 for k in want for g, w in zip(got[k], want[k]))
