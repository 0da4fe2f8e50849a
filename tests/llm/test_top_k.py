import math
import random

from pyspark.sql import functions as F

from strandset.llm.top_k import top_k


def brute(rows, k=5):
    fit = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in fit:
        if qi % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in fit if i != qi and len(v) == len(q))
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(1)
    for dims, spread in ((8, 1.0), (3, 30.0), (1, 0.01)):
        rows = [(i, [r.gauss(0, 1) * math.exp(r.gauss(0, 1)) * spread for _ in range(dims)]) for i in range(1500)]
        rows += [(1500 + i, rows[i % 7][1]) for i in range(200)]
        rows += [(2000, None), (2050, [None] * dims), (2100, [float("nan")] * dims), (2150, [float("inf")] * dims), (2200, [0.0] * dims), (2250, []), (2251, []), (2300, [1.0] * 11)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
        got = sorted(tuple(x) for x in top_k(df, F.col("vec_id") % 50 == 0).collect())
        assert got == brute(rows)


def test_huge_components_empty_table_and_equal_rows(spark):
    rows = [(0, [1e14, -1e14]), (1, [1e14, 1e13]), (2, [-1e5, 2.0]), (50, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert sorted(tuple(x) for x in top_k(df, F.col("vec_id") % 50 == 0).collect()) == [(a, b, c, clip(d)) for a, b, c, d in brute(rows)]
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    same = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (7, [2.0]), (7, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in top_k(same, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(0, 1, 7, 131072), (0, 2, 7, 131072)]
