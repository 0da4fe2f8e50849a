from pyspark.sql import functions as F
from test_lineage import bound, changed
from test_vm import DOCS, context, program

from strandset.schema import CONTEXT
from strandset.streaming.refresh import joined_feed, refresh_feed


def streams(spark, tmp_path):
    """Folders of two streams, and functions that add to them."""
    kinds = {}

    def add(name, rows):
        rows.write.mode("append").parquet(str(tmp_path / name))
        kinds[name] = rows.schema

    return add, lambda name: spark.readStream.schema(kinds[name]).parquet(str(tmp_path / name))


def contexts(spark, *rows):
    """(qid, version, documents)"""
    made = [context(q, docs) for q, _, docs in rows]
    return spark.createDataFrame(made, CONTEXT).select("qid", "question", "documents").withColumn("version", F.lit(None).cast("int")).limit(0).unionByName(
        spark.createDataFrame([(m[1], v, m[3], m[4]) for m, (_, v, _) in zip(made, rows)], f"qid string, version int, question string, {CONTEXT.split(', ')[4]}")
    )


def results(spark, *places):
    n = max(places) + 1
    rows = bound(spark, [program()] * n, [context(f"q{i}") for i in range(n)]).withColumns({"cached_answer": F.col("result.answer"), "version": F.lit(0)})
    return rows.where(F.col("qid").isin([f"q{i}" for i in places])).select("qid", "version", "dataset", "program", "cached_answer", "snapshot")


READ, OTHER, MORE = changed(DOCS, 1, 0, "Ada Writer was born in Delta City, they say."), changed(DOCS, 2, 0, "New."), [*DOCS, ("More", ["One."])]


def test_versions_out_of_order_give_one_right_action(spark, tmp_path):
    add, stream = streams(spark, tmp_path)
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def step():
        refresh_feed(stream("changes"), stream("cached"), sink, checkpoint).awaitTermination(180)
        rows = spark.read.parquet(sink).collect()
        return sorted((r.batch, r.qid, r.version, r.action) for r in rows)

    add("cached", results(spark, 0, 1, 2))
    add("changes", contexts(spark, ("q0", 2, MORE), ("q1", 1, READ), ("q1", 3, OTHER), ("q3", 1, OTHER), ("q1", None, MORE)))
    first = [(0, "q0", 2, "recompile"), (0, "q1", 3, "reuse")]
    assert step() == first
    add("changes", contexts(spark, ("q0", 1, OTHER), ("q1", 2, MORE), ("q2", 1, READ), ("q0", 2, OTHER)))
    second = [(1, "q2", 1, "replay")]
    assert step() == first + second
    add("cached", results(spark, 3).unionByName(results(spark, 0).withColumn("version", F.lit(2))))
    third = [(2, "q3", 1, "reuse")]
    assert step() == first + second + third
    add("changes", contexts(spark, ("q0", 3, READ)))
    assert step() == first + second + third + [(3, "q0", 3, "replay")]
    assert {r.new_answer for r in spark.read.parquet(sink).where("action <> 'recompile'").collect()} == {"Delta City"}


def test_a_batch_touches_its_own_questions(spark, tmp_path):
    add, stream = streams(spark, tmp_path)
    seen = []

    def step():
        query = joined_feed(stream("changes"), stream("cached")).writeStream.foreachBatch(lambda b, _: seen.append(sorted(r.qid for r in b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        own = [s for p in query.recentProgress for s in p["stateOperators"]]
        return max(s["numRowsTotal"] for s in own), sum(s["numRowsUpdated"] for s in own)

    add("cached", results(spark, *range(20)))
    add("changes", contexts(spark, ("q1", 1, OTHER)))
    assert step() == (20, 20)
    add("changes", contexts(spark, ("q2", 1, OTHER), ("q3", 1, OTHER)))
    assert step() == (20, 2) and seen == [["q1"], ["q2", "q3"]]
