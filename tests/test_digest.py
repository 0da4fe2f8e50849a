import json
from hashlib import sha256

from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_lineage import bound
from test_vm import context, pairs, program, ptr

from strandset.operators.lineage import bound_as_committed
from strandset.operators.program import canonical_json, canonical_program, program_digest, read

#: Digests of sorted compact JSON made by Python's json and hashlib; the first is that of ``program()``.
ODD = ["plain", 'quote " and \\ and / slash', "tab\tline\nreturn\r\b\f", "\x00\x0b\x0e\x0f\x1a\x1b\x1c\x1d\x1e\x1f\x7f", "\\u000B stays, \\\\u001F too, \\\x1f", "é 中文 \U0001f600    <&>", ""]


def by_python(p):
    """The digest of a read program by Python: evidence as pairs, metadata left out."""
    found = read(json.dumps(p))
    found["evidence"] = [[r["doc"], r["sent"]] for r in found["evidence"]]
    text = json.dumps(found, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return text, sha256(text.encode()).hexdigest()


def test_fixed_digests(spark):
    programs = [program(), program(metadata={"note": "left out"}, version=1)]
    programs += [program(mode=x, answer={"op": "literal", "value": x, "labels": [ptr(0, 0, x)], "operands": [ptr(1, 2, start=3, end=4)] * 2}) for x in ODD]
    programs += [program(joins=[], evidence=[], answer={"op": "bool", "value": "yes"})]
    rows = pairs(spark, programs, [context(f"q{i}") for i in range(len(programs))]).select("qid", canonical_program().alias("text"), program_digest().alias("digest")).collect()
    got = {r.qid: (r.text, r.digest) for r in rows}
    assert got == {f"q{i}": by_python(p) for i, p in enumerate(programs)}
    assert got["q0"] == got["q1"] and got["q0"][1] == "2f53522acf8ba31d3fbb389e4335c0ce5a2be273c90ee6a5762e9545e4494536"


def test_order_of_fields_and_nulls(spark):
    one = spark.sql("SELECT named_struct('b', 1, 'a', array(named_struct('z', CAST(NULL AS STRING), 'y', 2), NULL), 'c', CAST(NULL AS STRUCT<x:INT>)) AS s")
    two = spark.sql("SELECT named_struct('c', CAST(NULL AS STRUCT<x:INT>), 'a', array(named_struct('y', 2, 'z', CAST(NULL AS STRING)), NULL), 'b', 1) AS s")
    want = '{"a":[{"y":2,"z":null},null],"b":1,"c":null}'
    assert [df.select(canonical_json(F.col("s"), df.schema["s"].dataType)).first()[0] for df in (one, two)] == [want, want]
    null = spark.sql("SELECT CAST(NULL AS STRUCT<x:INT>) AS s")
    assert null.select(canonical_json(F.col("s"), null.schema["s"].dataType)).first()[0] is None and isinstance(null.schema["s"].dataType, T.StructType)


def test_a_digest_made_elsewhere_verifies(spark):
    rows = bound(spark)
    s = rows.first().snapshot
    assert s.program_sha256 == by_python(program())[1]
    said = rows.select(bound_as_committed("program", F.col("result.answer"), F.col("snapshot")), bound_as_committed("program", F.lit("x"), F.col("snapshot")))
    assert tuple(said.first()) == (True, False)
