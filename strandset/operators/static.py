"""What a program answers by its own quotes, without a context, and outputs rewritten under the other protocols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandset.functions.text import canonical, normalize_all, ordered_scalar
from strandset.operators.program import rendered


def static_answers(rows: DataFrame, into: str = "static_answer") -> DataFrame:
    """Adds ``into``: the answer by quotes; null where the program has none (no pointer or operands, values that can't be ordered, labels
    that don't match the operands, an unknown operator)."""
    answer = F.col("program.answer")
    quotes = F.transform(answer["operands"], lambda p: p["quote"])
    rows = rows.withColumn("__normal", normalize_all(quotes))
    same = F.size(F.array_distinct(F.transform("__normal", canonical))) == 1
    keys = F.transform(quotes, ordered_scalar)
    ordered = (F.size(keys) > 0) & F.forall(keys, lambda k: k.isNotNull()) & (F.size(answer["labels"]) == F.size(keys))
    first = lambda best: F.get(answer["labels"], F.array_position(keys, best).cast("int") - 1)["quote"]
    op = answer["op"]
    value = (
        F.when(op == "copy", answer["pointer"]["quote"]).when(op.isin("bool", "literal"), answer["value"]).when(op == "common", F.get(quotes, F.lit(0)))
        .when(op == "equal", F.when(same, "yes").otherwise("no")).when((op == "argmin") & ordered, first(F.array_min(keys))).when((op == "argmax") & ordered, first(F.array_max(keys)))
    )
    return rows.withColumn(into, value).drop("__normal")


def rewritten(rows: DataFrame, task: str, into: str = "target") -> DataFrame:
    """Adds ``into``: the output that a program's row has under the answer, citation or free_literal protocol, by its static answer (null
    without one)."""
    rows = static_answers(rows, "__static")
    program, value = F.col("program"), F.col("__static")
    if task == "answer":
        out = F.concat(F.lit("<ANSWER>"), value, F.lit("</ANSWER>"))
    elif task == "citation":
        body = F.to_json(F.struct(value.alias("answer"), F.transform(program["evidence"], lambda r: F.array(r["doc"], r["sent"])).alias("evidence")))
        out = F.concat(F.lit("<CITATION>"), body, F.lit("</CITATION>"))
    else:
        answer = program["answer"].withField("op", F.lit("literal")).withField("value", value).withField("pointer", F.lit(None).cast(dict(rows.select("program.answer.pointer").dtypes)["pointer"]))
        answer = answer.withField("operands", F.slice(answer["operands"], 1, 0)).withField("labels", F.slice(answer["labels"], 1, 0))
        out = F.concat(F.lit("<PROGRAM>"), rendered(program.withField("answer", answer)), F.lit("</PROGRAM>"))
    return rows.withColumn(into, F.when(value.isNotNull(), out)).drop("__static")
