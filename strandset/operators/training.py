"""Prompts, targets and training rows; the audit of compiled labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandset.functions.text import exact_match, hash_bucket, normalize, normalize_all
from strandset.operators.compiler import compile_labels
from strandset.operators.program import rendered
from strandset.operators.vm import execute

#: What each task asks for, after the documents.
TASKS = {
    "program": "Compile an executable evidence program.", "answer": "Answer inside one <ANSWER> tag.", "citation": "Give one <CITATION> object with the answer and its evidence pairs.",
    "free_literal": "Compile an executable evidence program with a literal answer.",
}


#: What a model is told first.
SYSTEMS = {
    "program": "Answer by a program over the numbered sentences: cite evidence, join documents through quoted text, reduce quoted values.", "answer": "Answer the question with the shortest text that the documents hold.",
    "citation": "Answer the question and cite each sentence that the answer needs.", "free_literal": "Cite evidence and join documents through quoted text; write the answer as a literal.",
}


def messages(task: str = "program", reply: Column | None = None, system: bool = True) -> Column:
    """The chat of a context row: what the model is told, the documents, and the wanted output where there is one."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(*([say("system", F.lit(SYSTEMS[task]))] if system else []), say("user", context_text(task)), *([say("assistant", reply)] if reply is not None else []))


def context_text(task: str = "program") -> Column:
    """The question and the numbered documents as text."""
    lines = F.flatten(
        F.transform(
            "documents",
            lambda d: F.concat(
                F.array(F.concat(F.lit("[D"), d["doc"], F.lit(":TITLE] "), d["title"])),
                F.transform(d["sentences"], lambda s, i: F.concat(F.lit("[D"), d["doc"], F.lit(":S"), i, F.lit("] "), s)),
            ),
        )
    )
    return F.concat_ws("\n", F.concat(F.lit("Question: "), F.col("question")), F.lit("Documents:"), F.array_join(lines, "\n"), F.lit(TASKS[task]))


def target(task: str = "program") -> Column:
    """The wanted output of a row with program and answers under a task."""
    first = F.coalesce(F.get("answers", F.lit(0)), F.lit(""))
    cited = F.to_json(F.struct(first.alias("answer"), F.transform("program.evidence", lambda r: F.array(r["doc"], r["sent"])).alias("evidence")))
    program = F.col("program")
    literal = program.withField("answer", program["answer"].withField("op", F.lit("literal")).withField("value", first))
    tag = lambda name, body: F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))
    return {"program": tag("PROGRAM", rendered(program)), "answer": tag("ANSWER", first), "citation": tag("CITATION", cited), "free_literal": tag("PROGRAM", rendered(literal))}[task]


def training_rows(contexts: DataFrame, task: str = "program", holdout: float = 0.05, strict: bool = True, system: bool = False) -> DataFrame:
    """(id, dataset, part, messages, strict_valid): compiled rows without literal answers, split by the digest of their id."""
    rows = execute(compile_labels(contexts)).where("program is not null and program.answer.op != 'literal'")
    if strict:
        rows = rows.where("result.valid")
    id = F.concat_ws(":", "dataset", "qid")
    part = F.when(hash_bucket(id) < int(holdout * 10_000), "holdout").otherwise("train")
    return rows.select(id.alias("id"), "dataset", part.alias("part"), messages(task, target(task), system).alias("messages"), F.col("result.valid").alias("strict_valid"))


def audit(contexts: DataFrame) -> DataFrame:
    """One row a dataset: examples, compiled, valid, certified, right, and rows by answer operator."""
    rows = execute(compile_labels(contexts)).withColumns({"__p": normalize(F.coalesce("result.answer", F.lit(""))), "__a": normalize_all("answers")})
    right = F.coalesce(F.col("result.valid"), F.lit(False)) & (exact_match(F.col("__p"), F.col("__a")) == 1)
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    ops = ("copy", "bool", "literal", "argmin", "argmax", "equal", "common")
    return rows.groupBy("dataset").agg(
        F.count("*").alias("examples"), n(F.col("program").isNotNull()).alias("compiled"), n(F.col("result.valid")).alias("valid"), n(F.col("result.certified")).alias("certified"), n(right).alias("right"),
        *[n(F.col("program.answer.op") == o).alias(o) for o in ops],
    )
