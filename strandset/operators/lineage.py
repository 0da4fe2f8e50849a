"""Snapshots of the cells that a result depends on, and what to do with a cached result when cells change."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandset.functions.constants import SEMANTICS
from strandset.functions.text import fold, text_digest
from strandset.functions.udf import arrow_udf, once
from strandset.operators.program import program_digest
from strandset.operators.vm import execute
from strandset.schema import CELL

KEYS = "array<struct<field:string,doc:int,sent:int>>"


@arrow_udf("array<array<string>>")
def fold_nested(lists: pd.Series) -> pd.Series:
    return lists.map(lambda rows: None if rows is None else [[fold(x) for x in r] for r in rows])


def key(field: Column | str, doc: Column, sent: Column) -> Column:
    return F.struct((F.lit(field) if isinstance(field, str) else field).alias("field"), doc.cast("int").alias("doc"), sent.cast("int").alias("sent"))


def cell_text(k: Column, documents: Column, question: Column) -> Column:
    """The text of a cell, null where it is missing."""
    d = F.get(documents, k["doc"])
    return F.when(k["field"] == "question", F.when((k["doc"] == -1) & (k["sent"] == -1), question)).when(k["field"] == "title", d["title"]).otherwise(F.get(d["sentences"], k["sent"]))


def structure_digest(documents: Column) -> Column:
    """Digest of the numbers of sentences by document, as a JSON list of pairs."""
    pairs = F.transform(documents, lambda d: F.concat(F.lit("["), d["doc"].cast("string"), F.lit(","), F.size(d["sentences"]).cast("string"), F.lit("]")))
    return text_digest(F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]")))


def document_digest(document: Column) -> Column:
    return text_digest(F.to_json(F.concat(F.array(document["title"]), document["sentences"])))


def answer_pointers(program: Column) -> Column:
    """Operands, labels, then the answer pointer."""
    a = program["answer"]
    return F.concat(a["operands"], a["labels"], F.filter(F.array(a["pointer"]), lambda p: p.isNotNull()))


def bind(rows: DataFrame, result: str = "result", into: str = "snapshot") -> DataFrame:
    """Adds ``into``: the snapshot of each valid result (null for others).

    Bound are cited sentences, the cells of answer pointers and of join anchors, and for each join one witness: the title
    when it holds the anchor's quote, else the first sentence that does; without one the title and, unless the join
    reads titles only, all sentences of the document."""
    folded, snapshot = _snapshot(result)
    return rows.withColumn("__folded", folded).withColumn(into, snapshot).drop("__folded")


@once
def _snapshot(result: str) -> tuple[Column, Column]:
    """The folded texts of joins, and the snapshot that reads them as ``__folded``."""
    program, documents = F.col("program"), F.col("documents")
    right = lambda j: F.get(documents, j["right_doc"])
    valid = F.coalesce(F.col(f"{result}.valid"), F.lit(False))
    texts = F.transform(program["joins"], lambda j: F.concat(F.array(j["left"]["quote"], right(j)["title"]), right(j)["sentences"]))

    def witness(j, i):
        folded = F.get(F.col("__folded"), i)
        quote, title = F.get(folded, F.lit(0)), F.get(folded, F.lit(1))
        found = F.filter(F.sequence(F.lit(0), F.size(right(j)["sentences"])), lambda s: F.contains(F.get(folded, s + 2), quote))
        whole = F.concat(F.array(key("title", j["right_doc"], F.lit(-1))), F.transform(right(j)["sentences"], lambda _, s: key("sentence", j["right_doc"], s)))
        only_title = F.array(key("title", j["right_doc"], F.lit(-1)))
        return (
            F.when((quote != "") & F.contains(title, quote), only_title)
            .when(j["right_field"] == "title", only_title)
            .when((quote != "") & (F.size(found) > 0), F.array(key("sentence", j["right_doc"], F.get(found, F.lit(0)))))
            .otherwise(whole)
        )

    keys = F.concat(
        F.transform(program["evidence"], lambda r: key("sentence", r["doc"], r["sent"])),
        F.transform(answer_pointers(program), lambda p: key(p["field"], p["doc"], p["sent"])),
        F.transform(program["joins"], lambda j: key(j["left"]["field"], j["left"]["doc"], j["left"]["sent"])),
        F.flatten(F.transform(program["joins"], witness)),
    )
    cells = F.transform(
        F.array_sort(F.array_distinct(keys)),
        lambda k: F.struct(k["field"].alias("field"), k["doc"].alias("doc"), k["sent"].alias("sent"), text_digest(cell_text(k, documents, F.col("question"))).alias("sha256")),
    )
    snapshot = F.struct(
        F.col("dataset"), F.col("qid"), F.lit(SEMANTICS).alias("semantics"), program_digest("program").alias("program_sha256"), text_digest(F.col(f"{result}.answer")).alias("answer_sha256"),
        structure_digest(documents).alias("structure_sha256"), F.col(f"{result}.certified").alias("certified"), cells.cast(f"array<{CELL}>").alias("cells"),
    )
    return fold_nested(F.when(valid, texts)), F.when(valid, snapshot)


def check_of(s: Column, dataset: Column, qid: Column, question: Column, documents: Column) -> Column:
    """Struct (current, changed, missing, structure_changed) of snapshot ``s`` against a context."""
    plain = lambda cells: F.transform(cells, lambda c: key(c["field"], c["doc"], c["sent"]))
    same = (dataset == s["dataset"]) & (qid == s["qid"])
    missing = plain(F.filter(s["cells"], lambda c: cell_text(c, documents, question).isNull()))
    changed = plain(F.filter(s["cells"], lambda c: cell_text(c, documents, question).isNotNull() & (text_digest(cell_text(c, documents, question)) != c["sha256"])))
    structure = structure_digest(documents) != s["structure_sha256"]
    other = F.array(key("question", F.lit(-1), F.lit(-1)))
    none = F.array().cast(KEYS)
    changed, missing, structure = F.when(same, changed).otherwise(none), F.when(same, missing).otherwise(other), F.when(same, structure).otherwise(False)
    current = same & (F.size(changed) == 0) & (F.size(missing) == 0) & ~structure
    return F.struct(current.alias("current"), changed.alias("changed"), missing.alias("missing"), structure.alias("structure_changed"))


def verify(rows: DataFrame, snapshot: str = "snapshot", into: str = "check") -> DataFrame:
    """Adds ``into``: struct (current, changed, missing, structure_changed) of a snapshot against the row's context."""
    return rows.withColumn(into, _check(snapshot))


@once
def _check(snapshot: str) -> Column:
    s = F.col(snapshot)
    return F.when(s.isNotNull(), check_of(s, F.col("dataset"), F.col("qid"), F.col("question"), F.col("documents")))


def bound_as_committed(program: str, answer: Column, snapshot: Column) -> Column:
    return (snapshot["semantics"] == SEMANTICS) & (snapshot["program_sha256"] == program_digest(program)) & (snapshot["answer_sha256"] == text_digest(answer))


def refresh(rows: DataFrame, cached: str = "cached_answer", snapshot: str = "snapshot") -> DataFrame:
    """Adds action (reuse, replay, recompile), new_answer, new_snapshot and refresh_errors.

    Digests decide first; only certified results whose read cells changed, and nothing else, are executed again."""
    s = F.col(snapshot)
    step = (
        F.when(~bound_as_committed("program", F.col(cached), s), "unbound")
        .when(F.col("__check.current"), "reuse")
        .when(F.col("__check.structure_changed"), "structure")
        .when(~s["certified"], "uncertified")
        .otherwise("replay")
    )
    staged = verify(rows, snapshot, "__check").withColumn("__step", step)
    texts = {
        "unbound": "cached program, answer, or VM version does not match snapshot", "structure": "source cell-ID domain changed by an insertion or deletion",
        "uncertified": "stale result is not certified for deterministic VM replay",
    }
    why = F.coalesce(*[F.when(F.col("__step") == k, F.array(F.lit(v))) for k, v in texts.items()], F.array().cast("array<string>"))
    reuse, replay, again = F.col("__step") == "reuse", F.col("__step") == "replay", F.col("__again")
    # a row that isn't replayed has no program while programs run, which costs nothing
    ran = staged.withColumns({"__program": F.col("program"), "program": F.when(replay, F.col("program"))})
    ran = bind(execute(ran, into="__again"), "__again", "new_snapshot").withColumn("program", F.col("__program"))
    return ran.withColumns(
        {
            "action": F.when(reuse, "reuse").when(replay & again["valid"], "replay").otherwise("recompile"), "new_answer": F.when(reuse, F.col(cached)).when(replay, again["answer"]).otherwise(""),
            "new_snapshot": F.when(reuse, s).otherwise(F.col("new_snapshot")), "refresh_errors": F.when(replay, again["errors"]).otherwise(why),
        }
    ).drop("__check", "__step", "__program", "__again")
