"""Executing programs over their contexts: one row in, one row out, no shuffle.

``checked`` works in three projections: pointers, evidence and right sides of joins are resolved to texts, so that rows can leave their documents
behind; all texts that are compared are normalised in one Arrow call; checks and reductions are expressions on arrays. Errors are texts in the order of their checks. ``execute`` and
``contracts`` only choose which groups of checks count, so that all contracts share one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandset.functions.constants import GROUNDED
from strandset.functions.text import canonical, normalize_all, ordered_scalar
from strandset.functions.udf import once

TEXTS = "array<string>"
LITERAL = "ungrounded literal answer is disabled"


def _none(kind: str = TEXTS) -> Column:
    return F.array().cast(kind)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed, and written in the plan, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def resolved(pointer: Column, documents: Column, question: Column, label: Column) -> Column:
    """Struct (value, errors) of a pointer."""
    asks = pointer["field"] == "question"

    def with_document(found):
        document = found["d"]
        there = document.isNotNull()
        sentence = F.get(document["sentences"], pointer["sent"])
        read = F.when(~there, question).when(pointer["field"] == "title", document["title"]).otherwise(sentence)
        early = (
            F.when(~there & ~asks, "document out of range")
            .when(there & (pointer["field"] == "sentence") & sentence.isNull(), "sentence out of range")
            .when(there & ~pointer["field"].isin("title", "sentence"), "invalid pointer field")
        )
        return let(F.struct(read.alias("source"), early.alias("early")), with_source)

    def with_source(found):
        source = found["source"]
        late = F.when((pointer["quote"] != "") & ~F.contains(source, pointer["quote"]), "quoted span is absent from source").when(
            (pointer["quote"] == "") & ((pointer["start"] < 0) | (pointer["end"] <= pointer["start"]) | (pointer["end"] > F.length(source))), "character span out of range"
        )
        return let(F.struct(source.alias("source"), F.coalesce(found["early"], late).alias("place")), result)

    def result(found):
        text = F.when(pointer["quote"] != "", pointer["quote"]).otherwise(F.substr(found["source"], pointer["start"] + 1, pointer["end"] - pointer["start"]))
        outside = F.when(asks & ((pointer["doc"] != -1) | (pointer["sent"] != -1)), "question pointer must use doc=sent=-1")
        errors = F.transform(F.filter(F.array(outside, found["place"]), lambda e: e.isNotNull()), lambda e: F.concat(label, F.lit(": "), e))
        return F.struct(F.when(found["place"].isNull(), text).otherwise("").alias("value"), errors.alias("errors"))

    return let(F.struct(F.get(documents, pointer["doc"]).alias("d")), with_document)


def _indexed(prefix: str, i: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(f"{prefix}["), i.cast("string"), F.lit(f"]{suffix}"))


def _errors(*pairs: tuple[Column, Column | str]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(e) if isinstance(e, str) else e) for c, e in pairs]), lambda e: e.isNotNull())


def connected(docs: Column, edges: Column) -> Column:
    """Whether edges (a, b) join all of ``docs``; document -1, the question, may lie between.

    A document is the bit of its place, an edge the bits of its ends, and what is reached from the first document grows by each edge that shares a bit with
    it; as many rounds over the edges as there are documents reach all that can be. More than 62 documents don't fit into one number and are kept in an array.
    No inner function uses a variable of an outer one here: the optimizer can't hand such an expression to an Arrow function."""
    nodes = F.concat(docs, F.array(F.lit(-1)))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), (at - 1).cast("int"))
    masks = F.transform(edges, lambda e: bit(F.array_position(nodes, e["a"])).bitwiseOR(bit(F.array_position(nodes, e["b"]))))
    rounds = lambda each: F.flatten(F.array_repeat(each, F.size(docs) + 1))
    reached = F.aggregate(rounds(masks), F.lit(1).cast("long"), lambda acc, m: F.when(acc.bitwiseAND(m) != 0, acc.bitwiseOR(m)).otherwise(acc))
    whole = F.call_function("shiftleft", F.lit(1).cast("long"), F.size(docs)) - 1
    grow = lambda acc, e: F.when(F.array_contains(acc, e["a"]) & ~F.array_contains(acc, e["b"]), F.array_append(acc, e["b"])).when(
        F.array_contains(acc, e["b"]) & ~F.array_contains(acc, e["a"]), F.array_append(acc, e["a"])
    ).otherwise(acc)
    many = F.aggregate(rounds(edges), F.slice(docs, 1, 1), grow)
    return F.when(F.size(nodes) <= 62, reached.bitwiseAND(whole) == whole).otherwise(F.size(F.array_except(docs, many)) == 0)


def checked(rows: DataFrame) -> DataFrame:
    """Adds __of_evidence, __of_joins, __of_graph, __of_answer (errors by group), __found (what the answer reduces to), __cited and __left."""
    for columns in _checks():
        rows = rows.withColumns(columns)
    return rows


@once
def _checks() -> list[dict[str, Column]]:
    """The columns of ``checked`` in their order; each step reads those before it."""
    documents, question, program = F.col("documents"), F.col("question"), F.col("program")
    answer = program["answer"]
    evidence = F.array_distinct(program["evidence"])
    joins = program["joins"]
    cited = lambda p: F.array_contains(F.col("__evidence"), F.struct(p["doc"].alias("doc"), p["sent"].alias("sent")))

    def target(j):
        d = F.get(documents, j["right_doc"])
        return F.when(j["right_field"] == "title", d["title"]).otherwise(F.concat_ws(" ", d["title"], F.array_join(d["sentences"], " ")))

    steps = [
        {
            "__evidence": evidence,
            "__left": F.transform(joins, lambda j, i: resolved(j["left"], documents, question, _indexed("join", i, ".left"))),
            "__target": F.transform(joins, target),
            "__pointer": F.when(answer["pointer"].isNotNull(), resolved(answer["pointer"], documents, question, F.lit("answer"))),
            "__operands": F.transform(answer["operands"], lambda p, i: resolved(p, documents, question, _indexed("answer.operand", i))),
            "__labels": F.transform(answer["labels"], lambda p, i: resolved(p, documents, question, _indexed("answer.label", i))),
            "__there": F.transform(joins, lambda j: F.get(documents, j["right_doc"]).isNotNull()),
            "__lines": F.transform(evidence, lambda r: let(F.struct(F.get(documents, r["doc"]).alias("d")), lambda x: F.struct(x["d"].isNotNull().alias("there"), F.get(x["d"]["sentences"], r["sent"]).alias("text")))),
        }
    ]
    values = lambda c: F.transform(c, lambda x: x["value"])
    m, k = F.size("__left"), F.size("__operands")
    texts = F.concat(values(F.col("__left")), F.col("__target"), values(F.col("__operands")), F.array(F.coalesce(answer["value"], F.lit(""))))
    steps.append({"__normal": normalize_all(texts), "__docs": F.array_distinct(F.transform("__evidence", lambda r: r["doc"]))})

    cells, docs = F.col("__lines"), F.col("__docs")
    evidence_errors = F.flatten(
        F.transform(
            cells,
            lambda c, i: _errors(
                (~c["there"], F.concat(_indexed("evidence", i), F.lit(": document out of range"))), (c["there"] & c["text"].isNull(), F.concat(_indexed("evidence", i), F.lit(": sentence out of range"))),
            ),
        )
    )
    cited_text = F.filter(F.transform(cells, lambda c: c["text"]), lambda x: x.isNotNull())

    def join_check(j, i):
        query = (j["kind"] == "query") & (j["left"]["field"] == "question")
        facts = F.struct(
            query.alias("query"), (query | cited(j["left"])).alias("bound"), F.array_contains(docs, j["right_doc"]).alias("right"), F.get(F.col("__there"), i).alias("there"),
            j["right_field"].isin("title", "sentence").alias("field"), F.get(F.col("__left"), i).alias("left"),
            F.coalesce(F.contains(F.get(F.col("__normal"), m + i), F.get(F.col("__normal"), i)), F.lit(False)).alias("holds"),
        )

        def checked(x):
            say = lambda text: F.concat(_indexed("join", i), F.lit(f": {text}"))
            ready = x["right"] & x["there"] & x["field"] & (x["left"]["value"] != "")
            errors = F.concat(
                x["left"]["errors"],
                _errors(
                    ((j["kind"] == "query") & ~x["query"], say("query join must read from the question")),
                    ((j["kind"] == "equi") & (j["left"]["field"] == "question"), say("equi join cannot read from the question")),
                    (~x["bound"], say("left pointer is not cited evidence")),
                    (~x["right"], say("right document is not cited evidence")),
                    (x["right"] & ~x["there"], say("right document out of range")),
                    (x["right"] & x["there"] & ~x["field"], say("invalid right field")),
                    (ready & ~x["holds"], say("anchor is absent from right input")),
                ),
            )
            edge = F.when(ready & x["holds"] & x["bound"], F.struct(F.when(x["query"], -1).otherwise(j["left"]["doc"]).alias("a"), j["right_doc"].alias("b")))
            return F.struct(errors.alias("errors"), edge.alias("edge"))

        return let(facts, checked)

    steps.append({"__joins": F.transform(joins, join_check)})
    steps.append({"__edges": F.filter(F.transform("__joins", lambda x: x["edge"]), lambda e: e.isNotNull())})
    edges = F.col("__edges")
    must_join = (F.size(docs) > 1) & program["mode"].isin("bridge", "composition")
    graph_errors = _errors(
        (must_join & (F.size(program["joins"]) == 0), "multi-document proof has no executable join"),
        (must_join & (F.size(edges) > 0) & ~connected(docs, edges), "multi-document proof join graph is disconnected"),
    )

    op = answer["op"]
    ordered, many = op.isin("argmin", "argmax"), op.isin("argmin", "argmax", "equal", "common")

    def uncited(p, label):
        known = F.when(p["field"] == "title", F.array_contains(docs, p["doc"])).otherwise(cited(p))
        return _errors((~known, F.concat(label, F.lit(": pointer is not cited evidence"))))

    pointer_errors = lambda found, pointers, prefix: F.flatten(
        F.transform(pointers, lambda p, i: F.concat(F.get(F.col(found), i)["errors"], uncited(p, _indexed(prefix, i))))
    )
    operand_values, label_values = values(F.col("__operands")), values(F.col("__labels"))
    # computed once a row, and for the operators that compare values only
    steps.append({
        "__kinds": F.when(op.isin("equal", "common"), F.array_distinct(F.transform(F.slice("__normal", 2 * m + 1, k), canonical))), "__keys": F.when(ordered, F.transform(operand_values, ordered_scalar)),
    })
    kinds, keys = F.col("__kinds"), F.col("__keys")
    unparsed = F.exists(keys, lambda x: x.isNull())
    chosen = F.array_position(keys, F.when(op == "argmin", F.array_min(keys)).otherwise(F.array_max(keys))).cast("int") - 1
    truth = F.element_at("__normal", -1)
    same_size = F.size(answer["labels"]) == k
    answer_errors = F.concat(
        F.when((op == "copy") & answer["pointer"].isNotNull(), F.concat(F.col("__pointer.errors"), uncited(answer["pointer"], F.lit("answer")))).otherwise(_none()),
        _errors(
            ((op == "copy") & answer["pointer"].isNull(), "copy answer has no pointer"),
            ((op == "bool") & ~truth.isin("yes", "no"), "boolean answer must be yes or no"),
            (op == "literal", LITERAL),
        ),
        F.when(many, pointer_errors("__operands", answer["operands"], "answer.operand")).otherwise(_none()),
        _errors((many & (k < 2), F.concat(op, F.lit(" requires at least two grounded operands"))), ((op == "common") & (k >= 2) & (F.size(kinds) > 1), "common operands do not normalize to one value")),
        F.when(ordered & (k >= 2), pointer_errors("__labels", answer["labels"], "answer.label")).otherwise(_none()),
        _errors(
            (ordered & (k >= 2) & ~same_size, "ordered comparison requires one grounded label per operand"),
            (ordered & (k >= 2) & unparsed, "ordered comparison contains an unparseable scalar"),
            (~op.isin("copy", "bool", "literal", "argmin", "argmax", "equal", "common"), F.concat(F.lit("unknown answer operator: "), op)),
        ),
    )
    found = (
        F.when(op == "copy", F.coalesce(F.col("__pointer.value"), F.lit("")))
        .when(op == "bool", truth)
        .when(op == "literal", answer["value"])
        .when((op == "equal") & (k >= 2), F.when(F.size(kinds) == 1, "yes").otherwise("no"))
        .when((op == "common") & (k >= 2) & (F.size(kinds) == 1), F.get(operand_values, F.lit(0)))
        .when(ordered & (k >= 2) & same_size & ~unparsed, F.get(label_values, chosen))
        .otherwise("")
    )
    steps.append(
        {
            "__of_evidence": evidence_errors, "__of_joins": F.flatten(F.transform("__joins", lambda x: x["errors"])), "__of_graph": graph_errors, "__of_answer": answer_errors,
            "__found": F.coalesce(found, F.lit("")), "__cited": cited_text,
        }
    )
    return steps


@once
def _result(allow_literal: bool, require_join: bool, validate_joins: bool) -> Column:
    """The result of a row of ``checked`` under a contract."""
    of_answer, found, op = F.col("__of_answer"), F.col("__found"), F.col("program.answer.op")
    if allow_literal:
        of_answer = F.array_remove(of_answer, LITERAL)
    groups = [F.col("__of_evidence"), *([F.col("__of_joins")] if validate_joins else []), *([F.col("__of_graph")] if validate_joins and require_join else []), of_answer]
    every = F.concat(*groups)
    valid, sound = F.size(every) == 0, F.size(of_answer) == 0
    left = F.transform("__left", lambda x: x["value"]) if validate_joins else _none()
    result = F.struct(
        valid.alias("valid"), (valid & op.isin(*GROUNDED)).alias("certified"), F.when(valid, found).otherwise("").alias("answer"), F.when(sound, found).otherwise("").alias("candidate_answer"),
        sound.alias("answer_valid"), every.alias("errors"), F.col("__cited").alias("cited_text"), left.alias("join_values"),
    )
    return F.when(F.col("program").isNotNull(), result)


def _tidied(done: DataFrame, rows: DataFrame, *keep: str) -> DataFrame:
    return done.drop(*[c for c in done.columns if c.startswith("__") and c not in keep and c not in rows.columns])


def execute(rows: DataFrame, *, allow_literal: bool = False, require_join: bool = True, validate_joins: bool = True, into: str = "result") -> DataFrame:
    """Adds ``into``: struct (valid, certified, answer, candidate_answer, answer_valid, errors, cited_text, join_values).

    ``rows`` has question, documents and program; a null program gives a null result."""
    return _tidied(checked(rows).withColumn(into, _result(allow_literal, require_join, validate_joins)), rows, into)


def execute_under(rows: DataFrame, options: dict[str, dict[str, bool]]) -> DataFrame:
    """Adds a result like that of ``execute`` for each name, under its own options; the checks are shared."""
    made = {into: _result(o.get("allow_literal", False), o.get("require_join", True), o.get("validate_joins", True)) for into, o in options.items()}
    return _tidied(checked(rows).withColumns(made), rows, *options)


#: Execution contracts, from all checks to those of evidence and answer; ``answer_only`` accepts any sound answer.
CONTRACTS = {
    "full": (False, True, True), "no_connectivity": (False, False, True), "citation_only": (False, False, False), "free_literal": (True, True, True), "answer_only": (False, True, True),
}


def by_contract(done: DataFrame) -> DataFrame:
    """Rows of ``checked`` once for each contract, with variant, result and accepted."""
    each = F.array(*[F.struct(F.lit(name).alias("variant"), _result(*options).alias("result")) for name, options in CONTRACTS.items()])
    done = done.withColumn("__each", F.explode(each)).withColumns({"variant": F.col("__each.variant"), "result": F.col("__each.result")})
    accepted = F.when(F.col("variant") == "answer_only", F.col("result.answer_valid")).otherwise(F.col("result.valid"))
    return done.withColumn("accepted", F.coalesce(accepted, F.lit(False)))


def contracts(rows: DataFrame) -> DataFrame:
    """(…, variant, accepted, result): each row under the five execution contracts, which share one pass over its checks."""
    return _tidied(by_contract(checked(rows)), rows)
