import json

from pyspark.sql import functions as F
from test_vm import DOCS, context, pairs, program, ptr

from strandset.operators.lineage import bind, refresh, verify
from strandset.operators.updates import attacks, document_gate, first_cases, one_cell_updates, recovery_answers, recovery_cases, recovery_report, update_stress
from strandset.operators.vm import execute
from strandset.schema import CONTEXT


def bound(spark, programs=None, contexts=None):
    return bind(execute(pairs(spark, programs or [program()], contexts)))


def edited(spark, rows, docs, qid="q0"):
    new = spark.createDataFrame([context(qid, docs)], CONTEXT).select(F.col("documents").alias("new"))
    return rows.crossJoin(new).withColumn("documents", F.col("new")).drop("new").withColumn("cached_answer", F.col("result.answer"))


def changed(docs, doc, sent, text):
    return [(t, [text if (i, k) == (doc, sent) else s for k, s in enumerate(ss)]) for i, (t, ss) in enumerate(docs)]


def test_snapshot_cells(spark):
    s = bound(spark).first().snapshot
    assert [(c.field, c.doc, c.sent) for c in s.cells] == [("question", -1, -1), ("sentence", 0, 0), ("sentence", 1, 0), ("title", 0, -1), ("title", 1, -1)] and s.certified
    assert bound(spark, [program(joins=[])]).first().snapshot is None


def test_witness_is_the_first_sentence_or_the_whole_document(spark):
    joins = [program()["joins"][0], {"left": ptr(0, 0, "Ada Writer"), "right_doc": 1, "right_field": "sentence"}, {"left": ptr(1, 0, "Delta City"), "right_doc": 2, "right_field": "sentence"}]
    offset = [program()["joins"][0], {"left": ptr(0, 0, start=22, end=32), "right_doc": 1, "right_field": "sentence"}]
    p = [program(joins=joins, evidence=[[0, 0], [1, 0], [2, 1]]), program(joins=offset)]
    got = {r.qid: {(c.field, c.doc, c.sent) for c in r.snapshot.cells} for r in bound(spark, p).collect()}
    assert got["q0"] >= {("title", 1, -1), ("sentence", 2, 0), ("sentence", 2, 1)} and ("title", 2, -1) not in got["q0"]
    assert got["q1"] >= {("title", 1, -1), ("sentence", 1, 0), ("sentence", 1, 1)}


def test_verify_and_refresh(spark):
    rows = bound(spark)
    cases = [
        (changed(DOCS, 2, 0, "New."), "reuse", []), (changed(DOCS, 0, 1, "New."), "reuse", []), (changed(DOCS, 1, 0, "Today Ada Writer was born in Delta City."), "replay", [("sentence", 1, 0)]),
        (changed(DOCS, 1, 0, "Ada Writer was born in Gamma City."), "recompile", [("sentence", 1, 0)]), (DOCS[:2] + [("Other", ["One."])], "recompile", []),
        (DOCS + [("More", [])], "recompile", []),
    ]
    for docs, action, cells in cases:
        new = edited(spark, rows, docs)
        check = verify(new).first().check
        assert [tuple(c) for c in check.changed] == cells and check.current == (action == "reuse")
        got = refresh(new).first()
        assert got.action == action and got.new_answer == ("" if action == "recompile" else "Delta City")
        assert (got.new_snapshot is None) == (action == "recompile") and bool(got.refresh_errors) == (action == "recompile")
    other = refresh(edited(spark, rows, DOCS).withColumn("cached_answer", F.lit("x"))).first()
    assert other.action == "recompile" and "does not match" in other.refresh_errors[0]
    yes = bound(spark, [program(answer={"op": "bool", "value": "yes"})])
    assert refresh(edited(spark, yes, DOCS)).first().action == "reuse"
    stale = refresh(edited(spark, yes, changed(DOCS, 1, 0, "Ada Writer of Delta City."))).first()
    assert stale.action == "recompile" and "not certified" in stale.refresh_errors[0]
    moved = verify(edited(spark, rows, DOCS).withColumn("qid", F.lit("z"))).first().check
    assert [tuple(c) for c in moved.missing] == [("question", -1, -1)]


def test_update_classes(spark):
    got = {r["class"]: r for r in update_stress(bound(spark)).collect()}
    assert {k: (r.eligible, r.hits) for k, r in got.items()} == {k: (1, 1) for k in ("unread_cell_update", "value_preserving_rewrite", "answer_value_replacement", "sentence_insertion", "sentence_deletion")}
    assert got["answer_value_replacement"].repair_valid == got["answer_value_replacement"].answer_changed == 1
    kinds = {r.kind: r.action for r in refresh(one_cell_updates(bound(spark))).collect()}
    assert kinds == {"relevant": "replay", "irrelevant": "reuse"}


def test_attacks_and_gate(spark):
    rows = bound(spark)
    assert {r.attack: (r.attempts, r.safe) for r in attacks(rows).collect()} == {k: (1, 1) for k in ("counterfactual_entity_or_number", "disconnected_evidence", "distractor_poisoning", "missing_source")}
    new = spark.createDataFrame([context("q0", changed(DOCS, 0, 1, "It sold badly."))], CONTEXT)
    assert document_gate(rows, new).first()[2:] == (False, True)


def generators(node):
    """The texts of what a plan explodes."""
    own = [node.expressions().apply(0).toString()] if node.nodeName() == "Generate" else []
    return own + [x for i in range(node.children().size()) for x in generators(node.children().apply(i))]


def exploded(frame):
    return " ".join(generators(frame._jdf.queryExecution().optimizedPlan()))


def test_attacked_cells_are_found_before_documents_change(spark):
    """Inside the edit of a document they would be looked for again for each of its sentences."""
    assert "poisoning" in exploded(attacks(bound(spark))) and "snapshot#" not in exploded(attacks(bound(spark)))


def test_updated_cells_are_found_before_documents_change(spark):
    text = exploded(update_stress(bound(spark)))
    assert "unread_cell_update" in text and "snapshot#" not in text


def test_recovery(spark):
    """The value pointer is edited, not a quote that a join shares; a wrong old answer, a value that stands twice and an answer without a number make no case."""
    years = {"evidence": [[0, 0], [1, 1]], "joins": [{"left": ptr(0, 0, "Ada Writer"), "right_doc": 1}], "answer": {"op": "copy", "pointer": ptr(1, 1, "1999")}}
    contexts = [context(f"q{i}", docs, answers=(a,)) for i, (docs, a) in enumerate([(DOCS, "1999"), (DOCS, "2001"), (DOCS, "Delta City"), (changed(DOCS, 2, 0, "In 1999."), "1999"), (changed(DOCS, 2, 0, "In 2000."), "1999")])]
    rows = bound(spark, [program(**years), program(**years), program(), program(**years), program(**years)], contexts)
    cases = recovery_cases(rows)
    got = cases.collect()
    assert [(r.qid, r.old_answer, r.new_value, r.new_result.answer, r.changed_documents[1].sentences[1], list(r.new_answers)) for r in got] == [("q0", "1999", "2000", "2000", "She wrote in 2000.", ["2000"])]
    assert json.dumps([d.title for d in got[0].documents]) == json.dumps([t for t, _ in DOCS])
    again = spark.createDataFrame([("hotpotqa", "q0", json.dumps(program(**(years | {"answer": {"op": "copy", "pointer": ptr(1, 1, "in 2000")}}))))], "dataset string, qid string, output string")
    r = recovery_report(cases, again, "dataset").first()
    assert [x if isinstance(x, str) else round(x, 6) for x in r] == ["hotpotqa", 1, 0, 0, 0, 100, 100, 100, 0, 66.666667, 0, 66.666667]
    assert tuple(recovery_report(cases, again.limit(0)).first())[:5] == (1, 0, 0, 0, 0)
    said = spark.createDataFrame([("hotpotqa", "q0", "<ANSWER>2000</ANSWER>")], "dataset string, qid string, output string")
    assert tuple(recovery_answers(cases, said).first()) == (1, 100, 100, 100)
    assert tuple(recovery_answers(cases.where("false"), said).first()) == (0, 0, 0, 0)


def test_first_cases_by_digest(spark):
    from hashlib import sha256

    rows = spark.createDataFrame([("ab"[i % 2], f"q{i}") for i in range(50)], "dataset string, qid string")
    got = {tuple(r) for r in first_cases(rows, 7).collect()}
    want = {("ab"[d], f"q{i}") for d in (0, 1) for i in sorted(range(d, 50, 2), key=lambda i: sha256(f"{'ab'[d]}:q{i}".encode()).hexdigest())[:7]}
    assert got == want
