import json

import pytest
from pyspark.sql import functions as F
from test_vm import DOCS, context, program

from strandset.functions import text as t
from strandset.operators import reports, revisions, sampling, selection, static
from strandset.operators.lineage import bind, refresh, verify
from strandset.operators.metrics import scored
from strandset.operators.program import parsed
from strandset.operators.vm import CONTRACTS, execute
from strandset.schema import CONTEXT
from strandset.sources import readers


def test_evaluation_has_all_fields_and_errors(spark):
    good, wrong = program(), program(answer={"op": "bool", "value": "no"})
    contexts = spark.createDataFrame([context("a"), context("b"), context("c"), context("d"), context("m", dataset="musique")], CONTEXT)
    rows = [("a", "x", 0), ("a", json.dumps(good), 1), ("hotpotqa:b", json.dumps(wrong), 2), ("c", "no json", 3), ("musique:m", json.dumps(good), 4)]
    got = {r.dataset: r for r in reports.evaluation(contexts, spark.createDataFrame(rows, "id string, output string, line int")).collect()}
    h, m = got["hotpotqa"], got["musique"]
    assert (h.examples, h.predictions, h.parse_rate, h.valid_rate, h.answer_em, h.valid_em, h.granularity, h.dataset_variant) == (4, 5, 50.0, 50.0, 25.0, 50.0, "sentence", "distractor")
    assert h.errors == {"missing_prediction": 1, "parse_error": 1, "valid_wrong_answer": 1} and h.joint_em is not None
    assert (m.granularity, m.dataset_variant, m.evidence_f1, m.joint_em) == ("document", "default", 100.0, None) and m.errors == {}


def test_five_contracts_in_one_pass(spark):
    cut = program(joins=program()["joins"][:1])
    rows = spark.createDataFrame([(*context("a"), json.dumps(program())), (*context("b"), json.dumps(cut)), (*context("c"), json.dumps(program(answer={"op": "literal", "value": "Delta City"}))), (*context("d"), None)], f"{CONTEXT}, output string")
    df = reports.ablation(rows)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("_read(") == 1
    got = {r.variant: r for r in df.collect()}
    assert set(got) == set(CONTRACTS) and {r.examples for r in got.values()} == {4} and {r.parsed for r in got.values()} == {3}
    assert got["full"].accepted == 1 and got["free_literal"].accepted == 2 and got["free_literal"].answer_em == 75.0 and got["full"].answer_em == 50.0
    assert got["answer_only"].accepted == 2 and got["answer_only"].strict_em == 50.0 and got["citation_only"].accepted >= got["no_connectivity"].accepted >= 1


def test_families_by_kinds_of_joins(spark):
    joins = program()["joins"]
    rows = [(*context(str(i)), json.dumps(program(joins=j))) for i, j in enumerate((joins, [x for x in joins if x["kind"] == "query"], [x for x in joins if x["kind"] != "query"], []))]
    found = parsed(spark.createDataFrame(rows, f"{CONTEXT}, output string")).select("qid", reports.join_family(F.col("program")).alias("f"))
    kinds = {x["kind"] for x in joins}
    want = {"0": "both" if kinds == {"query", "equi"} else f"{kinds.pop()}_only", "3": "none"}
    got = {r.qid: r.f for r in found.collect()}
    assert got["0"] == want["0"] and got["3"] == "none" and got["1"] in ("query_only", "none") and got["2"] in ("equi_only", "none")
    out = reports.coverage(scored(spark.createDataFrame(rows, f"{CONTEXT}, output string"))).collect()
    assert {r.level for r in out} == {"operator", "join_family", "mode"} and all(abs(sum(r.share for r in out if r.level == x) - 100) < 1e-9 for x in ("operator", "mode"))


def test_candidate_scores(spark):
    c = "qid string, index int, parsed boolean, tier int, answer string, em double, f1 double"
    rows = [("q", 0, True, 1, "a", 0.0, 0.2), ("q", 1, True, 2, "b", 1.0, 1.0), ("q", 2, True, 1, "a", 0.0, 0.2), ("q", 3, False, 0, "", 0.0, 0.0), ("n", 0, False, 0, "", 0.0, 0.0)]
    df = spark.createDataFrame(rows, c)
    got = {r.qid: r for r in reports.candidate_scores(df, df.where("index = 0")).collect()}
    q, n = got["q"], got["n"]
    assert (q.candidates, q.parsed, q.sound, q.selected_f1, q.oracle_em, q.strict_em, q.consensus_em, q.tier_consensus_em) == (4, 3, 3, 0.2, 1.0, 1.0, 0.0, 1.0)
    assert (n.sound, n.oracle_em, n.consensus_f1) == (0, 0.0, 0.0)
    r = reports.candidate_report(reports.candidate_scores(df, df.where("index = 0")), 4).first()
    assert (r.examples, r.candidates, r.parse_rate, r.answered, r.oracle_em) == (4, 5, 60.0, 25.0, 25.0)
    tie = spark.createDataFrame([("q", 0, True, 1, "a", 0.0, 0.0), ("q", 1, True, 1, "b", 1.0, 1.0)], c)
    assert reports.candidate_scores(tie, tie).first().consensus_em == 0.0  # the earlier candidate's answer


def test_static_answers_and_protocols(spark):
    quote = lambda x: {"doc": 0, "sent": 0, "quote": x}
    answers = [
        ({"op": "copy", "pointer": quote("Ada")}, "Ada"), ({"op": "copy"}, None), ({"op": "bool", "value": "yes"}, "yes"), ({"op": "common", "operands": [quote("x"), quote("y")]}, "x"), ({"op": "common"}, None),
        ({"op": "equal", "operands": [quote("French"), quote("the France")]}, "yes"), ({"op": "equal", "operands": [quote("1"), quote("2")]}, "no"), ({"op": "argmin", "operands": [quote("2001"), quote("1 May 1999")], "labels": [quote("A"), quote("B")]}, "B"),
        ({"op": "argmax", "operands": [quote("3"), quote("7")], "labels": [quote("A"), quote("B")]}, "B"), ({"op": "argmax", "operands": [quote("3"), quote("seven")], "labels": [quote("A"), quote("B")]}, None), ({"op": "argmax", "operands": [quote("3")]}, None), ({"op": "odd"}, None),
    ]
    rows = parsed(spark.createDataFrame([(str(i), json.dumps(program(answer=a))) for i, (a, _) in enumerate(answers)], "qid string, output string"))
    got = {int(r.qid): r for r in static.rewritten(static.rewritten(static.static_answers(rows), "citation", "c"), "free_literal", "l").collect()}
    assert [got[i].static_answer for i in range(len(answers))] == [w for _, w in answers]
    assert json.loads(got[0].c[10:-11])["answer"] == "Ada" and got[1].c is None
    literal = json.loads(got[7].l[9:-10])["answer"]
    assert literal["op"] == "literal" and literal["value"] == "B" and "pointer" not in literal
    contexts = spark.createDataFrame([(*context("a"), "<ANSWER>\n Delta City\n</ANSWER>"), (*context("b"), "Delta City")], f"{CONTEXT}, output string")
    r = reports.output_baseline(contexts, "answer").first()
    assert (r.parse_rate, r.answer_em, r.evidence_f1) == (50.0, 50.0, None)
    cites = [json.dumps({"answer": "Delta", "evidence": [[0, 0], [1, 0]]}), json.dumps({"answer": "x", "evidence": [[0, 0], [7, 0]]}), json.dumps({"answer": "x", "evidence": [[-1, 0]]}), None]
    r = reports.output_baseline(spark.createDataFrame([(*context(str(i)), x) for i, x in enumerate(cites)], f"{CONTEXT}, output string"), "citation").first()
    assert (r.parse_rate, r.valid_citation_rate) == (75.0, 25.0) and abs(r.answer_f1 - 100 * (2 / 3) / 4) < 1e-9


def test_passages_and_training_groups(spark):
    rows = execute(parsed(spark.createDataFrame([(*context("a"), json.dumps(program()), 0), (*context("a"), "bad", 1)], f"{CONTEXT}, output string, index int")))
    rows = rows.withColumns({"tier": F.coalesce(F.when(F.col("result.valid"), 2), F.lit(0)), "raw": F.lit("Delta City"), "answer": F.lit("delta city"), "n_candidates": F.lit(2)})
    (r,) = selection.passages(rows).collect()
    assert r.passage.startswith("Candidate answer: Delta City\nProgram status: executable\nAnswer agreement: 1 of 2\nCited evidence:\n[Book X] ")
    g = spark.createDataFrame([("hotpotqa", "q", "a", True), ("hotpotqa", "q", "b", False), ("hotpotqa", "r", "a", True)], "dataset string, qid string, answer string, right boolean")
    assert {(x.qid, x.part) for x in selection.training_groups(g).collect()} == {("q", "train")} and selection.training_groups(g, 0.999999).first().part == "holdout"
    assert selection.accuracy(g).first().accuracy == pytest.approx(2 / 3)
    scores = lambda *x: spark.createDataFrame([(v,) for v in x], "s double").select(selection.required_score(F.col("s")).alias("s"))
    assert [r.s for r in scores(1.0, -2.5).collect()] == [1.0, -2.5]
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="ranker_score"):
            scores(1.0, bad).collect()
    p = spark.createDataFrame([("q", [("x", "stop", 1), ("y", "stop", 2)], "x")], "qid string, candidates array<struct<output:string,finish_reason:string,generated_tokens:int>>, output string")
    assert selection.reselected(p, spark.createDataFrame([("q", 1)], "qid string, index int")).first().output == "y"


def test_revision_streams_meet_their_profiles(spark):
    line = lambda i: f"A line of the page that is long, number {i}"
    text = lambda *n: "\n".join(["short", "{{a template of some length}}", *map(line, n)])
    pages = spark.createDataFrame(
        [(1, "New name", False, 10, "2020", "s1", text(1, 2)), (1, "New name", False, 11, "2021", "s2", text(1, 3)), (2, "Own", False, 5, "2020", "a", text(1)), (2, "Own", False, 6, "2021", "a", text(1)),
         (3, "Gone", True, 1, "2020", "a", text(1)), (4, "Unasked", False, 1, "2020", "a", text(1)), (5, "Empty", False, 1, "2020", "a", "x"), (5, "Empty", False, 2, "2021", "b", text(1))],
        "response int, title string, missing boolean, revid int, timestamp string, sha1 string, content string",
    )
    moves = spark.createDataFrame([(1, "old name", "New name", True), (2, "own", "Own", False)], "response int, from string, to string, redirect boolean")
    profiles = spark.createDataFrame([("d", "old name", 2), ("e", "Own", 3), ("e", "Empty", 1)], "dataset string, title string, dependency_cells int")
    found = revisions.resolved_pages(pages, moves, profiles)
    assert {(r.title, r.requested) for r in found.collect()} == {("New name", "old name"), ("Own", "Own"), ("Empty", "Empty")}
    events = {(r.title, r.revid, r.next_revid, r.selected, r.lost, r.page_changed) for r in revisions.stream_events(found).collect()}
    assert events == {("New name", 10, 11, 2, 1, True), ("Own", 5, 6, 1, 0, False)}
    by = {r.dataset: r for r in revisions.stream_report(revisions.stream_events(found), "dataset").collect()}
    assert (by["d"].recompute_rate, by["e"].recompute_rate, by["e"].document_recompute_rate) == (100.0, 0.0, 0.0)


def test_histories_of_linked_programs(spark):
    bound = bind(execute(parsed(spark.createDataFrame([(*context("a"), json.dumps(program()))], f"{CONTEXT}, output string"))))
    linked = revisions.linked_documents(bound)
    docs = {r.title: r for r in linked.collect()}
    title, (_, sentences) = DOCS[0][0], DOCS[0]
    assert docs[title].sentences == sentences[:1] and docs[title].quotes
    whole, quotes = "'''" + sentences[0] + "'''", " / ".join(docs[title].quotes)
    history = spark.createDataFrame([(title, i, str(2000 + i), f"s{i}", x) for i, x in enumerate([whole, whole + " more", quotes, "nothing", whole])], "title string, revid int, timestamp string, sha1 string, content string")
    got = {r.revid: r.action for r in revisions.history_events(linked, history).collect()}
    assert got == {0: "reuse", 1: "replay"}
    r = revisions.history_report(revisions.history_events(linked, history)).first()
    assert (r.events, r.reuse, r.replay, r.recompile, r.spared) == (2, 1, 1, 0, 100.0)


def test_one_pass_refresh(spark):
    bound = bind(execute(parsed(spark.createDataFrame([(*context("a"), json.dumps(program()))], f"{CONTEXT}, output string")))).withColumn("cached_answer", F.col("result.answer"))
    assert refresh(bound)._jdf.queryExecution().optimizedPlan().toString().count("_read(") == 1
    r = refresh(bound).first()
    assert (r.action, r.new_answer, r.refresh_errors) == ("reuse", "Delta City", []) and r.program is not None and r.new_snapshot == r.snapshot
    moved = bound.withColumn("documents", F.transform("documents", lambda d: d.withField("sentences", F.transform(d["sentences"], lambda s: F.concat(s, F.lit(" More."))))))
    r = refresh(moved).first()
    assert r.action == "replay" and r.new_snapshot.cells != r.snapshot.cells and verify(moved).first().check.current is False


def test_lengths_and_limits(spark):
    rows = spark.createDataFrame([("a", i) for i in range(1, 101)], "id string, n int")
    r = sampling.length_profile(rows, "n", 90, "id").first()
    assert (r.n, r.kept, r.shortest, r.p50, r.p95, r.p99, r.longest) == (100, 90, 1, 50, 95, 99, 100)
    assert [x.n for x in sampling.longest(rows, "n", "id").collect()] == list(range(100, 90, -1))
    assert sampling.within_length(rows, "n", 90, "id").count() == 90
    with pytest.raises(Exception, match="more than 90"):
        sampling.within_length(rows, "n", 90, "id", skip=False).collect()
    assert [x.n for x in sampling.first_rows(rows.orderBy(F.desc("n")), 3, "n").collect()] == [1, 2, 3]


def test_supervision_in_any_case_and_in_json(spark):
    for ddl in ("Answer string", "x struct<is_supporting:boolean>", "GOLD_label int", "p array<struct<Gold:int>>"):
        with pytest.raises(ValueError):
            readers.assert_public(spark.createDataFrame([], ddl))
    rows = spark.createDataFrame([('{"question": "answer", "paragraphs": [{"title": "x"}]}', '{"a": [{"Is_Supporting" : true}]}')], "good string, bad string")
    readers.assert_public(rows, "good")
    with pytest.raises(ValueError, match="Is_Supporting"):
        readers.assert_public(rows, "good", "bad")


def test_file_order_wins_over_sizes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "output": "first"}\n')
    (tmp_path / "b.jsonl").write_text("".join(f'{{"id": "y{i}", "output": "{"z" * 50}"}}\n' for i in range(500)) + '{"id": "x", "output": "last"}\n')
    from strandset.operators.metrics import last_by_id

    assert {r.id: r.output for r in last_by_id(readers.load_predictions(spark, str(tmp_path))).collect()}["x"] == "last"


def test_titles_meet_their_folded_forms(spark):
    row = ("q", "?", "a", "bridge", (["Große Straße"], [["One."]]), (["GROSSE STRASSE"], [0]))
    raw = spark.createDataFrame([row], "id string, question string, answer string, type string, context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>,sent_id:array<int>>")
    assert readers.hotpot(raw).first().support_complete


def test_wiki_markup(spark):
    text = "'''A''' [[B|C &amp; D]] {{t [[x]]}}<!-- n\nn -->&lt;b&gt;E&lt;/b&gt; <ref name='r'>gone</ref><br/>F  \n G"
    assert spark.createDataFrame([(text,)], "x string").select(t.strip_wiki(F.col("x")).alias("y")).first().y == "A C & D E F G"
    cells = spark.createDataFrame([("a  long line of   many words\r\nshort\n[[Category:something of length]]\na long line of many words",)], "x string").select(t.wiki_cells(F.col("x")).alias("y")).first().y
    assert cells == ["a long line of many words"]


def test_a_page_asked_for_or_fetched_twice_counts_once(spark):
    line = "The first line of this page has a few words."
    pages = spark.createDataFrame([(1, "P", False, 5, "2020", "a", line), (1, "P", False, 5, "2020", "a", line), (1, "P", False, 6, "2021", "b", "x")], "response int, title string, missing boolean, revid int, timestamp string, sha1 string, content string")
    moves = spark.createDataFrame([], "response int, from string, to string, redirect boolean")
    profiles = spark.createDataFrame([("two", "P", 1), ("one", "P", 1)], "dataset string, title string, dependency_cells int")
    events = revisions.stream_events(revisions.resolved_pages(pages, moves, profiles)).collect()
    assert [(r.dataset, r.revid, r.next_revid, r.lost) for r in events] == [("two", 5, 6, 1)]
    linked = spark.createDataFrame([("d", "q", "P", ["first line"], ["words"])], "dataset string, qid string, title string, sentences array<string>, quotes array<string>")
    found = revisions.history_events(linked, pages.select("title", "revid", "timestamp", "sha1", "content")).collect()
    assert [(r.revid, r.next_revid, r.action) for r in found] == [(5, 6, "recompile")]
