import json

import pytest

from strandset.sources.readers import assert_public, check_manifest, hotpot, load_predictions, musique, public, source_files, wiki2


def test_hotpot(spark):
    row = ("q1", "Who &amp; what?", " Ada ", "bridge", (["A &amp; B", "C"], [["One.", "", "Two  x."], ["Three."]]), (["A & B", "c", "Z", "A & B"], [0, 0, 1, 0]))
    raw = spark.createDataFrame([row], "id string, question string, answer string, type string, context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>,sent_id:array<int>>")
    r = hotpot(raw).first()
    assert (r.dataset, r.qid, r.question, r.answers, r.question_type) == ("hotpotqa", "q1", "Who & what?", ["Ada"], "bridge")
    assert [(d.doc, d.title, d.sentences) for d in r.documents] == [(0, "A & B", ["One.", "", "Two x."]), (1, "C", ["Three."])]
    assert [tuple(x) for x in r.support] == [(0, 0), (1, 0)] and r.support_expected == 3 and not r.support_complete
    assert_public(public(hotpot(raw)))
    with pytest.raises(ValueError):
        assert_public(hotpot(raw))


def test_wiki2_in_both_shapes(spark):
    context, facts, triples = [["A", ["x.", "y."]], ["B", ["z."]]], [["a", 1], ["B", 0]], [["A", "born", "1999", "more"]]
    rows = [("i", "q", "yes", "comparison", json.dumps(context), json.dumps(facts), json.dumps(triples)), ("j", "q", "", None, json.dumps({"title": ["A", "B"], "sentences": [["x.", "y."], ["z."]]}), json.dumps({"title": ["a", "B"], "sent_id": [1, 0]}), "[]")]
    got = wiki2(spark.createDataFrame(rows, "_id string, question string, answer string, type string, context string, supporting_facts string, evidences string")).orderBy("qid").collect()
    for r in got:
        assert [(d.title, d.sentences) for d in r.documents] == [("A", ["x.", "y."]), ("B", ["z."])] and [tuple(x) for x in r.support] == [(0, 1), (1, 0)] and r.support_complete
    assert got[0].evidences == [["A", "born", "1999"]] and got[1].answers == [] and got[1].question_type == "unknown"


def test_musique(spark):
    p = [{"idx": 1, "title": "B", "paragraph_text": "Two. Three.", "is_supporting": True}, {"idx": 0, "title": "A", "paragraph_text": "One.", "is_supporting": False}]
    row = {"id": "m", "question": "q", "answer": "x", "answer_aliases": ["y", "x", ""], "paragraphs": p, "question_decomposition": [{"question": "s", "answer": "t", "paragraph_support_idx": 1}, {"question": "u", "answer": "v", "paragraph_support_idx": None}]}
    r = musique(spark.read.json(spark.sparkContext.parallelize([json.dumps(row)]))).first()
    assert [(d.title, d.sentences) for d in r.documents] == [("A", ["One."]), ("B", ["Two.", "Three."])]
    assert r.answers == ["x", "y"] and [tuple(x) for x in r.support] == [(1, 0), (1, 1)] and r.question_type == "hops=2"
    assert [(s.step_id, s.support_doc) for s in r.decomposition] == [(0, 1), (1, None)]


def test_predictions_and_manifest(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text('{"id": "a", "output": "1"}\n\n{"id": "a", "output": "2", "program": {"answer": 3}}\n{"id": "b", "outp')
    assert sorted((r.id, r.output) for r in load_predictions(spark, str(path)).collect()) == [("a", "1"), ("a", '{"answer":3}')]
    path.write_text('{"id": "a", "output": "1", "program": "{\\"answer\\": 3}"}\n{"id": "b", "program": "{}"}\n{"id": "c", "output": "2", "program": null}\n{"id": "d", "output": "3", "program": {}}\n{"id": "e", "output": "4", "program": [1]}\n{"id": "f"}')
    assert sorted((r.id, r.output) for r in load_predictions(spark, str(path)).collect()) == [("a", "1"), ("b", "{}"), ("c", "2"), ("d", "{}"), ("e", "4"), ("f", None)]
    m = str(tmp_path / "m.json")
    with pytest.raises(ValueError):
        check_manifest(m, {"a": 1}, True)
    check_manifest(m, {"a": 1}, False)
    check_manifest(m, {"a": 1}, True)
    with pytest.raises(ValueError):
        check_manifest(m, {"a": 2}, True)
    assert source_files("2wiki", "r", "dev").startswith("r/2wiki/{dev,validation}")
