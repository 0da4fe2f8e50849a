import json

import pytest
from pyspark.sql import functions as F

from strandset.functions.text import normalize
from strandset.operators.program import parsed
from strandset.operators.vm import connected, contracts, execute
from strandset.schema import CONTEXT

DOCS = [
    ("Book X", ["Book X was written by Ada Writer.", "It sold well."]),
    ("Ada Writer", ["Ada Writer was born in Delta City.", "She wrote in 1999."]),
    ("Other", ["Nothing to see in Delta City.", "It is from 2001."]),
]
QUESTION = "Where was the writer of Book X born?"


def context(qid="q", docs=DOCS, question=QUESTION, answers=("Delta City",), support=((0, 0), (1, 0)), dataset="hotpotqa"):
    return (
        dataset, qid, "dev", question, [(i, t, s) for i, (t, s) in enumerate(docs)], list(answers), list(support), "bridge", [], [], True, len(support),
    )


def ptr(doc, sent, quote="", field="sentence", start=-1, end=-1):
    return {"doc": doc, "sent": sent, "quote": quote, "field": field, "start": start, "end": end}


def program(**over):
    base = {
        "version": 1, "mode": "bridge", "evidence": [[0, 0], [1, 0]],
        "joins": [{"left": ptr(-1, -1, "Book X", "question"), "right_doc": 0, "right_field": "title", "kind": "query"}, {"left": ptr(0, 0, "Ada Writer"), "right_doc": 1, "right_field": "title", "kind": "equi"}],
        "answer": {"op": "copy", "pointer": ptr(1, 0, "Delta City")},
    }
    return base | over


def pairs(spark, programs, contexts=None):
    contexts = contexts or [context(f"q{i}") for i in range(len(programs))]
    df = spark.createDataFrame(contexts, CONTEXT)
    outs = spark.createDataFrame([(f"q{i}", p if isinstance(p, str) else f"<PROGRAM>{json.dumps(p)}</PROGRAM>") for i, p in enumerate(programs)], "qid string, output string")
    return parsed(df.join(outs, "qid"))


CASES = [
    (program(), True, True, "Delta City", []),
    (program(joins=[{"left": ptr(0, 0, "sold"), "right_doc": 1}]), False, False, "Delta City", ["join[0].left: quoted span is absent from source"]),
    (program(joins=[{"left": ptr(0, 0, "written"), "right_doc": 1}]), False, False, "Delta City", ["join[0]: anchor is absent from right input"]),
    (program(answer={"op": "copy", "pointer": ptr(2, 0, "Delta City")}), False, False, "", ["answer: pointer is not cited evidence"]),
    (program(evidence=[[0, 0], [1, 0], [2, 0]]), False, False, "Delta City", ["multi-document proof join graph is disconnected"]),
    (program(joins=[]), False, False, "Delta City", ["multi-document proof has no executable join"]),
    (program(evidence=[[0, 0], [9, 0], [1, 7], [0, 0]], joins=[{"left": ptr(0, 0, "Ada Writer"), "right_doc": 9}]), False, False, "",
     ["evidence[1]: document out of range", "evidence[2]: sentence out of range", "join[0]: right document out of range", "answer: pointer is not cited evidence"]),
    (program(answer={"op": "copy", "pointer": ptr(1, -1, "Ada Writer", "title")}), True, True, "Ada Writer", []),
    (program(answer={"op": "copy", "pointer": ptr(1, 0, "", start=23, end=33)}), True, True, "Delta City", []),
    (program(answer={"op": "copy", "pointer": ptr(1, 0, "", start=23, end=99)}), False, False, "", ["answer: character span out of range"]),
    (program(answer={"op": "bool", "value": "The Yes."}), True, False, "yes", []),
    (program(answer={"op": "bool", "value": "maybe"}), False, False, "", ["boolean answer must be yes or no"]),
    (program(answer={"op": "literal", "value": "x"}), False, False, "", ["ungrounded literal answer is disabled"]),
    (program(answer={"op": "copy"}), False, False, "", ["copy answer has no pointer"]),
    (program(answer={"op": "guess"}), False, False, "", ["unknown answer operator: guess"]),
    (program(mode="comparison", joins=[], evidence=[[1, 1], [2, 1]], answer={"op": "argmin", "operands": [ptr(2, 1, "2001"), ptr(1, 1, "1999")], "labels": [ptr(2, -1, "Other", "title"), ptr(1, -1, "Ada Writer", "title")]}),
     True, True, "Ada Writer", []),
    (program(mode="comparison", joins=[], evidence=[[1, 1], [2, 1]], answer={"op": "argmax", "operands": [ptr(2, 1, "2001"), ptr(1, 1, "1999")], "labels": [ptr(2, -1, "Other", "title"), ptr(1, -1, "Ada Writer", "title")]}),
     True, True, "Other", []),
    (program(mode="comparison", joins=[], evidence=[[1, 1], [2, 1]], answer={"op": "argmax", "operands": [ptr(2, 1, "from"), ptr(1, 1, "1999")], "labels": []}),
     False, False, "", ["ordered comparison requires one grounded label per operand", "ordered comparison contains an unparseable scalar"]),
    (program(mode="comparison", joins=[], evidence=[[1, 0], [2, 0]], answer={"op": "equal", "operands": [ptr(1, 0, "Delta City"), ptr(2, 0, "Delta City")]}), True, True, "yes", []),
    (program(mode="comparison", joins=[], evidence=[[1, 0], [2, 0]], answer={"op": "equal", "operands": [ptr(1, 0, "born"), ptr(2, 0, "Delta City")]}), True, True, "no", []),
    (program(mode="comparison", joins=[], evidence=[[1, 0], [2, 0]], answer={"op": "common", "operands": [ptr(1, 0, "Delta City"), ptr(2, 0, "Delta City.")]}), True, True, "Delta City", []),
    (program(mode="comparison", joins=[], evidence=[[1, 0]], answer={"op": "common", "operands": [ptr(1, 0, "Delta City")]}), False, False, "", ["common requires at least two grounded operands"]),
    (program(joins=[{"left": ptr(0, 0, "Book X", "question"), "right_doc": 0, "kind": "query"}, program()["joins"][1]]), False, False, "Delta City",
     ["join[0].left: question pointer must use doc=sent=-1", "join[0].left: invalid pointer field"]),
    (program(joins=[{"left": ptr(0, 1, "It"), "right_doc": 2, "kind": "query"}, program()["joins"][1]]), False, False, "Delta City",
     ["join[0]: query join must read from the question", "join[0]: left pointer is not cited evidence", "join[0]: right document is not cited evidence"]),
]


@pytest.fixture(scope="module")
def results(spark):
    return {int(r.qid[1:]): r.result for r in execute(pairs(spark, [c[0] for c in CASES])).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_program(results, i):
    _, valid, certified, answer, errors = CASES[i]
    r = results[i]
    assert r.errors == errors
    assert (r.valid, r.certified) == (valid, certified)
    assert r.answer == (answer if valid else "") and r.candidate_answer == answer


def test_contract_variants(spark):
    rows = pairs(spark, [program(joins=[{"left": ptr(0, 0, "written"), "right_doc": 1}]), program(answer={"op": "literal", "value": "x"}), program(evidence=[[0, 0], [1, 0], [2, 0]])])
    done = contracts(rows).collect()
    got = {(r.qid, r.variant): r.result.valid for r in done if r.variant != "answer_only"}
    assert got == {
        ("q0", "full"): False, ("q0", "no_connectivity"): False, ("q0", "citation_only"): True, ("q0", "free_literal"): False,
        ("q1", "full"): False, ("q1", "no_connectivity"): False, ("q1", "citation_only"): False, ("q1", "free_literal"): True,
        ("q2", "full"): False, ("q2", "no_connectivity"): True, ("q2", "citation_only"): True, ("q2", "free_literal"): False,
    }
    assert {r.qid: r.accepted for r in done if r.variant == "answer_only"} == {"q0": True, "q1": False, "q2": True}
    assert all(r.accepted == r.result.valid for r in done if r.variant != "answer_only")


def test_parsing_fails_closed(spark):
    bad = ["", "no json", "[]", "{}", '{"answer": 3}', '{"answer": {}}', '{"answer": {"op": "copy"}, "evidence": [[1]]}', '{"answer": {"op": "copy"}, "evidence": [["x", 1]]}', '{"answer": {"op": "copy"}, "evidence": [[99999999999, 1]]}']
    good = ['{"answer": {"op": "copy"}, "evidence": [["1", 2.7]]}', 'x <PROGRAM> {"answer": {"op": "a", "op": "b"}} </PROGRAM> y']
    got = {int(r.qid[1:]): r for r in pairs(spark, bad + good).collect()}
    assert all(got[i].parse_error and got[i].program is None for i in range(len(bad)))
    assert got[len(bad)].program.evidence[0].asDict() == {"doc": 1, "sent": 2} and got[len(bad) + 1].program.answer.op == "b"
    assert execute(pairs(spark, bad)).where(F.col("result").isNotNull()).count() == 0


def test_connected_equals_a_search(spark):
    import random

    draw, rows = random.Random(8), []
    for _ in range(300):
        docs = draw.sample(range(200), draw.choice([1, 2, 3, 5, 61, 62, 63, 90, 130]))
        nodes = [*docs, -1]
        edges = [(draw.choice(nodes), draw.choice(nodes)) for _ in range(draw.choice([0, 1, len(docs), 2 * len(docs), 4 * len(docs)]))]
        if draw.random() < 0.5:  # a path through all in any order
            path = draw.sample(nodes, len(nodes))
            edges += list(zip(path, path[1:]))
            draw.shuffle(edges)
        rows.append((docs, edges))
    df = spark.createDataFrame(rows, "docs array<int>, edges array<struct<a:int,b:int>>")
    got = [r[0] for r in df.select(F.coalesce(connected(F.col("docs"), F.col("edges")), F.lit(False))).collect()]

    def reached(docs, edges):
        near, seen, todo = {}, set(), [docs[0]]
        for a, b in edges:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near.get(x, [])
        return set(docs) <= seen

    assert got == [reached(d, e) for d, e in rows] and {True, False} == set(got)


def test_a_result_can_go_to_an_arrow_function(spark):
    """With one use only, the whole result is written into the function's argument."""
    rows = execute(pairs(spark, [program()]))
    assert rows.where("result.certified").select(normalize(F.col("result.answer"))).first()[0] == "delta city"


def test_sixty_documents_and_joins(spark):
    n = 60
    docs = [(f"Title{i}x", [f"It names Title{i + 1}x and Title{i + 2}x."]) for i in range(n)]
    joins = [{"left": ptr(i, 0, f"Title{i + 1}x"), "right_doc": i + 1} for i in range(n - 1)]
    base = program(evidence=[[i, 0] for i in range(n)], joins=joins[::-1], answer={"op": "copy", "pointer": ptr(n - 1, 0, "Title60x")})
    cut = base | {"joins": joins[:30] + joins[31:]}
    around = base | {"joins": joins[:30] + [{"left": ptr(29, 0, "Title31x"), "right_doc": 31}] + joins[31:]}
    rows = execute(pairs(spark, [base, cut, around], [context(f"q{i}", docs) for i in range(3)])).select("qid", "result.valid", "result.errors").collect()
    errors = ["multi-document proof join graph is disconnected"]
    assert {r.qid: (r.valid, list(r.errors)) for r in rows} == {"q0": (True, []), "q1": (False, errors), "q2": (True, [])}


def test_texts_read_in_the_jvm_are_read_as_in_python(spark):
    """Whatever is doubled, unknown, null, of another type or out of range is no different from what ``read`` makes of it; a far pointer of an answer fails no query."""
    from strandset.operators.program import read

    full = program(answer={"op": "argmin", "operands": [ptr(0, 1, "xé\\\"")], "labels": [ptr(1, -1, "", "title", 0, 4)], "value": ""})
    tight = lambda p, **o: json.dumps(p, separators=(",", ":"), **o)
    texts = [
        tight(full), tight(full, ensure_ascii=False), tight(full, sort_keys=True), json.dumps(full), tight(program(mode=None)), tight(program(evidence=[[0]])), tight(program(evidence=[[0, 1, 7]])), tight(program(evidence=[])),
        tight(program(version="3")), tight(program(version=1.0)), tight(program(metadata={"a": 1})), tight(program(joins=[{}])), tight(program(answer={})), tight(program(answer={"op": 5})), tight(program(answer={"op": "copy", "pointer": {}})),
        tight(program(answer={"op": "copy", "pointer": {"doc": 1}})), tight(program(answer={"op": "copy", "pointer": {"doc": 1, "sent": 0}})), tight(program(answer={"op": "equal", "operands": [{}, {"doc": 1, "sent": 2}]})), '{"version":1,"answer":{"op":"a"},"answer":{"op":"b"}}',
        '{"answer":{"op":"copy"}}', '{"version":1,"answer":{"op":"copy"}} x', '{"version":1,"answer":{"op":"null"}}', '{"version":01,"answer":{"op":"a"}}', '{"version":2147483648,"answer":{"op":"a"}}', "[1]", "", "{}", '{"version":1,"evidence":[[1,"2"]],"answer":{"op":"a"}}',
        tight(program(answer={"op": "copy", "pointer": ptr(2**40, 0, "x")})), tight(program(answer={"op": "equal", "operands": [ptr(0, -(2**31) - 1)]})),
    ]
    rows = parsed(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, output string")).orderBy("i").collect()
    for text, row in zip(texts, rows):
        assert (row.program and row.program.asDict(recursive=True)) == read(text.strip()), text
    assert rows[-1].program is None and rows[-2].program is None and rows[0].program is not None and rows[1].program.answer.operands[0].quote == 'xé\\"'
