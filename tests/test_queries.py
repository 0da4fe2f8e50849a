import math
import os

import pytest

import __spark_entry__ as entry
from strandset.plans.queries import ORACLES, QUERIES

NAMES = ["vm_copy_bridge", "vm_argmin", "vm_errors", "error_histogram", "evaluate_summary", "contract_ablation", "bind_cells", "refresh_actions", "update_stress_matrix", "attack_matrix", "select_execution", "sentence_cells", "token_f1_pairs", "revision_pairs", "gold_compile", "evaluation_report", "candidate_report", "output_baselines", "static_answers", "ranker_passages", "revision_stream", "revision_pages", "revision_unresolved", "revision_summary", "history_events", "recovery_cases", "recovery_sample", "recovery_report", "recovery_answers", "doc_version_gate", "consensus", "answer_groups", "verify_by_changes", "stale_results", "provenance_comparison", "deletion_provenance", "run_comparison", "task_comparison", "meta_score", "chooser_accuracy", "normalize", "floor_percentiles", "length_profile"]


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


def plain(rows):
    return sorted(tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    found = duck.execute(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(d[0] for d in found.description)
    order = [[d[0] for d in found.description].index(c) for c in columns]
    assert plain(df.select(*columns).collect()) == plain([[r[i] for i in order] for r in found.fetchall()])


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, sf):
    assert entry.entry(spark).count() > 0


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_gate_executes_programs_once(spark, sf):
    """The changed contexts have none."""
    assert plan(QUERIES["doc_version_gate"](spark, sf)).count("_read(") == 1


def test_oracle_equals_sql(spark, sf, duck):
    """By value, as the SQL gives decimals."""
    found = [(qid, float(em)) for qid, em in duck.execute(ORACLES["oracle_at_n"]).fetchall()]
    assert sorted(tuple(r) for r in QUERIES["oracle_at_n"](spark, sf).select("qid", "em").collect()) == sorted(found)


@pytest.mark.parametrize("name", ["oracle_at_n", "answer_groups"])
def test_texts_are_folded_in_one_call(spark, sf, name):
    """Beside the reader of programs and the texts that execution compares."""
    assert plan(QUERIES[name](spark, sf)).count("ArrowEvalPython") == 3


@pytest.mark.parametrize("name,readers", [("recovery_answers", 0), ("recovery_report", 1)])
def test_cases_are_found_once(spark, sf, name, readers):
    """What is left of the plan reads stored cases, and the report their outputs."""
    assert plan(QUERIES[name](spark, sf)).count("_read(") == readers


@pytest.mark.parametrize("name", ["ranker_pairs", "paired_bootstrap", "candidate_scores", "candidate_report"])
def test_candidates_are_executed_once(spark, sf, name):
    """No more readers of programs than in the candidates themselves; stored candidates have none."""
    assert plan(QUERIES[name](spark, sf)).count("_read(") <= 1


def test_passages_leave_contexts_behind(spark, sf):
    text = plan(QUERIES["ranker_passages"](spark, sf))
    assert "__cited" in text and "documents" not in text[: text.index("Window")]


def test_runs_are_executed_once_for_both_metrics(spark, sf):
    assert plan(QUERIES["run_comparison"](spark, sf)).count("_read(") == 2


def test_outputs_are_read_once_for_all_tasks(spark, sf, monkeypatch):
    from strandset.operators import significance

    calls, parsed = [], significance.parsed
    monkeypatch.setattr(significance, "parsed", lambda *args: calls.append(args) or parsed(*args))
    assert QUERIES["task_comparison"](spark, sf).count() == 6 and len(calls) == 1


def test_summary_of_updates_executes_contexts_once(spark, sf, duck):
    """And equals its SQL."""
    df, found = QUERIES["update_summary"](spark, sf), duck.execute(ORACLES["update_summary"])
    assert plan(df).count("_read(") == 1
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names) and plain(df.select(*names).collect()) == plain(found.fetchall())


def calls(frame):
    """The columns of the rows that wait for each Arrow call of a plan, the last call first."""
    out, left = [], [frame._jdf.queryExecution().optimizedPlan()]
    while left:
        node = left.pop(0)
        if node.nodeName() == "ArrowEvalPython":
            rows = node.children().apply(0).output()
            out.append({rows.apply(i).name() for i in range(rows.size())})
        left += [node.children().apply(i) for i in range(node.children().size())]
    return out


CANDIDATES = ["answer_groups", "candidate_report", "candidate_scores", "chooser_accuracy", "meta_score", "select_execution", "select_ranker", "consensus", "oracle_at_n", "ranker_pairs", "ranker_passages"]


@pytest.mark.parametrize("name", CANDIDATES)
def test_candidates_wait_for_arrow_without_contexts(spark, sf, name):
    """A row that waits may go to disk: when answers are folded nothing is left of its documents, program and result, and its program is read before it has documents."""
    *_, folding, resolving, reading = calls(QUERIES[name](spark, sf))
    assert "documents" not in reading and not folding & {"documents", "program", "result", "__lines"}
    assert "__lines" in resolving and "documents" not in resolving


@pytest.mark.parametrize("name", ["select_ranker", "consensus"])
def test_candidates_move_once(spark, sf, name):
    """Beside the two moves that pair orders."""
    assert QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(qid") == 1


def test_scores_of_candidates_store_nothing(spark, sf):
    assert all("candidates-" not in f and "judged-" not in f for name in ("candidate_scores", "candidate_report") for f in QUERIES[name](spark, sf).inputFiles())


def test_texts_are_sent_to_the_reader(spark):
    """Nulls in place of the texts that need no reader would let Spark run ahead and keep all rows of a task."""
    from strandset.operators.program import parsed

    text = plan(parsed(spark.createDataFrame([("{}",)], "output string")))
    assert "_read(__payload" in text


def test_provenance_executes_programs_once(spark, sf):
    assert plan(QUERIES["provenance_comparison"](spark, sf)).count("_read(") == 1


def test_bootstrap_of_choices_equals_separate_choices(spark):
    from strandset.operators import selection, significance

    rows = [(str(q), i, (q * 3 + i) % 3, "ab"[(q + i) % 2] if (q + i) % 3 else "", -((q * 7 + i * 5) % 4) / 4.0, True, float((q + 2 * i) % 3 == 0)) for q in range(40) for i in range(4)]
    df = spark.createDataFrame(rows, "qid string, index int, tier int, answer string, logprob double, certified boolean, em double")
    want = significance.differences(selection.by_likelihood(df), selection.by_execution(df), "em")
    got = selection.by_execution(df.withColumn("base", selection.of_likeliest("em"))).selectExpr("qid", "em - base as difference")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
