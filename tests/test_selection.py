from pyspark.sql import functions as F

from strandset.operators import metrics, revisions, sampling, selection
from strandset.operators.significance import paired_bootstrap

COLUMNS = "qid string, index int, tier int, answer string, logprob double, certified boolean, ranker_score double"


def test_execution_guided_choice(spark):
    rows = [
        ("tier", 0, 1, "a", -0.1, False, 0.0), ("tier", 1, 2, "b", -9.0, True, 0.0),
        ("votes", 0, 2, "a", -0.1, True, 0.0), ("votes", 1, 2, "b", -5.0, True, 0.0), ("votes", 2, 2, "b", -4.0, True, 0.0),
        ("likely", 0, 2, "a", -2.0, True, 0.0), ("likely", 1, 2, "b", -1.0, True, 0.0),
        ("text", 0, 2, "a", -1.0, True, 0.0), ("text", 1, 2, "b", -1.0, True, 0.0),
        ("empty", 0, 0, "", -3.0, False, 0.0), ("empty", 1, 0, "", -2.0, False, 0.0), ("empty", 2, 0, "", -2.0, False, 0.0),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    assert {r.qid: r["index"] for r in selection.by_execution(df).collect()} == {"tier": 1, "votes": 2, "likely": 1, "text": 1, "empty": 1}
    assert {r.qid: r["index"] for r in selection.by_likelihood(df).collect()} == {"tier": 0, "votes": 0, "likely": 1, "text": 0, "empty": 1}
    assert {r.qid: r.answer for r in selection.consensus(df, best_tier=True).collect()} == {"tier": "b", "votes": "b", "likely": "b", "text": "b"}


def test_ranker_choice(spark):
    rows = [("q", 0, 2, "alpha", -1.0, True, 0.0), ("q", 1, 1, "beta", -1.0, True, 2.0), ("q", 2, 2, "beta", -1.0, True, 1.0)]
    assert selection.by_ranker(spark.createDataFrame(rows, COLUMNS)).first()["index"] == 2


def test_output_contracts(spark):
    c = [("q", [(f"<ANSWER>{a}</ANSWER>" if a else "none", "stop", 1, lp, None, None) for a, lp in (("Delta", -2.0), ("delta!", -3.0), ("", -0.1))])]
    preds = spark.createDataFrame(c, "qid string, candidates array<struct<output:string,finish_reason:string,generated_tokens:int,average_logprob:double,ranker_score:double,meta_ranker_score:double>>")
    contexts = spark.createDataFrame([("q", "?", [(0, "T", ["s"])])], "qid string, question string, documents array<struct<doc:int,title:string,sentences:array<string>>>")
    got = selection.by_execution(selection.candidates(preds, contexts, "answer")).first()
    assert (got["index"], got.answer, got.consensus, got.answer_valid) == (0, "delta", 2, 2)
    texts = ['<CITATION>{"answer": "x", "evidence": [[0, 0]]}</CITATION>', '{"answer": "x", "evidence": [[0, 9]]}', '{"answer": "x", "evidence": [[0, true]]}', '{"answer": 3, "evidence": []}']
    preds = preds.withColumn("candidates", F.array(*[F.struct(F.lit(x).alias("output"), F.lit("").alias("finish_reason"), F.lit(1).alias("generated_tokens"), F.lit(-1.0).alias("average_logprob"), F.lit(None).cast("double").alias("ranker_score"), F.lit(None).cast("double").alias("meta_ranker_score")) for x in texts]))
    assert [r.tier for r in selection.candidates(preds, contexts, "citation").orderBy("index").collect()] == [2, 1, 0, 0]


def test_set_prf_and_percentile(spark):
    a = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
    for p, g, want in (([1, 2], [2], (0, 0.5, 1, 2 / 3)), ([], [], (1, 1, 1, 1)), ([], [1], (0, 0, 0, 0)), ([1], [1], (1, 1, 1, 1))):
        r = spark.range(1).select(metrics.set_prf(a(p), a(g)).alias("x")).first().x
        assert all(abs(x - y) < 1e-12 for x, y in zip(r, want))
    assert metrics.floor_percentiles(spark.range(1, 8), "id", {"x": 0.95}).first().x == 6
    rows = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), ("a", None), ("b", 7.0)], "g string, v double")
    got = {r.g: (r.n, r.p0, r.p50, r.p99) for r in metrics.floor_percentiles(rows, "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99}, "g").collect()}
    assert got == {"a": (3, 1.0, 3.0, 3.0), "b": (1, 7.0, 7.0, 7.0)} and metrics.floor_percentiles(rows.limit(0), "v", {"x": 0.5}).count() == 0


def test_last_prediction_wins_and_prefixed_ids_match(spark):
    preds = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("d:b", "3", 3)], "id string, output string, line int")
    contexts = spark.createDataFrame([("d", "a"), ("d", "b"), ("d", "c")], "dataset string, qid string")
    got = metrics.matched(contexts, metrics.last_by_id(preds)).collect()
    assert {r.qid: r.output for r in got} == {"a": "2", "b": "3", "c": None}


def test_balanced_sample(spark):
    rows = [(f"h{i}", "hotpotqa", "copy") for i in range(10)] + [(f"w{i}", "2wiki", op) for i, op in enumerate(["copy"] * 6 + ["equal"] * 6)]
    got = sampling.balanced(spark.createDataFrame(rows, "id string, dataset string, op string"), 8, 1).collect()
    count = lambda **kw: sum(all(r[k] == v for k, v in kw.items()) for r in got)
    assert len(got) == 8 and count(dataset="hotpotqa") == 4 and count(dataset="2wiki", op="copy") == 2 and count(dataset="2wiki", op="equal") == 2
    assert sampling.balanced(spark.createDataFrame(rows, "id string, dataset string, op string"), 0, 1).count() == 0


def test_revisions(spark):
    rows = spark.createDataFrame([("t", 1, "2020", "x", 0), ("t", 2, "2019", "y", 1), ("t", 1, "2021", "z", 2)], "title string, revid int, timestamp string, content string, line int")
    got = revisions.pairs(revisions.streams(rows)).collect()
    assert [(r.revid, r.next_revid, r.old, r.new) for r in got] == [(2, 1, "y", "z")]
    act = revisions.history_action(F.array(F.lit("abc")), F.array(F.lit("b")), F.lit("abc"), F.col("new"))
    news = spark.createDataFrame([("abc",), ("xabcx",), ("b",), ("q",)], "new string")
    assert [r.x for r in news.select(act.alias("x")).collect()] == ["reuse", "reuse", "replay", "recompile"]
    change = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a", "b"], ["a"])], "old array<string>, new array<string>")
    assert [r.recompute for r in revisions.lost_cells(change, 2, F.lit("s")).collect()] == [False, True]


def test_bootstrap(spark):
    rows = spark.createDataFrame([(str(i), 1.0) for i in range(3)], "id string, difference double")
    r = paired_bootstrap(rows, samples=100, seed=7).first()
    assert (r.two_sided_p, r.mean_difference, r.ci95_lower, r.wins, r.examples) == (2 / 101, 100.0, 100.0, 3, 3)
    assert paired_bootstrap(rows.limit(0)).count() == 0


def test_choosers_over_answer_groups(spark):
    """A tie of counts goes to likelihoods of the best tier alone, then to the larger text; a missing score or likelihood comes last."""
    from strandset.operators.selection import by_best_tier, by_ranker_score, chooser_accuracy

    model = {"means": [0.0] * 16, "scales": [1.0] * 16, "weight1": [[1.0] + [0.0] * 15], "bias1": [0.0], "weight2": [1.0], "bias2": 0.0}
    rows = [  # qid, answer, n, n_best, best_logprob, ranker_score, first feature, right
        ("a", "x", 3, 1, -2.0, 0.5, 0.1, False), ("a", "y", 1, 1, -1.0, None, 0.2, True), ("a", "z", 2, 0, None, 0.5, 0.2, None),
        ("b", "x", 1, 2, None, 1.0, 0.9, True), ("b", "y", 1, 2, None, 1.0, 0.9, False), ("c", "only", 1, 0, None, None, 0.0, True),
    ]
    g = spark.createDataFrame(rows, "qid string, answer string, n long, n_best int, best_logprob double, ranker_score double, f double, right boolean")
    g = g.withColumn("features", F.concat(F.array("f"), F.array_repeat(F.lit(0.0), 15)))
    assert {(r.qid, r.answer) for r in by_best_tier(g).collect()} == {("a", "y"), ("b", "y"), ("c", "only")}
    assert {(r.qid, r.answer) for r in by_ranker_score(g).collect()} == {("a", "x"), ("b", "y"), ("c", "only")}
    assert {r.chooser: (r.questions, round(r.accuracy, 6)) for r in chooser_accuracy(g, model).collect()} == {"execution": (3, 0.666667), "ranker": (3, 0.333333), "model": (3, 0.333333)}
    assert chooser_accuracy(g.limit(0), model).count() == 0
