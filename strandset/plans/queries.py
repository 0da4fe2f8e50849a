"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandset.functions import text as t
from strandset.functions.constants import DEMONYMS, MAXIMUM_CUES, MINIMUM_CUES
from strandset.operators import lineage, metrics, readings, reports, revisions, sampling, selection, significance, updates
from strandset.operators.program import rendered
from strandset.operators.training import TASKS, context_text
from strandset.operators.vm import execute
from strandset.plans import orders
from strandset.plans.orders import SQL, outcome_sql, table
from strandset.sources import shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


OUT = f"WITH {SQL}, r AS ({outcome_sql('kind', 'g')})"
SOUND = "CASE WHEN valid THEN found ELSE '' END"


def results(spark, sf_dir):
    return execute(orders.programs(spark, sf_dir))


def kind_sql(kind):
    """Outcomes of programs of one kind for every order."""
    return f"WITH {SQL}, a AS (SELECT g.*, '{kind}' AS own FROM g), r AS ({outcome_sql('own', 'a')})"


def vm_kind(kind):
    def run(spark, sf_dir):
        rows = orders.programs_of(spark, sf_dir, kind)
        return execute(rows).select("qid", "result.valid", "result.certified", "result.answer", F.col("result.candidate_answer").alias("candidate"))

    return run


for _kind, _name in {
    "copy": "vm_copy_bridge", "composition": "vm_composition", "argmin": "vm_argmin", "argmax": "vm_argmax", "equal": "vm_equal", "common": "vm_common", "bool": "vm_bool_uncertified",
    "literal": "vm_literal_rejected", "no_anchor": "vm_join_missing_anchor", "disconnected": "vm_disconnected", "uncited": "vm_uncited",
}.items():
    query(f"{kind_sql(_kind)} SELECT qid, valid, certified, {SOUND} AS answer, candidate FROM r", _name)(vm_kind(_kind))


@query(f"WITH {SQL} SELECT qid, kind, kind = 'unparsed' AS parse_error, CASE WHEN kind = 'unparsed' THEN -1 WHEN kind IN ('argmin','argmax','equal','common') THEN 2 WHEN kind IN ('composition','no_anchor','disconnected') THEN 3 ELSE 2 END AS n_evidence FROM g")
def parse_programs(spark, sf_dir):
    return orders.programs(spark, sf_dir).select("qid", "kind", "parse_error", F.coalesce(F.size("program.evidence"), F.lit(-1)).alias("n_evidence"))


ERRORS = """
e AS (SELECT CASE kind WHEN 'unparsed' THEN ['parse_error'] WHEN 'literal' THEN ['ungrounded literal answer is disabled'] WHEN 'no_anchor' THEN ['join[1]: anchor is absent from right input', 'multi-document proof join graph is disconnected']
  WHEN 'disconnected' THEN ['multi-document proof join graph is disconnected'] WHEN 'uncited' THEN ['answer: pointer is not cited evidence']
  ELSE CASE WHEN kind IN ('argmin','argmax') AND title2 IS NULL THEN ['evidence[1]: document out of range','answer.operand[1]: document out of range','answer.label[1]: document out of range','ordered comparison contains an unparseable scalar']
    WHEN kind = 'equal' AND title2 IS NULL THEN ['evidence[1]: document out of range','answer.operand[1]: document out of range']
    WHEN kind = 'common' AND title2 IS NULL THEN ['evidence[1]: document out of range','answer.operand[1]: document out of range','common operands do not normalize to one value']
    WHEN kind = 'common' AND NOT sound THEN ['common operands do not normalize to one value'] ELSE [] END END AS errors, * FROM r)
"""


@query(f"{OUT}, {ERRORS} SELECT qid, array_to_string(errors, ' | ') AS errors FROM e WHERE kind <> 'unparsed'")
def vm_errors(spark, sf_dir):
    return results(spark, sf_dir).where("program is not null").select("qid", F.array_join("result.errors", " | ").alias("errors"))


TRUTH = "CASE WHEN kind = 'composition' THEN region WHEN kind = 'equal' THEN CASE WHEN k % 24 = 4 THEN 'neither' WHEN nation = nation2 THEN 'yes' ELSE 'no' END WHEN kind = 'bool' THEN 'yes' ELSE nation END"
SCORED = f"{OUT}, {ERRORS}, s AS (SELECT *, {TRUTH} AS truth, CASE WHEN sound AND found = {TRUTH} THEN 1.0 ELSE 0.0 END AS em FROM e)"


def scored(spark, sf_dir):
    return metrics.scored(orders.outputs(orders.contexts(spark, sf_dir)))


@query(f"{SCORED} SELECT error, count(*) AS n FROM (SELECT unnest(CASE WHEN valid AND em = 0 THEN ['valid_wrong_answer'] ELSE errors END) AS error FROM s) GROUP BY 1")
def error_histogram(spark, sf_dir):
    return metrics.error_histogram(scored(spark, sf_dir))


EV = """x AS (SELECT *, CASE kind WHEN 'unparsed' THEN 0.0 WHEN 'argmin' THEN 0.0 WHEN 'argmax' THEN 0.0 WHEN 'equal' THEN 0.5 WHEN 'common' THEN 0.5 WHEN 'composition' THEN 2/3::DOUBLE WHEN 'no_anchor' THEN 2/3::DOUBLE WHEN 'disconnected' THEN 2/3::DOUBLE ELSE 1.0 END AS p,
  CASE WHEN kind IN ('unparsed','argmin','argmax') THEN 0.0 WHEN kind IN ('equal','common') THEN 0.5 ELSE 1.0 END AS rc FROM s),
y AS (SELECT *, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END AS f, CASE WHEN p = 1 AND rc = 1 THEN 1.0 ELSE 0.0 END AS ee FROM x)"""


@query(f"{SCORED}, {EV} SELECT qid, ee AS em, round(p, 6) AS precision, round(rc, 6) AS recall, round(f, 6) AS f1 FROM y")
def evidence_prf(spark, sf_dir):
    e = F.col("evidence_score")
    return scored(spark, sf_dir).select("qid", e["em"].alias("em"), *[F.round(e[c], 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    f"""{SCORED}, {EV} SELECT count(*) AS examples, round(100.0 * avg((kind <> 'unparsed')::INT), 6) AS parse_rate, round(100.0 * avg(valid::INT), 6) AS valid_rate, round(100.0 * avg(certified::INT), 6) AS certified_rate,
round(100.0 * avg(sound::INT), 6) AS candidate_rate, round(100.0 * avg(em), 6) AS answer_em, round(100.0 * avg(CASE WHEN valid THEN em ELSE 0 END), 6) AS strict_em,
round(100.0 * sum(CASE WHEN valid THEN em ELSE 0 END) / greatest(sum(valid::INT), 1), 6) AS valid_em, round(100.0 * sum(CASE WHEN certified THEN em ELSE 0 END) / greatest(sum(certified::INT), 1), 6) AS certified_em,
round(100.0 * avg(f), 6) AS evidence_f1, round(100.0 * avg(em * ee), 6) AS joint_em FROM y"""
)
def evaluate_summary(spark, sf_dir):
    s = metrics.summary(scored(spark, sf_dir))
    return s.select("examples", *[F.round(c, 6).alias(c) for c in ("parse_rate", "valid_rate", "certified_rate", "candidate_rate", "answer_em", "strict_em", "valid_em", "certified_em", "evidence_f1", "joint_em")])


OPS = "CASE WHEN kind IN ('composition','no_anchor','disconnected','uncited') THEN 'copy' ELSE kind END"
LEVELS = {
    "operator": OPS, "join_family": "CASE WHEN kind IN ('argmin','argmax','equal','common') THEN 'none' ELSE 'both' END",
    "mode": "CASE WHEN kind IN ('argmin','argmax','equal','common') THEN 'comparison' WHEN kind IN ('composition','disconnected') THEN 'composition' ELSE 'bridge' END",
}


def _breakdown(level):
    def run(spark, sf_dir):
        rates = ("share", "answer_valid_rate", "valid_rate", "certified_rate", "answer_f1", "strict_f1")
        found = reports.coverage(scored(spark, sf_dir)).where(F.col("level") == level)
        return found.select(F.col("value").alias(level), "examples", *[F.round(c, 6).alias(c) for c in rates])

    return run


for _level, _value in LEVELS.items():
    query(
        f"""{SCORED} SELECT {_value} AS {_level}, count(*) AS examples, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share, round(100.0 * avg(sound::INT), 6) AS answer_valid_rate, round(100.0 * avg(valid::INT), 6) AS valid_rate,
round(100.0 * avg(certified::INT), 6) AS certified_rate, round(100.0 * avg(em), 6) AS answer_f1, round(100.0 * avg(CASE WHEN valid THEN em ELSE 0 END), 6) AS strict_f1 FROM s WHERE kind <> 'unparsed' GROUP BY 1""",
        f"{_level}_breakdown",
    )(_breakdown(_level))


@query(
    f"""{SCORED}, v AS (SELECT unnest(['full','no_connectivity','citation_only','free_literal','answer_only']) AS variant),
x AS (SELECT *, valid OR sound AND (kind = 'disconnected' AND variant IN ('no_connectivity','citation_only') OR kind = 'no_anchor' AND variant = 'citation_only' OR variant = 'answer_only') OR kind = 'literal' AND variant = 'free_literal' AS accepted FROM s, v)
SELECT variant, count(*) AS examples, CAST(sum((kind <> 'unparsed')::INT) AS BIGINT) AS parsed, CAST(sum(accepted::INT) AS BIGINT) AS accepted, round(100.0 * avg(accepted::INT), 6) AS accepted_rate, round(100.0 * avg(em), 6) AS answer_em, round(100.0 * avg(em), 6) AS answer_f1,
round(100.0 * avg(CASE WHEN accepted THEN em ELSE 0 END), 6) AS strict_em, round(100.0 * avg(CASE WHEN accepted THEN em ELSE 0 END), 6) AS strict_f1 FROM x GROUP BY 1"""
)
def contract_ablation(spark, sf_dir):
    rows = reports.ablation(orders.outputs(orders.contexts(spark, sf_dir)))
    return rows.select("variant", "examples", "parsed", "accepted", *[F.round(c, 6).alias(c) for c in ("accepted_rate", "answer_em", "answer_f1", "strict_em", "strict_f1")])


def bound(spark, sf_dir):
    return lineage.bind(results(spark, sf_dir))


CELLS = """
c AS (SELECT qid, k, kind, 'sentence' AS field, 0 AS doc, 0 AS sent, title || ' was placed by ' || customer || '.' AS text FROM r WHERE valid AND kind IN ('copy','composition','bool')
UNION ALL SELECT qid, k, kind, 'sentence', 1, 0, customer || ' is based in ' || nation || '.' FROM r WHERE valid AND kind IN ('copy','composition','bool','equal','common')
UNION ALL SELECT qid, k, kind, 'question', -1, -1, 'Which nation is the customer of ' || title || ' based in?' FROM r WHERE valid AND kind IN ('copy','composition','bool')
UNION ALL SELECT qid, k, kind, 'title', 0, -1, title FROM r WHERE valid AND kind IN ('copy','composition','bool','argmin','argmax')
UNION ALL SELECT qid, k, kind, 'title', 1, -1, customer FROM r WHERE valid AND kind IN ('copy','composition','bool')
UNION ALL SELECT qid, k, kind, 'title', 2, -1, nation FROM r WHERE valid AND kind = 'composition'
UNION ALL SELECT qid, k, kind, 'sentence', 2, 0, nation || ' belongs to ' || region || '.' FROM r WHERE valid AND kind = 'composition'
UNION ALL SELECT qid, k, kind, 'sentence', 0, 1, 'It was ordered on ' || day || '.' FROM r WHERE valid AND kind IN ('argmin','argmax')
UNION ALL SELECT qid, k, kind, 'sentence', 3, 1, 'It was ordered on ' || day2 || '.' FROM r WHERE valid AND kind IN ('argmin','argmax')
UNION ALL SELECT qid, k, kind, 'title', 3, -1, title2 FROM r WHERE valid AND kind IN ('argmin','argmax')
UNION ALL SELECT qid, k, kind, 'sentence', 4, 0, customer2 || ' is based in ' || nation2 || '.' FROM r WHERE valid AND kind IN ('equal','common'))
"""


@query(f"{OUT}, {CELLS} SELECT qid, field, doc, sent, sha256(text) AS sha256 FROM c")
def bind_cells(spark, sf_dir):
    return bound(spark, sf_dir).where("snapshot is not null").select("qid", F.explode("snapshot.cells").alias("c")).select("qid", "c.field", "c.doc", "c.sent", "c.sha256")


def moved(spark, sf_dir):
    """Bound results with the documents of ``news``."""
    return bound(spark, sf_dir).where("snapshot is not null").withColumns({"documents": news(F.col("documents")), "cached_answer": F.col("result.answer")})


def news(d):
    """Each third customer moves to another nation, each fifth order changes status, each seventh loses its status sentence."""
    new = updates.with_cell(d, lineage.key("sentence", F.lit(1), F.when(F.col("k") % 3 == 0, 0).otherwise(-9)), lambda x: F.concat(F.col("customer"), F.lit(" is based in NATION_99.")))
    new = updates.with_cell(new, lineage.key("sentence", F.lit(0), F.when(F.col("k") % 5 == 0, 2).otherwise(-9)), lambda x: F.lit("Its status is X."))
    return updates.with_sentences(new, F.when(F.col("k") % 7 == 0, 0).otherwise(-9), lambda s: F.slice(s, F.lit(1), F.lit(2)))


@query(f"{OUT}, {CELLS} SELECT qid, field, doc, sent FROM c WHERE k % 3 = 0 AND field = 'sentence' AND doc = 1")
def verify_changed(spark, sf_dir):
    return lineage.verify(moved(spark, sf_dir)).select("qid", F.explode("check.changed").alias("c")).select("qid", "c.field", "c.doc", "c.sent")


def stale(spark, sf_dir, changes, buckets=64):
    """Results made stale by changes, from a table of readings written for this run."""
    path = shared.new_path(spark, "readings")
    readings.write_readings(readings.readings(bound(spark, sf_dir)), path, buckets)
    return readings.stale(shared.written(changes, "changes"), readings.read_readings(spark, path), buckets)


@query(f"{OUT}, {CELLS} SELECT qid, field, doc, sent FROM c WHERE k % 3 = 0 AND field = 'sentence' AND doc = 1")
def verify_by_changes(spark, sf_dir):
    rows = orders.contexts(spark, sf_dir)
    found = stale(spark, sf_dir, readings.changes_between(rows.withColumn("new_documents", news(F.col("documents")))))
    return found.select("qid", F.explode("changed").alias("c")).select("qid", "c.field", "c.doc", "c.sent")


@query(
    f"""{OUT}, {CELLS}, m AS (SELECT qid, list_sort(list(field || ':' || doc || ':' || sent)) AS cells FROM c WHERE k % 3 = 0 AND field = 'sentence' AND doc = 1 GROUP BY 1)
SELECT qid, coalesce(array_to_string(cells, ' '), '') AS changed, '' AS missing, k % 7 = 0 AS structure_changed FROM r LEFT JOIN m USING (qid) WHERE valid AND (k % 7 = 0 OR cells IS NOT NULL)"""
)
def stale_results(spark, sf_dir):
    """Results to look at after the news, without a look at the others."""
    rows = orders.contexts(spark, sf_dir)
    found = stale(spark, sf_dir, readings.changes_between(rows.withColumn("new_documents", news(F.col("documents")))))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["field"], x["doc"], x["sent"])), " ").alias(c)
    return found.select("qid", told("changed"), told("missing"), "structure_changed")


@query(f"{OUT}, {CELLS} SELECT qid, field, doc, sent FROM c WHERE field = 'sentence' AND sent = (CASE WHEN kind IN ('argmin','argmax') THEN 1 ELSE 0 END) AND doc = 0")
def verify_missing(spark, sf_dir):
    rows = bound(spark, sf_dir).where("snapshot is not null")
    cut = updates.with_sentences(F.col("documents"), F.lit(0), lambda s: F.slice(s, F.lit(1), F.lit(0)))
    return lineage.verify(rows.withColumn("documents", cut)).select("qid", F.explode("check.missing").alias("c")).select("qid", "c.field", "c.doc", "c.sent")


ACTIONS = """CASE WHEN k % 7 = 0 THEN 'recompile' WHEN k % 3 = 0 AND kind = 'bool' THEN 'recompile' WHEN k % 3 = 0 AND kind IN ('copy','composition','equal','common') THEN 'recompile' ELSE 'reuse' END"""


@query(f"{OUT} SELECT qid, {ACTIONS} AS action, CASE WHEN {ACTIONS} = 'reuse' THEN found ELSE '' END AS new_answer FROM r WHERE valid")
def refresh_actions(spark, sf_dir):
    return lineage.refresh(moved(spark, sf_dir)).select("qid", "action", "new_answer")


CERTIFIED = "SELECT * FROM r WHERE certified"
VALUE = "kind IN ('copy','composition','argmin','argmax','equal','common')"


@query(
    f"""{OUT}, q AS ({CERTIFIED}), n AS (SELECT count(*) AS n FROM q)
SELECT 'unread_cell_update' AS class, n AS eligible, n AS hits FROM n UNION ALL SELECT 'value_preserving_rewrite', n, n FROM n UNION ALL SELECT 'answer_value_replacement', n, n FROM n
UNION ALL SELECT 'sentence_insertion', n, n FROM n UNION ALL SELECT 'sentence_deletion', n, n FROM n"""
)
def update_stress_matrix(spark, sf_dir):
    return updates.update_stress(bound(spark, sf_dir)).select("class", "eligible", "hits")


@query(f"""{OUT} SELECT 'counterfactual_entity_or_number' AS attack, count(*) AS attempts, count(*) AS safe FROM r WHERE certified
UNION ALL SELECT 'disconnected_evidence', count(*), count(*) FROM r WHERE valid AND kind IN ('copy','composition','bool')
UNION ALL SELECT 'distractor_poisoning', count(*), count(*) FROM r WHERE valid UNION ALL SELECT 'missing_source', count(*), count(*) FROM r WHERE valid""")
def attack_matrix(spark, sf_dir):
    return updates.attacks(bound(spark, sf_dir)).select("attack", "attempts", "safe")


@query(f"{OUT} SELECT qid, NOT (k % 3 = 0 AND kind IN ('copy','composition','equal','common') OR k % 5 = 0 AND kind IN ('copy','composition','argmin','argmax') OR k % 7 = 0 AND kind IN ('copy','composition','argmin','argmax')) AS gate, NOT (k % 7 = 0 OR k % 3 = 0 AND kind IN ('copy','composition','equal','common')) AS lineage FROM r WHERE certified")
def doc_version_gate(spark, sf_dir):
    changed = orders.contexts(spark, sf_dir).withColumn("documents", news(F.col("documents")))  # nothing is executed in them
    return updates.document_gate(bound(spark, sf_dir), changed).select("qid", "gate", "lineage")


CAND = f"""WITH {SQL}, a AS (SELECT g.*, i AS idx, ['copy','composition','argmin','argmax','equal','common','bool','literal','no_anchor','disconnected','uncited','unparsed'][CAST((k + i) % 12 AS INTEGER) + 1] AS own,
  -((k * 7 + i * 13) % 100) / 100.0::DOUBLE AS logprob, ((k * 11 + i * 29) % 17) / 4.0::DOUBLE AS score FROM g, (SELECT unnest(range(4)) AS i)),
r AS ({outcome_sql('own', 'a')}), t AS (SELECT qid, k, idx, own, logprob, score, CASE WHEN valid THEN 2 WHEN sound THEN 1 ELSE 0 END AS tier,
  CASE WHEN sound THEN lower(replace(replace(found, '_', ''), '#', '')) ELSE '' END AS answer FROM r)"""


def candidates(spark, sf_dir, taken=None, cited=None, **texts):
    """Executed candidates; other columns of texts are folded in the Arrow call that folds the answers. Rows wait for that call, so what is used of their results
    and programs is taken out before (``taken``: more columns of that kind; ``cited``: a column of their documents, taken before they are executed), and the optimizer
    leaves the rest behind."""
    rows = orders.candidate_rows(spark, sf_dir)
    rows = execute(rows if cited is None else rows.withColumn("cited", cited))
    r = F.col("result")
    tier = F.coalesce(F.when(r["valid"], 2).when(r["answer_valid"], 1), F.lit(0))
    raw = F.coalesce(F.when(r["answer_valid"], r["candidate_answer"]), F.lit(""))
    rows = rows.withColumns({"tier": tier, "raw": raw, "certified": F.coalesce(r["certified"], F.lit(False)), **(taken or {})})
    folded = {name: t.normalize_all(text) if dict(rows.dtypes)[text].startswith("array") else t.normalize(text) for name, text in texts.items()}
    # an empty text needs no folding; as raw stands here twice, the optimizer doesn't put the result back in its place
    return rows.withColumns({"answer": F.coalesce(t.normalize(F.when(F.col("raw") != "", F.col("raw"))), F.lit("")), **folded})


@query(f"""{CAND}, b AS (SELECT *, max(tier) OVER (PARTITION BY qid) AS best FROM t), e AS (SELECT *, CASE WHEN answer = '' THEN 0 ELSE count(*) OVER (PARTITION BY qid, answer) END AS votes, max(logprob) OVER (PARTITION BY qid, answer) AS top FROM b WHERE tier = best),
n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY answer <> '' DESC, votes DESC, top DESC, answer DESC, logprob DESC, idx) AS n FROM e) SELECT qid, CAST(idx AS INTEGER) AS index, tier, answer, votes AS consensus FROM n WHERE n = 1""")
def select_execution(spark, sf_dir):
    return selection.by_execution(candidates(spark, sf_dir)).select("qid", "index", "tier", "answer", "consensus")


@query(f"{CAND} SELECT qid, CAST(arg_max(idx, logprob * 1000 - idx) AS INTEGER) AS index FROM t GROUP BY 1")
def select_likelihood(spark, sf_dir):
    return selection.by_likelihood(candidates(spark, sf_dir)).select("qid", "index")


@query(f"""{CAND}, e AS (SELECT *, max(score) OVER w AS top, count(*) OVER w AS size FROM t WINDOW w AS (PARTITION BY qid, answer)),
n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY top DESC, size DESC, answer DESC, tier DESC, score DESC, idx) AS n FROM e) SELECT qid, CAST(idx AS INTEGER) AS index FROM n WHERE n = 1""")
def select_ranker(spark, sf_dir):
    return selection.by_ranker(candidates(spark, sf_dir)).select("qid", "index")


@query(f"""{CAND}, e AS (SELECT qid, answer, count(*) AS votes, max(logprob) AS top FROM t WHERE answer <> '' GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, top DESC, answer DESC) AS n FROM e) SELECT qid, answer, votes FROM n WHERE n = 1""")
def consensus(spark, sf_dir):
    return selection.consensus(candidates(spark, sf_dir)).select("qid", "answer", "votes")


@query(f"{CAND} SELECT t.qid, max(CASE WHEN t.answer = lower(replace(nation, '_', '')) THEN 1.0 ELSE 0.0 END) AS em FROM t JOIN g USING (qid) GROUP BY 1")
def oracle_at_n(spark, sf_dir):
    rows = candidates(spark, sf_dir, right="nation").withColumn("em", (F.col("answer") == F.col("right")).cast("double"))
    return selection.oracle(rows.withColumn("f1", F.col("em"))).select("qid", "em")


@query(f"{CAND}, p AS (SELECT DISTINCT t.qid, t.answer AS passage, t.answer = lower(replace(nation, '_', '')) AS ok FROM t JOIN g USING (qid)) SELECT a.qid, a.passage AS positive, b.passage AS negative FROM p a JOIN p b USING (qid) WHERE a.ok AND NOT b.ok")
def ranker_pairs(spark, sf_dir):
    rows = candidates(spark, sf_dir, right="nation").withColumns({"right": F.col("answer") == F.col("right"), "passage": F.col("answer")})
    return selection.ranker_pairs(rows)


MODEL = {"means": [0.5] * 16, "scales": [2.0] * 16, "weight1": [[(i * j % 5 - 2) / 4 for j in range(16)] for i in range(3)], "bias1": [0.1, -0.1, 0.0], "weight2": [0.7, -0.4, 0.2], "bias2": 0.05}


def groups(spark, sf_dir):
    rows = candidates(spark, sf_dir, {"evidence_lines": F.coalesce(F.size("result.cited_text"), F.lit(0))}, question="question").withColumns({"generated_tokens": F.lit(9), "n_candidates": F.lit(4)})
    return selection.answer_groups(rows)


@query(f"""{CAND}, b AS (SELECT *, max(tier) OVER (PARTITION BY qid) AS best, sum((tier = 2)::INT) OVER (PARTITION BY qid) AS strict FROM t), c AS (SELECT *, sum((tier = best)::INT) OVER (PARTITION BY qid) AS bn FROM b)
SELECT qid, answer, round(count(*) / 4.0, 6) AS share, round(sum((tier = best)::INT) / max(bn), 6) AS best_share, CAST(max(tier) AS DOUBLE) AS tier, round(max(strict) / 4.0, 6) AS strict, round(sum((tier = 2)::INT) / count(*), 6) AS own_strict, round(max(logprob), 6) AS top, round(avg(logprob), 6) AS mean,
round(max(score), 6) AS top_score, round(avg(score), 6) AS mean_score FROM c GROUP BY 1, 2""")
def answer_groups(spark, sf_dir):
    names = ("share", "best_share", "tier", "strict", "own_strict", "top", "mean", "top_score", "mean_score")
    return groups(spark, sf_dir).select("qid", "answer", *[F.round(F.get("features", F.lit(i)), 6).alias(n) for i, n in enumerate(names)])


def meta_sql():
    lines = "CASE WHEN own = 'unparsed' THEN 0 WHEN own IN ('composition','no_anchor','disconnected') THEN 3 WHEN own IN ('argmin','argmax','equal','common') AND title2 IS NULL THEN 1 ELSE 2 END"
    asked = "contains('which nation is customer of ' || max(lower(replace(title, '#', ''))) || ' based in', answer) AND answer <> ''"
    weights, out = MODEL["weight1"], MODEL["weight2"]
    hidden = " + ".join(f"({out[i]} * tanh(list_inner_product(z, {w}::DOUBLE[]) + {MODEL['bias1'][i]}))" for i, w in enumerate(weights))
    return f"""{CAND}, b AS (SELECT t.*, title, {lines} AS lines, max(tier) OVER (PARTITION BY qid) AS best, sum((tier = 2)::INT) OVER (PARTITION BY qid) AS strict FROM t JOIN (SELECT qid, title, title2 FROM g) USING (qid)),
c AS (SELECT *, sum((tier = best)::INT) OVER (PARTITION BY qid) AS bn, row_number() OVER (PARTITION BY qid, answer ORDER BY tier DESC, score DESC, logprob DESC, idx) AS nth FROM b),
d AS (SELECT qid, answer, max(CASE WHEN nth = 1 THEN idx END) AS idx, list_transform([count(*) / 4.0, sum((tier = best)::INT) / max(bn), max(tier), max(strict) / 4.0, sum((tier = 2)::INT) / count(*), max(logprob), avg(logprob), max(score), avg(score), max(lines), ln(10.0),
  CASE WHEN answer = '' THEN 0.0 ELSE ln(1.0 + len(string_split(answer, ' '))) END, CASE WHEN {asked} THEN 1.0 ELSE 0.0 END, 0.0, 0.0, 0.0]::DOUBLE[], lambda x: (x - 0.5) / 2.0) AS z FROM c GROUP BY 1, 2),
e AS (SELECT qid, idx, answer, {hidden} + {MODEL["bias2"]} AS score FROM d), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, answer DESC) AS n FROM e)
SELECT qid, CAST(idx AS INTEGER) AS index, round(score, 6) AS meta_score FROM o WHERE n = 1"""


@query(meta_sql())
def meta_score(spark, sf_dir):
    return selection.by_meta(groups(spark, sf_dir), MODEL).select("qid", "index", F.round("meta_score", 6).alias("meta_score"))


RIGHT = "answer = lower(replace(nation, '_', ''))"


@query(
    f"""{meta_sql().rsplit("SELECT qid, CAST(idx", 1)[0]}, x AS (SELECT qid, answer, sum((tier = best)::INT) AS nb, max(CASE WHEN tier = best THEN logprob END) AS bl, max(score) AS top, count(*) AS n FROM c GROUP BY 1, 2),
y AS (SELECT qid, {RIGHT} AS ok, row_number() OVER (PARTITION BY qid ORDER BY nb DESC, bl DESC NULLS LAST, answer DESC) AS a, row_number() OVER (PARTITION BY qid ORDER BY top DESC NULLS LAST, n DESC, answer DESC) AS b FROM x JOIN (SELECT qid, nation FROM g) USING (qid)),
z AS (SELECT 'execution' AS chooser, ok FROM y WHERE a = 1 UNION ALL SELECT 'ranker', ok FROM y WHERE b = 1 UNION ALL SELECT 'model', {RIGHT} FROM o JOIN (SELECT qid, nation FROM g) USING (qid) WHERE n = 1)
SELECT chooser, count(*) AS questions, round(avg(coalesce(ok, false)::INT), 6) AS accuracy FROM z GROUP BY 1"""
)
def chooser_accuracy(spark, sf_dir):
    right = orders.facts(spark, sf_dir).select(F.col("k").cast("string").alias("qid"), t.normalize("nation").alias("right"))
    rows = groups(spark, sf_dir).join(right, "qid").withColumn("right", F.col("answer") == F.col("right"))
    return selection.chooser_accuracy(rows, MODEL).withColumn("accuracy", F.round("accuracy", 6))


@query(f"{OUT} SELECT qid FROM g WHERE k % 4 <> 0")
def pending_anti_join(spark, sf_dir):
    rows = orders.contexts(spark, sf_dir)
    return selection.pending(rows, rows.where("k % 4 = 0")).select("qid")


@query()
def paired_bootstrap(spark, sf_dir):
    rows = candidates(spark, sf_dir, right="nation").withColumn("em", (F.col("answer") == F.col("right")).cast("double"))
    chosen = selection.by_execution(rows.withColumn("base", selection.of_likeliest("em")))  # both choices of a question where its rows meet
    difference = F.coalesce("em", F.lit(0.0)) - F.coalesce("base", F.lit(0.0))
    return significance.paired_bootstrap(chosen.select("qid", difference.alias("difference")), order="qid", samples=5000)


# texts


def folded_sql(text):
    """Lower case, and letters of the Latin blocks as their compatibility decompositions, by a rule over the code points."""
    import unicodedata

    out = f"lower({text})"
    for code in range(0xC0, 0x180):
        to = unicodedata.normalize("NFKD", chr(code)).casefold()
        if to != chr(code) and chr(code).lower() == chr(code):
            out = f"replace({out}, '{chr(code)}', '{to}')"
    return out


SENTENCES = r"""c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM c)"""


def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("t", t.clean("text")).select("doc_id", t.split_sentences(F.col("t")).alias("s"))


@query(f"WITH {SENTENCES} SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent, sha256(s[i]) AS sha256 FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)")
def sentence_cells(spark, sf_dir):
    return sentences(spark, sf_dir).select("doc_id", F.posexplode("s").alias("sent", "x")).select("doc_id", "sent", t.text_digest(F.col("x")).alias("sha256"))


@query(f"WITH {SENTENCES} SELECT doc_id, sha256('[[0,' || len(s) || ']]') AS structure FROM s")
def structure_digest(spark, sf_dir):
    doc = F.array(F.struct(F.lit(0).alias("doc"), F.lit("").alias("title"), F.col("s").alias("sentences")))
    return sentences(spark, sf_dir).select("doc_id", lineage.structure_digest(doc).alias("structure"))


NORM = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {NORM.format(folded_sql('text'))} AS normal FROM documents")
def normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.normalize("text").alias("normal"))


def answer_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", t.normalize(F.coalesce("text", F.lit(""))).alias("a"))
    nxt = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    return rows.join(nxt, "item_id")


PAIRS = f"b AS (SELECT item_id, {NORM.format(folded_sql('text'))} AS a FROM benchmark), p AS (SELECT x.item_id, x.a, y.a AS b FROM b x JOIN b y ON y.item_id = x.item_id + 1)"


@query(f"""WITH {PAIRS}, ta AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(string_split(a, ' ')) AS w FROM p) WHERE w <> '' GROUP BY 1, 2), tb AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(string_split(b, ' ')) AS w FROM p) WHERE w <> '' GROUP BY 1, 2),
o AS (SELECT item_id, sum(least(ta.n, tb.n)) AS o FROM ta JOIN tb USING (item_id, w) GROUP BY 1), na AS (SELECT item_id, sum(n) AS n FROM ta GROUP BY 1), nb AS (SELECT item_id, sum(n) AS n FROM tb GROUP BY 1)
SELECT item_id, round(coalesce(2.0 * o / (na.n + nb.n), 0), 6) AS f1, round(coalesce(o / na.n, 0), 6) AS precision, round(coalesce(o / nb.n, 0), 6) AS recall FROM p LEFT JOIN o USING (item_id) LEFT JOIN na USING (item_id) LEFT JOIN nb USING (item_id)""")
def token_f1_pairs(spark, sf_dir):
    s = t.token_prf(F.col("a"), F.array("b"))
    return answer_pairs(spark, sf_dir).withColumn("s", s).select("item_id", *[F.round(F.col(f"s.{c}"), 6).alias(c) for c in ("f1", "precision", "recall")])


@query(f"WITH {PAIRS} SELECT item_id, CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS em FROM p")
def exact_match_pairs(spark, sf_dir):
    return answer_pairs(spark, sf_dir).select("item_id", t.exact_match(F.col("a"), F.array("b")).alias("em"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS y, CAST(month(o_orderdate) AS DOUBLE) AS m, CAST(day(o_orderdate) AS DOUBLE) AS d, floor(o_totalprice) AS price, CASE WHEN floor(o_totalprice) BETWEEN 1000 AND 2099 THEN 3 ELSE 1 END AS parts FROM orders")
def ordered_scalar(spark, sf_dir):
    plain = t.ordered_scalar(F.floor("o_totalprice").cast("string"))  # four digits that read as a year have a month and a day
    o = table(spark, sf_dir, "orders").withColumns({"x": t.ordered_scalar(F.date_format("o_orderdate", "'on' d MMMM yyyy")), "p": t.ordered_scalar(F.format_number("o_totalprice", 2)), "plain": plain})
    return o.select("o_orderkey", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate("ymd")], F.floor(F.get("p", F.lit(0))).cast("double").alias("price"), F.size("plain").alias("parts"))


@query("SELECT conv_id, turn, CAST(CAST('0x' || substr(sha256(conv_id || ':' || turn), 1, 16) AS UBIGINT) % 10000 AS INTEGER) AS bucket, CASE WHEN CAST('0x' || substr(sha256(conv_id || ':' || turn), 1, 16) AS UBIGINT) % 10000 < 500 THEN 'holdout' ELSE 'train' END AS part FROM conversations")
def hash_partition(spark, sf_dir):
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return sampling.split(table(spark, sf_dir, "conversations"), key).select("conv_id", "turn", t.hash_bucket(key).alias("bucket"), "part")


@query("""WITH r AS (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY quality, toxic ORDER BY sha256('7:' || doc_id), doc_id) AS turn FROM labels), p AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY turn, toxic) AS place FROM r),
q AS (SELECT quality, row_number() OVER (ORDER BY quality) - 1 AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT quality FROM labels)) SELECT doc_id, quality, toxic FROM p JOIN q USING (quality) WHERE place <= 25 // n + (nth < 25 % n)::INT""")
def balanced_subset(spark, sf_dir):
    return sampling.balanced(table(spark, sf_dir, "labels"), 25, 7, "quality", "toxic", "doc_id").select("doc_id", "quality", "toxic")


@query("SELECT item_id FROM benchmark ORDER BY sha256(CAST(item_id AS VARCHAR)) LIMIT 10")
def sha_topk(spark, sf_dir):
    return sampling.first_by_digest(table(spark, sf_dir, "benchmark"), F.col("item_id").cast("string"), 10).select("item_id")


PLACE = "list_sort(list(n_chars))[CAST(floor({} * (count(*) - 1)) AS INTEGER) + 1]"


@query(f"SELECT lang, count(*) AS n, CAST(sum((n_chars <= 2000)::INT) AS BIGINT) AS kept, min(n_chars) AS shortest, {PLACE.format(0.5)} AS p50, {PLACE.format(0.95)} AS p95, {PLACE.format(0.99)} AS p99, max(n_chars) AS longest FROM documents GROUP BY 1")
def length_profile(spark, sf_dir):
    return sampling.length_profile(table(spark, sf_dir, "documents"), "n_chars", 2000, "lang")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def longest_documents(spark, sf_dir):
    return sampling.longest(table(spark, sf_dir, "documents"), "n_chars", "doc_id")


def event_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("title"), F.col("event_id").alias("revid"), F.col("ts").alias("timestamp"), F.col("event_type").alias("content"))
    return revisions.pairs(rows)


@query("SELECT * FROM (SELECT user_id AS title, event_id AS revid, lead(event_id) OVER w AS next_revid, event_type AS old, lead(event_type) OVER w AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE next_revid IS NOT NULL")
def revision_pairs(spark, sf_dir):
    return event_pairs(spark, sf_dir)


@query("""SELECT action, count(*) AS n FROM (SELECT CASE WHEN new = old THEN 'reuse' WHEN contains(new, substr(old, 1, 1)) THEN 'replay' ELSE 'recompile' END AS action FROM (SELECT event_type AS old, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS new FROM events) WHERE new IS NOT NULL) GROUP BY 1""")
def history_routing(spark, sf_dir):
    act = revisions.history_action(F.array("old"), F.array(F.substring("old", 1, 1)), F.col("old"), F.col("new"))
    return event_pairs(spark, sf_dir).select(act.alias("action")).groupBy("action").agg(F.count("*").alias("n"))


@query(f"""{OUT}, {CELLS}, q AS (SELECT qid, kind, count(*) AS deps FROM c WHERE field <> 'question' GROUP BY 1, 2), u AS (SELECT r.*, deps, CASE WHEN title2 IS NULL THEN 8 ELSE 16 END AS cells FROM r JOIN q USING (qid) WHERE certified),
d AS (SELECT customer AS title, deps, cells FROM u WHERE kind IN ('copy','composition') OR kind IN ('equal','common') UNION ALL SELECT customer2, deps, cells FROM u WHERE kind IN ('equal','common') AND customer2 <> customer UNION ALL SELECT title, deps, cells FROM u WHERE kind IN ('copy','composition','argmin','argmax')
UNION ALL SELECT title2, deps, cells FROM u WHERE kind IN ('argmin','argmax') UNION ALL SELECT nation, deps, cells FROM u WHERE kind = 'composition')
SELECT 'orders' AS dataset, title, CAST(round_even(median(deps), 0) AS INTEGER) AS dependency_cells, CAST(round_even(median(cells), 0) AS INTEGER) AS context_cells FROM d GROUP BY 2 ORDER BY sha256('orders:' || title) LIMIT 20""")
def title_profiles(spark, sf_dir):
    return revisions.title_profiles(bound(spark, sf_dir), 20)


#: Orders with a program that copies their day, which is the right answer but for every fourth; cases have a day that stands once.
DAYS = f"""WITH {SQL}, x AS (SELECT *, left(day, -4) || (CAST(right(day, 4) AS INTEGER) + 1) AS new_value, 'It was ordered on ' || day || '.' || coalesce('It was ordered on ' || day2 || '.', '') AS cells FROM g WHERE k % 4 <> 3),
cases AS (SELECT *, 2.0 * len(list_intersect(string_split(day, ' '), string_split(new_value, ' '))) / (len(string_split(day, ' ')) + len(string_split(new_value, ' '))) AS near FROM x WHERE (length(cells) - length(replace(cells, day, ''))) // length(day) = 1 AND NOT contains(cells, new_value))"""


def day_cases(spark, sf_dir):
    rows = orders.programs_of(spark, sf_dir, "day").withColumn("answers", F.array(F.when(F.col("k") % 4 == 3, F.col("nation")).otherwise(F.col("day"))))
    return updates.recovery_cases(lineage.bind(execute(rows)))


@query(f"{DAYS} SELECT qid, day AS old_answer, new_value, new_value AS new_answer FROM cases")
def recovery_cases(spark, sf_dir):
    return day_cases(spark, sf_dir).select("qid", "old_answer", "new_value", F.col("new_result.answer").alias("new_answer"))


@query(f"{DAYS} SELECT qid, new_value FROM cases ORDER BY sha256('orders:' || qid) LIMIT 200")
def recovery_sample(spark, sf_dir):
    return updates.first_cases(day_cases(spark, sf_dir)).select("qid", "new_value")


def _rates(found):
    return found.select("cases", *[F.round(c, 6).alias(c) for c in found.columns if c != "cases"])


@query(
    f"""{DAYS}, y AS (SELECT *, k % 5 AS kind5, CASE WHEN contains(replace(cells, day, new_value), day) THEN 1.0 ELSE 0.0 END AS stands FROM cases)
SELECT count(*) AS cases, round(100.0 * avg(CASE WHEN day = new_value THEN 1.0 ELSE 0.0 END), 6) AS cached_em, round(100.0 * avg(near), 6) AS cached_f1, round(100.0 * avg(stands), 6) AS old_plan_valid,
round(100.0 * avg((kind5 > 1)::INT), 6) AS parse_rate, round(100.0 * avg((kind5 > 2)::INT), 6) AS valid_rate, round(100.0 * avg((kind5 > 2)::INT), 6) AS certified_rate,
round(100.0 * avg((kind5 = 3)::INT), 6) AS candidate_em, round(100.0 * avg((kind5 = 3)::INT), 6) AS candidate_f1, round(100.0 * avg((kind5 = 3)::INT), 6) AS strict_em, round(100.0 * avg((kind5 = 3)::INT), 6) AS strict_f1 FROM y"""
)
def recovery_report(spark, sf_dir):
    """By key modulo 5: no output, no program, the old program, the repaired one, one that answers something else."""
    cases = day_cases(spark, sf_dir)
    output = F.when(F.col("k") % 5 == 1, "none").when(F.col("k") % 5 == 2, rendered(F.col("program"))).when(F.col("k") % 5 == 3, rendered(F.col("repaired"))).otherwise(orders.program_texts()["copy"])
    names = ("dataset", "qid", "k", "question", "changed_documents", "program", "old_answer", "new_answers")
    cases = shared.written(cases.select(*names, output.alias("output")), "cases")  # found once, for both sides
    return _rates(updates.recovery_report(cases, cases.where("k % 5 > 0").select("dataset", "qid", "output")))


@query(f"{DAYS} SELECT count(*) AS cases, round(100.0 * avg((k % 3 < 2)::INT), 6) AS parse_rate, round(100.0 * avg((k % 3 = 0)::INT), 6) AS answer_em, round(100.0 * avg(CASE k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN near ELSE 0.0 END), 6) AS answer_f1 FROM cases")
def recovery_answers(spark, sf_dir):
    """By key modulo 3: the new answer, the old one, no tags."""
    cases = day_cases(spark, sf_dir)
    output = F.when(F.col("k") % 3 == 0, F.concat(F.lit("<ANSWER>"), "new_value", F.lit("</ANSWER>"))).when(F.col("k") % 3 == 1, F.concat(F.lit("<ANSWER> "), "old_answer", F.lit("</ANSWER>"))).otherwise(F.col("new_value"))
    cases = shared.written(cases.select("dataset", "qid", "new_answers", output.alias("output")), "cases")
    return _rates(updates.recovery_answers(cases, cases.select("dataset", "qid", "output")))


@query("SELECT event_type, count(value) AS n, list_sort(list(value))[CAST(floor(0.5 * (count(*) - 1)) AS INTEGER) + 1] AS p50, list_sort(list(value))[CAST(floor(0.95 * (count(*) - 1)) AS INTEGER) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def floor_percentiles(spark, sf_dir):
    return metrics.floor_percentiles(table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95}, "event_type")


@query(f"{OUT} SELECT qid, CASE WHEN kind = 'equal' AND k % 24 = 4 THEN 'literal' WHEN kind IN ('equal','bool') THEN 'bool' ELSE 'copy' END AS op, NOT (kind = 'equal' AND k % 24 = 4) AS valid FROM g")
def gold_compile(spark, sf_dir):
    from strandset.operators.compiler import compile_labels

    rows = orders.contexts(spark, sf_dir).withColumns(
        {"question_type": F.lit("bridge"), "decomposition": F.array().cast("array<struct<step_id:int,question:string,answer:string,support_doc:int>>"), "evidences": F.array().cast("array<array<string>>")}
    )
    support = F.when(F.col("kind") == "composition", F.array_append("support", F.struct(F.lit(2).alias("doc"), F.lit(0).alias("sent")))).otherwise(F.col("support"))
    return execute(compile_labels(rows.withColumn("support", support))).select("qid", F.col("program.answer.op").alias("op"), "result.valid")


WORDS, LANDS = list(DEMONYMS), list(DEMONYMS.values())


@query(f"SELECT o_orderkey, CAST({LANDS} AS VARCHAR[])[CAST(o_orderkey % {len(WORDS)} AS INTEGER) + 1] AS country, lower(replace(n_name, '_', '')) AS plain FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def canonical_scalar(spark, sf_dir):
    said = F.get(F.array(*map(F.lit, WORDS)), (F.col("k") % len(WORDS)).cast("int"))
    rows = orders.facts(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey"), "k")
    names = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    rows = rows.join(names, F.col("o_custkey") == F.col("c_custkey")).withColumns({"a": t.normalize(F.concat(F.lit("The "), F.initcap(said), F.lit("!"))), "b": t.normalize("n_name")})
    return rows.select(F.col("k").alias("o_orderkey"), t.canonical(F.col("a")).alias("country"), t.canonical(F.col("b")).alias("plain"))


CUES = [*MAXIMUM_CUES, *MINIMUM_CUES, "nothing"]


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % {len(CUES)} < {len(MAXIMUM_CUES)} THEN 'argmax' WHEN o_orderkey % {len(CUES)} < {len(CUES) - 1} THEN 'argmin' END AS reducer FROM orders")
def reducer(spark, sf_dir):
    cue = F.get(F.array(*map(F.lit, CUES)), (F.col("o_orderkey") % len(CUES)).cast("int"))
    asked = F.concat(F.lit("Which of both is "), F.upper(cue), F.lit("?"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.reducer_from_question(asked).alias("reducer"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(round(o_totalprice) AS BIGINT) + 17 AS VARCHAR) WHEN 1 THEN CAST(o_totalprice + 17 AS VARCHAR) WHEN 2 THEN CASE WHEN o_orderkey % 8 = 2 THEN 'no' ELSE 'yes' END
ELSE '§' || substr(sha256(o_orderpriority), 1, 10) || '§' END AS replaced FROM orders""")
def disjoint_replacements(spark, sf_dir):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    quote = F.when(k % 4 == 0, F.format_number(F.round(price), 0)).when(k % 4 == 1, price.cast("string")).when(k % 8 == 2, " Yes").when(k % 4 == 2, "NO").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.disjoint_replacement(quote).alias("replaced"))


def documents_sql(s, at):
    """The lines of three documents of a context."""
    return f"""'[D{at}:TITLE] ' || title{s} || chr(10) || '[D{at}:S0] ' || title{s} || ' was placed by ' || customer{s} || '.' || chr(10) || '[D{at}:S1] It was ordered on ' || day{s} || '.' || chr(10) || '[D{at}:S2] Its status is ' || status{s} || '.' || chr(10)
|| '[D{at + 1}:TITLE] ' || customer{s} || chr(10) || '[D{at + 1}:S0] ' || customer{s} || ' is based in ' || nation{s} || '.' || chr(10) || '[D{at + 2}:TITLE] ' || nation{s} || chr(10) || '[D{at + 2}:S0] ' || nation{s} || ' belongs to ' || region{s} || '.'"""


@query(f"""WITH {SQL} SELECT qid, sha256('Question: Which nation is the customer of ' || title || ' based in?' || chr(10) || 'Documents:' || chr(10) || {documents_sql('', 0)} || coalesce(chr(10) || {documents_sql('2', 3)}, '') || chr(10) || '{TASKS["program"]}') AS text_sha256 FROM g""")
def context_rendering(spark, sf_dir):
    return orders.contexts(spark, sf_dir).select("qid", t.text_digest(context_text()).alias("text_sha256"))


@query("SELECT label, count(*) AS n, round(1 / sqrt(count(*)), 6) AS weight FROM embeddings GROUP BY 1")
def root_weights(spark, sf_dir):
    return sampling.root_weights(table(spark, sf_dir, "embeddings"), "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.first("weight"), 6).alias("weight"))


@query("SELECT conv_id, turn, (length(text) - length(replace(text, 'de', ''))) // 2 AS n FROM conversations")
def occurrence_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", t.occurrences(F.array("text"), F.lit("de")).cast("long").alias("n"))


@query(f"{OUT} SELECT {OPS} AS kind, 'relevant' AS changed, CASE WHEN certified THEN 'replay' ELSE 'recompile' END AS action, count(*) AS n FROM r WHERE valid GROUP BY ALL UNION ALL SELECT {OPS}, 'irrelevant', 'reuse', count(*) FROM r WHERE valid GROUP BY ALL")
def one_cell_updates(spark, sf_dir):
    done = lineage.refresh(updates.one_cell_updates(bound(spark, sf_dir)))
    return done.groupBy(F.col("program.answer.op").alias("op"), F.col("kind").alias("changed"), "action").agg(F.count("*").alias("n")).withColumnRenamed("op", "kind")
