"""Registered queries of reports, protocols, revision streams and histories, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandset.functions import text as t
from strandset.operators import lineage, provenance, reports, revisions, selection, significance, static, updates
from strandset.operators.vm import execute
from strandset.plans import orders
from strandset.plans.orders import SQL, outcome_sql, table
from strandset.plans.queries import CAND, CELLS, ERRORS, EV, OUT, SCORED, TRUTH, bound, candidates, query
from strandset.sources import shared

RATES = ("parse_rate", "valid_rate", "certified_rate", "candidate_rate", "answer_em", "answer_f1", "strict_em", "strict_f1", "valid_em", "valid_f1", "certified_em", "certified_f1", "evidence_em", "evidence_precision", "evidence_recall", "evidence_f1", "joint_em", "joint_f1")

#: Outcomes of stored predictions: a tenth is missing, of which a seventh has an older line that can't be read.
STORED = f"""WITH {SQL}, g2 AS (SELECT g.* REPLACE (CASE WHEN k % 10 = 9 THEN CASE WHEN k % 7 = 0 THEN 'unparsed' ELSE 'missing' END ELSE kind END AS kind), kind AS asked FROM g), r AS ({outcome_sql('kind', 'g2')}),
{ERRORS.replace("CASE kind WHEN 'unparsed'", "CASE kind WHEN 'missing' THEN ['missing_prediction'] WHEN 'unparsed'")}, s AS (SELECT *, {TRUTH.replace('kind', 'asked')} AS truth, CASE WHEN sound AND found = {TRUTH.replace('kind', 'asked')} THEN 1.0 ELSE 0.0 END AS em FROM e),
{EV.replace("CASE kind WHEN 'unparsed' THEN 0.0", "CASE kind WHEN 'missing' THEN 0.0 WHEN 'unparsed' THEN 0.0").replace("kind IN ('unparsed',", "kind IN ('missing','unparsed',")}"""


def _hundred(x, over="count(*)"):
    return f"round(100.0 * sum({x}) / greatest({over}, 1), 6)"


@query(
    f"""{STORED}, h AS (SELECT error, count(*) AS n FROM (SELECT unnest(CASE WHEN valid AND em = 0 THEN ['valid_wrong_answer'] ELSE errors END) AS error FROM s) GROUP BY 1)
SELECT 'orders' AS dataset, 'default' AS dataset_variant, 'sentence' AS granularity, count(*) AS examples, CAST(sum((k % 10 <> 9)::INT + (k % 7 = 0)::INT) AS BIGINT) AS predictions, count(*) AS evidence_examples,
{_hundred("(kind NOT IN ('unparsed','missing'))::INT")} AS parse_rate, {_hundred('valid::INT')} AS valid_rate, {_hundred('certified::INT')} AS certified_rate, {_hundred('sound::INT')} AS candidate_rate, {_hundred('em')} AS answer_em, {_hundred('em')} AS answer_f1,
{_hundred('em * valid::INT')} AS strict_em, {_hundred('em * valid::INT')} AS strict_f1, {_hundred('em * valid::INT', 'sum(valid::INT)')} AS valid_em, {_hundred('em * valid::INT', 'sum(valid::INT)')} AS valid_f1,
{_hundred('em * certified::INT', 'sum(certified::INT)')} AS certified_em, {_hundred('em * certified::INT', 'sum(certified::INT)')} AS certified_f1, {_hundred('ee')} AS evidence_em, {_hundred('p')} AS evidence_precision, {_hundred('rc')} AS evidence_recall, {_hundred('f')} AS evidence_f1,
{_hundred('em * ee')} AS joint_em, {_hundred('em * f')} AS joint_f1, (SELECT string_agg(error || '=' || n, '|' ORDER BY error) FROM h) AS errors FROM y"""
)
def evaluation_report(spark, sf_dir):
    rows = orders.contexts(spark, sf_dir)
    found = reports.evaluation(rows, orders.predictions(rows))
    errors = F.array_join(F.transform(F.array_sort(F.map_entries("errors")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|")
    return found.select("dataset", "dataset_variant", "granularity", "examples", F.col("predictions").cast("long").alias("predictions"), "evidence_examples", *[F.round(c, 6).alias(c) for c in RATES], errors.alias("errors"))


NORMAL = f"lower(replace(replace({TRUTH}, '_', ''), '#', ''))"
JUDGED = f"{CAND}, j AS (SELECT t.*, CASE WHEN tier > 0 AND answer = {NORMAL} THEN 1.0 ELSE 0.0 END AS em FROM t JOIN (SELECT qid, kind, nation, nation2, region FROM g) USING (qid))"


def judged(spark, sf_dir):
    """Candidates with parsed, em and f1 against the answers of their question."""
    rows = candidates(spark, sf_dir, {"parsed": ~F.col("parse_error")}, __a="answers")
    sound = F.col("tier") > 0
    em, f1 = t.exact_match(F.col("answer"), F.col("__a")), t.token_prf(F.col("answer"), F.col("__a"))["f1"]
    return rows.select("qid", "index", "parsed", "tier", "answer", F.when(sound, em).otherwise(0.0).alias("em"), F.when(sound, f1).otherwise(0.0).alias("f1"))


def analysed(spark, sf_dir):
    return reports.candidate_scores(judged(spark, sf_dir), F.col("index") == 0)


ANALYSED = f"""{JUDGED}, best AS (SELECT *, max(tier) OVER (PARTITION BY qid) AS top FROM j), v AS (SELECT qid, answer, count(*) AS n, max(tier) AS tier, min(idx) AS idx, max(em) AS em FROM j WHERE tier > 0 GROUP BY 1, 2),
w AS (SELECT qid, answer, count(*) AS n, max(tier) AS tier, min(idx) AS idx, max(em) AS em FROM best WHERE tier > 0 AND tier = top GROUP BY 1, 2),
cv AS (SELECT qid, em FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, tier DESC, idx, answer DESC) AS o FROM v) WHERE o = 1), cw AS (SELECT qid, em FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, tier DESC, idx, answer DESC) AS o FROM w) WHERE o = 1),
scores AS (SELECT j.qid, count(*) AS candidates, CAST(sum((own <> 'unparsed')::INT) AS BIGINT) AS parsed, CAST(sum((j.tier > 0)::INT) AS BIGINT) AS sound, max(CASE WHEN idx = 0 THEN j.em ELSE 0.0 END) AS selected, max(j.em) AS oracle, max(CASE WHEN j.tier = 2 THEN j.em ELSE 0.0 END) AS strict,
  coalesce(max(cv.em), 0.0) AS consensus, coalesce(max(cw.em), 0.0) AS tier_consensus FROM j LEFT JOIN cv USING (qid) LEFT JOIN cw USING (qid) GROUP BY 1)"""
PARTS = ("selected", "oracle", "strict", "consensus", "tier_consensus")


@query(f"{ANALYSED} SELECT qid, candidates, parsed, sound, {', '.join(f'{p} AS {p}_em' for p in PARTS)} FROM scores")
def candidate_scores(spark, sf_dir):
    return analysed(spark, sf_dir).select("qid", "candidates", "parsed", "sound", *[f"{p}_em" for p in PARTS])


@query(
    f"""{ANALYSED} SELECT count(*) AS examples, CAST(sum(candidates) AS BIGINT) AS candidates, {_hundred('parsed', 'sum(candidates)')} AS parse_rate, {_hundred('sound', 'sum(candidates)')} AS sound_rate, {_hundred('(sound > 0)::INT')} AS answered,
{', '.join(f'{_hundred(p)} AS {p}_{m}' for p in PARTS for m in ('em', 'f1'))} FROM scores"""
)
def candidate_report(spark, sf_dir):
    found = reports.candidate_report(analysed(spark, sf_dir))
    return found.select("examples", "candidates", *[F.round(c, 6).alias(c) for c in found.columns if c not in ("examples", "candidates")])


#: Every fourth answer has no tags, every fifth citation is no JSON, every next one cites a sentence that isn't there.
PROTOCOLS = f"""WITH {SQL}, p AS (SELECT *, CASE WHEN nation = {TRUTH} THEN 1.0 ELSE 0.0 END AS em FROM g)
SELECT 'answer' AS task, count(*) AS examples, {_hundred('(k % 4 <> 3)::INT')} AS parse_rate, {_hundred('em * (k % 4 <> 3)::INT')} AS answer_em, {_hundred('em * (k % 4 <> 3)::INT')} AS answer_f1, NULL::DOUBLE AS valid_citation_rate, NULL::DOUBLE AS evidence_f1 FROM p
UNION ALL SELECT 'citation', count(*), {_hundred('(k % 5 <> 0)::INT')}, {_hundred('em * (k % 5 <> 0)::INT')}, {_hundred('em * (k % 5 <> 0)::INT')}, {_hundred('(k % 5 > 1)::INT')}, {_hundred('CASE k % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END')} FROM p"""


def said(task):
    """Stored outputs of a protocol."""
    k = F.col("k")
    if task == "answer":
        return F.when(k % 4 == 3, F.col("nation")).otherwise(F.concat(F.lit("So: <ANSWER>\n "), "nation", F.lit(" </ANSWER>")))
    cited = F.when(k % 5 == 1, "[[0,0],[9,9]]").otherwise("[[0,0],[1,0]]")
    return F.when(k % 5 == 0, "<CITATION>{</CITATION>").otherwise(F.concat(F.lit('<CITATION>{"answer":"'), "nation", F.lit('","evidence":'), cited, F.lit("}</CITATION>")))


@query(PROTOCOLS)
def output_baselines(spark, sf_dir):
    rows = orders.contexts(spark, sf_dir)
    out = None
    for task in ("answer", "citation"):
        one = reports.output_baseline(rows.withColumn("output", said(task)), task)
        one = one.select(F.lit(task).alias("task"), "examples", *[F.round(c, 6).alias(c) for c in one.columns if c != "examples"])
        out = one if out is None else out.unionByName(one)
    return out


BY_QUOTES = """CASE WHEN kind IN ('copy','no_anchor','disconnected','common') THEN nation WHEN kind IN ('composition','uncited') THEN region WHEN kind = 'bool' THEN 'Yes' WHEN kind = 'literal' THEN 'x' WHEN kind = 'equal' THEN CASE WHEN nation = nation2 THEN 'yes' ELSE 'no' END
WHEN title2 IS NULL THEN NULL WHEN kind = 'argmin' THEN CASE WHEN d2 < d THEN title2 ELSE title END ELSE CASE WHEN d2 > d THEN title2 ELSE title END END"""
REFS = "CASE WHEN kind IN ('argmin','argmax') THEN '[[0,1],[3,1]]' WHEN kind IN ('equal','common') THEN '[[1,0],[4,0]]' WHEN kind IN ('composition','no_anchor','disconnected') THEN '[[0,0],[1,0],[2,0]]' ELSE '[[0,0],[1,0]]' END"


@query(f"""WITH {SQL}, q AS (SELECT *, {BY_QUOTES} AS said FROM g WHERE kind <> 'unparsed') SELECT qid, said, '<ANSWER>' || said || '</ANSWER>' AS answer, '<CITATION>{{"answer":"' || said || '","evidence":' || {REFS} || '}}</CITATION>' AS citation FROM q""")
def static_answers(spark, sf_dir):
    rows = static.static_answers(orders.programs(spark, sf_dir).where("program is not null"), "said")
    return static.rewritten(static.rewritten(rows, "answer", "reply"), "citation").select("qid", "said", F.col("reply").alias("answer"), F.col("target").alias("citation"))


LINES = {
    "e00": "'[' || title || '] ' || title || ' was placed by ' || customer || '.'", "e01": "'[' || title || '] It was ordered on ' || day || '.'", "e10": "'[' || customer || '] ' || customer || ' is based in ' || nation || '.'",
    "e20": "'[' || nation || '] ' || nation || ' belongs to ' || region || '.'", "e31": "'[' || title2 || '] It was ordered on ' || day2 || '.'", "e40": "'[' || customer2 || '] ' || customer2 || ' is based in ' || nation2 || '.'",
}


def _lines(*names):
    return " || chr(10) || ".join(f"({LINES[n]})" for n in names)


@query(
    f"""{CAND}, c AS (SELECT r.*, tier, answer FROM r JOIN (SELECT qid, idx, tier, answer FROM t) USING (qid, idx) WHERE tier > 0), n AS (SELECT *, count(*) OVER (PARTITION BY qid, answer) AS agree FROM c)
SELECT qid, CAST(idx AS INTEGER) AS index, sha256('Candidate answer: ' || candidate || chr(10) || 'Program status: ' || CASE WHEN tier = 2 THEN 'executable' ELSE 'answer-only' END || chr(10) || 'Answer agreement: ' || agree || ' of 4' || chr(10) || 'Cited evidence:' || chr(10) ||
CASE WHEN own IN ('argmin','argmax') THEN {_lines('e01', 'e31')} WHEN own IN ('equal','common') THEN {_lines('e10', 'e40')} WHEN own IN ('composition','no_anchor','disconnected') THEN {_lines('e00', 'e10', 'e20')} ELSE {_lines('e00', 'e10')} END) AS passage_sha256 FROM n"""
)
def ranker_passages(spark, sf_dir):
    rows = candidates(spark, sf_dir, cited=selection.cited_lines()).withColumn("n_candidates", F.lit(4))
    return selection.passages(rows).select("qid", "index", t.text_digest(F.col("passage")).alias("passage_sha256"))


@query(
    f"""{OUT}, {CELLS}, n AS (SELECT count(*) AS every, count(*) FILTER (field <> 'question') AS deps FROM c)
SELECT count(*) AS examples, CAST(sum(valid::INT) AS BIGINT) AS valid, CAST(sum(certified::INT) AS BIGINT) AS certified, CAST(sum(CASE WHEN valid THEN CASE WHEN title2 IS NULL THEN 8 ELSE 16 END END) AS BIGINT) AS corpus_cells, (SELECT deps FROM n) AS dependency_cells,
round((SELECT every FROM n) / sum(valid::INT), 6) AS mean_cells, CAST(sum(valid::INT) AS BIGINT) AS relevant, CAST(sum(valid::INT) AS BIGINT) AS relevant_detected, CAST(sum(certified::INT) AS BIGINT) AS relevant_replayed, CAST(sum((valid AND NOT certified)::INT) AS BIGINT) AS relevant_recompiled,
CAST(sum(valid::INT) AS BIGINT) AS irrelevant, CAST(sum(valid::INT) AS BIGINT) AS irrelevant_reused, round(100.0 * (SELECT deps FROM n) / sum(CASE WHEN valid THEN CASE WHEN title2 IS NULL THEN 8 ELSE 16 END END), 6) AS expected_recompute FROM r"""
)
def update_summary(spark, sf_dir):
    found = updates.update_summary(bound(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_cells", "expected_recompute")})


@query(f"WITH {SQL} SELECT qid FROM g WHERE kind = 'unparsed'")
def parse_errors(spark, sf_dir):
    return orders.programs(spark, sf_dir).where("parse_error").select("qid")


#: Cells that a valid program can't lose: quoted ones, and titles that joins or labels need.
KEPT = """CASE WHEN kind = 'bool' THEN 'title:0:-1 sentence:0:0 title:1:-1' WHEN kind = 'copy' THEN 'title:0:-1 sentence:0:0 title:1:-1 sentence:1:0' WHEN kind = 'composition' THEN 'title:0:-1 sentence:0:0 title:1:-1 sentence:1:0 title:2:-1 sentence:2:0'
WHEN kind IN ('equal','common') THEN 'sentence:1:0 sentence:4:0' ELSE 'title:0:-1 sentence:0:1 title:3:-1 sentence:3:1' END"""


@query(f"{OUT} SELECT qid, {KEPT} AS kept, CASE WHEN title2 IS NULL THEN 9 ELSE 17 END AS executions FROM r WHERE valid")
def deletion_provenance(spark, sf_dir):
    done = provenance.deletion_provenance(bound(spark, sf_dir))
    return done.select("qid", F.array_join(F.transform("kept", lambda c: F.concat_ws(":", c["field"], c["doc"], c["sent"])), " ").alias("kept"), "executions")


#: The same lines of two triples of documents, as cells.
CONTEXT_CELLS = " UNION ALL ".join(
    f"SELECT id, '{field}' AS field, {doc + at} AS doc, {sent} AS sent, {text.replace('@', s)} AS text FROM p{' WHERE title2 IS NOT NULL' if at else ''}"
    for s, at in (("", 0), ("2", 3))
    for field, doc, sent, text in (
        ("title", 0, -1, "title@"), ("sentence", 0, 0, "title@ || ' was placed by ' || customer@ || '.'"), ("sentence", 0, 1, "'It was ordered on ' || day@ || '.'"), ("sentence", 0, 2, "'Its status is ' || status@ || '.'"),
        ("title", 1, -1, "customer@"), ("sentence", 1, 0, "customer@ || ' is based in ' || nation@ || '.'"), ("title", 2, -1, "nation@"), ("sentence", 2, 0, "nation@ || ' belongs to ' || region@ || '.'"),
    )
)
DAY_CELLS = " UNION ALL ".join(
    f"SELECT id, '{field}', {doc}, {sent} FROM p WHERE kind = 'day'" for field, doc, sent in (("question", -1, -1), ("sentence", 0, 0), ("sentence", 0, 1), ("title", 0, -1))
)


@query(
    f"""{OUT}, {CELLS}, p AS (SELECT qid || ':' || kind AS id, * FROM (SELECT * FROM r WHERE certified) UNION ALL SELECT qid || ':day', * REPLACE ('day' AS kind) FROM r),
ac AS ({CONTEXT_CELLS}), dep AS (SELECT id, field, doc, sent FROM c JOIN (SELECT qid, kind, id FROM p) USING (qid, kind) UNION ALL {DAY_CELLS}),
kept AS (SELECT id, split_part(x, ':', 1) AS field, CAST(split_part(x, ':', 2) AS INTEGER) AS doc, CAST(split_part(x, ':', 3) AS INTEGER) AS sent FROM (SELECT id, unnest(string_split(CASE WHEN kind = 'day' THEN 'title:0:-1 sentence:0:1' ELSE {KEPT} END, ' ')) AS x FROM p)),
cited AS (SELECT DISTINCT id, doc FROM dep WHERE field = 'sentence'),
sizes AS (SELECT id, count(*) AS n, sum(length('{{"field":"","doc":,"sent":,"sha256":""}},') + 64 + length(field) + length(CAST(doc AS VARCHAR)) + length(CAST(sent AS VARCHAR))) - 1 AS bytes FROM dep GROUP BY 1),
kept_sizes AS (SELECT id, count(*) AS n, 2 - 1 + sum(length('[["",,],""],') + length(field) + length(CAST(doc AS VARCHAR)) + length(CAST(sent AS VARCHAR)) + length(text)) AS bytes FROM kept JOIN ac USING (id, field, doc, sent) GROUP BY 1),
runs AS (SELECT id, count(*) + 1 AS n FROM ac GROUP BY 1),
rel AS (SELECT id, min((field, doc, sent)) AS x FROM dep WHERE field <> 'question' GROUP BY 1), irr AS (SELECT id, min((field, doc, sent)) AS x FROM ac JOIN cited USING (id, doc) ANTI JOIN dep USING (id, field, doc, sent) GROUP BY 1),
m AS (SELECT p.id, p.qid, sizes.n AS cells, sizes.bytes + length('{{"dataset":"orders","qid":"","vm_semantics_version":"strandset-vm-1","program_sha256":"","answer_sha256":"","structure_sha256":"","lineage_certified":true,"cells":[]}}') + 192 + length(p.qid) AS bytes,
  kept_sizes.n AS kept_cells, kept_sizes.bytes AS kept_bytes, runs.n AS runs, rel.x AS relevant, irr.x AS irrelevant,
  (p.id, relevant) IN (SELECT (id, (field, doc, sent)) FROM dep) AS rel_read, (p.id, relevant) IN (SELECT (id, (field, doc, sent)) FROM kept) AS rel_kept, (p.id, relevant[2]) IN (SELECT (id, doc) FROM cited) AS rel_cited,
  (p.id, irrelevant) IN (SELECT (id, (field, doc, sent)) FROM dep) AS irr_read, (p.id, irrelevant) IN (SELECT (id, (field, doc, sent)) FROM kept) AS irr_kept, (p.id, irrelevant[2]) IN (SELECT (id, doc) FROM cited) AS irr_cited
  FROM p JOIN sizes USING (id) JOIN kept_sizes USING (id) JOIN runs USING (id) LEFT JOIN rel USING (id) LEFT JOIN irr USING (id))
SELECT (SELECT 2 * count(*) FROM r) AS examples, (SELECT count(*) + count(*) FILTER (valid) FROM r) AS valid_programs, count(*) AS certified_programs, round(avg(cells), 6) AS mean_cells, round(avg(bytes), 6) AS mean_bytes, round(avg(kept_cells), 6) AS kept_mean_cells,
round(avg(kept_bytes), 6) AS kept_mean_bytes, round(avg(runs), 6) AS executions_per_program, count(relevant) AS relevant_mutations, count(irrelevant) AS irrelevant_mutations,
{', '.join(f"round(100.0 * count(*) FILTER (relevant IS NOT NULL AND NOT rel_{c}) / greatest(count(relevant), 1), 6) AS {w}_unsafe_rate, round(100.0 * count(*) FILTER (irrelevant IS NOT NULL AND irr_{c}) / greatest(count(irrelevant), 1), 6) AS {w}_false_invalidation_rate" for w, c in (('cells', 'read'), ('kept', 'kept'), ('versions', 'cited')))} FROM m"""
)
def provenance_comparison(spark, sf_dir):
    """Every order with its own program and with one that cites a sentence it doesn't need."""
    found = provenance.comparison(lineage.bind(execute(orders.programs_and(spark, sf_dir, "day"))))
    return found.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes])


def event_pages(spark, sf_dir):
    """(pages, moves, profiles): each user's events as revisions of a page; every fifth page was redirected, every next one's title normalised."""
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    kind = F.col("user_id") % 5
    title = F.when(kind == 0, F.concat(F.lit("Account "), F.col("user_id").cast("string"))).when(kind == 1, F.concat(F.lit("User "), F.col("user_id").cast("string"))).otherwise(name)
    lines = F.concat_ws(
        "\n", F.concat(F.lit("The kind of  the event is "), "event_type"), F.concat(F.lit("The number of the user is "), F.col("user_id").cast("string")), F.lit("short"), F.lit("{{a template that is no cell}}"),
        F.concat(F.lit("The event came on the day "), F.date_format("ts", "yyyy-MM-dd")),
    )
    pages = e.select(F.col("user_id").alias("response"), title.alias("title"), F.lit(False).alias("missing"), F.col("event_id").alias("revid"), F.col("ts").alias("timestamp"), t.text_digest(lines).alias("sha1"), lines.alias("content"))
    users = e.select("user_id").distinct()
    moves = users.where("user_id % 5 < 2").select(F.col("user_id").alias("response"), name.alias("from"), title.alias("to"), (kind == 0).alias("redirect"))
    profiles = users.select(F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("dataset"), name.alias("title"), F.lit(2).alias("dependency_cells"))
    return pages, moves, profiles


STREAM = """
p AS (SELECT *, CASE user_id % 5 WHEN 0 THEN 'Account ' || user_id WHEN 1 THEN 'User ' || user_id ELSE 'user ' || user_id END AS title, ['The kind of the event is ' || event_type, 'The number of the user is ' || user_id, 'The event came on the day ' || strftime(ts, '%Y-%m-%d')] AS cells FROM events),
q AS (SELECT *, lead(cells) OVER w AS next_cells, lead(event_id) OVER w AS next_revid, lead(ts) OVER w AS next_ts FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT *, list_transform(list_sort(list_transform(cells, lambda c: sha256(title || ':' || event_id || ':' || c) || c))[1:2], lambda c: substr(c, 65)) AS chosen FROM q WHERE next_cells IS NOT NULL),
ev AS (SELECT user_id, title, event_id AS revid, next_revid, ts, next_ts, len(chosen) AS selected, len(list_filter(chosen, lambda c: NOT list_contains(next_cells, c))) AS lost, cells <> next_cells AS page_changed FROM x)"""


@query(f"WITH {STREAM} SELECT title, 'user ' || user_id AS requested, revid, next_revid, selected, lost, page_changed FROM ev")
def revision_stream(spark, sf_dir):
    return revisions.stream_events(revisions.resolved_pages(*event_pages(spark, sf_dir))).select("title", "requested", "revid", "next_revid", "selected", "lost", "page_changed")


@query(
    f"""WITH {STREAM} SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, count(*) AS events, CAST(sum(page_changed::INT) AS BIGINT) AS changed_events, CAST(sum(selected) AS BIGINT) AS selected_cells, CAST(sum(lost) AS BIGINT) AS changed_cells,
CAST(sum((lost > 0)::INT) AS BIGINT) AS recomputations, {_hundred('(lost > 0)::INT')} AS recompute_rate, {_hundred('page_changed::INT')} AS document_recompute_rate, min(ts) AS earliest, max(next_ts) AS latest FROM ev GROUP BY 1"""
)
def revision_stream_report(spark, sf_dir):
    found = revisions.stream_report(revisions.stream_events(revisions.resolved_pages(*event_pages(spark, sf_dir))), "dataset")
    return found.withColumns({c: F.round(c, 6) for c in ("recompute_rate", "document_recompute_rate")})


def asked_pages(spark, sf_dir):
    """(pages, profiles): pages of users and suppliers, found for profiles of users, suppliers and nations. Every seventh user's page is missing, a supplier's
    has one revision, and of nations there is no page."""
    pages, moves, profiles = event_pages(spark, sf_dir)
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    line = F.concat(F.lit("The supplier is "), "s_name", F.lit(" and no other"))
    own = s.select((-F.col("s_suppkey")).cast("long").alias("response"), F.col("s_name").alias("title"), F.lit(False).alias("missing"), F.col("s_suppkey").cast("long").alias("revid"), F.lit("2020-01-01").cast("timestamp").cast(pages.schema["timestamp"].dataType).alias("timestamp"), t.text_digest(line).alias("sha1"), line.alias("content"))
    pages = pages.withColumns({"missing": F.col("response") % 7 == 3, "response": F.col("response").cast("long"), "revid": F.col("revid").cast("long")}).unionByName(own)
    for dataset, title in (("supplier", s.select("s_name")), ("nation", n.select("n_name"))):
        profiles = profiles.unionByName(title.toDF("title").select(F.lit(dataset).alias("dataset"), "title", F.lit(2).alias("dependency_cells")))
    return revisions.resolved_pages(pages, moves, profiles), profiles


ASKED = f"""{STREAM}, shown AS (SELECT * FROM ev WHERE user_id % 7 <> 3),
pages AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, 'user ' || user_id AS requested, any_value(title) AS title, count(DISTINCT event_id) AS revisions, user_id FROM p WHERE user_id % 7 <> 3 GROUP BY user_id
UNION ALL SELECT 'supplier', s_name, s_name, 1, NULL FROM supplier),
lost AS (SELECT 'user ' || user_id AS title FROM events WHERE user_id % 7 = 3 UNION SELECT n_name FROM nation)"""


@query(
    f"""WITH {ASKED}, told AS (SELECT user_id, count(*) AS events, CAST(sum((lost > 0)::INT) AS BIGINT) AS recomputations FROM shown GROUP BY 1)
SELECT dataset, requested, title, 2 AS dependency_cells, revisions, coalesce(events, 0) AS events, coalesce(recomputations, 0) AS recomputations FROM pages LEFT JOIN told USING (user_id)"""
)
def revision_pages(spark, sf_dir):
    pages, _ = asked_pages(spark, sf_dir)
    return revisions.page_summaries(pages, revisions.stream_events(pages))


@query(f"WITH {ASKED} SELECT title FROM lost")
def revision_unresolved(spark, sf_dir):
    pages, profiles = asked_pages(spark, sf_dir)
    return revisions.unresolved(profiles, pages)


@query(
    f"""WITH {ASKED} SELECT (SELECT count(*) FROM pages) + (SELECT count(*) FROM lost) AS requested_titles, (SELECT count(*) FROM pages) AS resolved_pages, (SELECT count(*) FROM pages WHERE revisions > 1) AS pages_with_two_revisions,
(SELECT count(*) FROM lost) AS unresolved_titles, 0 AS fetch_errors, count(*) AS events, CAST(sum(page_changed::INT) AS BIGINT) AS changed_events, CAST(sum(selected) AS BIGINT) AS selected_cells, CAST(sum(lost) AS BIGINT) AS changed_cells,
CAST(sum((lost > 0)::INT) AS BIGINT) AS recomputations, {_hundred('(lost > 0)::INT')} AS recompute_rate, {_hundred('page_changed::INT')} AS document_recompute_rate, round(100.0 - 100.0 * sum((lost > 0)::INT) / greatest(count(*), 1), 6) AS spared,
min(ts) AS earliest, max(next_ts) AS latest FROM shown"""
)
def revision_summary(spark, sf_dir):
    pages, profiles = asked_pages(spark, sf_dir)
    found = revisions.stream_summary(profiles, pages, revisions.stream_events(pages))
    return found.withColumns({c: F.round(c, 6) for c in ("recompute_rate", "document_recompute_rate", "spared")})


def customer_history(spark, sf_dir):
    """Two revisions of each customer's page, in wiki markup: a third moves, a third is worded anew, a third stays."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    nation = orders.padded(F.col("n_name"))
    old = F.concat(F.lit("'''"), "c_name", F.lit("''' is <b>based</b> in [[Land|"), nation, F.lit("]].<!-- ''note'' -->{{stub}} &amp; more"))
    new = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(" is based in NATION_99."))).when(F.col("c_custkey") % 3 == 1, old).otherwise(F.concat("c_name", F.lit(" has long been based, so they say, in "), nation, F.lit(".")))
    rows = c.withColumn("x", F.explode(F.array(*[F.struct(F.lit(i).alias("revid"), F.lit(at).alias("timestamp"), text.alias("content")) for i, at, text in ((1, "2020-01-01", old), (2, "2021-01-01", new))])))
    return rows.select(F.col("c_name").alias("title"), "x.revid", "x.timestamp", t.text_digest(F.col("x.content")).alias("sha1"), "x.content")


HISTORY = f"""{OUT}, d AS (SELECT qid, customer AS title FROM r WHERE certified AND kind IN ('copy','composition','equal','common') UNION ALL SELECT qid, customer2 FROM r WHERE certified AND kind IN ('equal','common')),
ev AS (SELECT qid, title, CAST(regexp_extract(title, '(\\d+)$', 1) AS BIGINT) % 3 AS part FROM d)"""


@query(f"{HISTORY} SELECT qid, title, part <> 1 AS page_changed, ['recompile','reuse','replay'][CAST(part AS INTEGER) + 1] AS action FROM ev")
def history_events(spark, sf_dir):
    linked = revisions.linked_documents(bound(spark, sf_dir))
    return revisions.history_events(linked, customer_history(spark, sf_dir)).select("qid", "title", "page_changed", "action")


@query(
    f"""{HISTORY} SELECT count(*) AS events, (SELECT count(*) FROM (SELECT DISTINCT qid, title FROM ev)) AS bound_documents, CAST(sum((part <> 1)::INT) AS BIGINT) AS changed_events, CAST(sum((part = 1)::INT) AS BIGINT) AS reuse, CAST(sum((part = 2)::INT) AS BIGINT) AS replay, CAST(sum((part = 0)::INT) AS BIGINT) AS recompile,
{_hundred('(part = 1)::INT')} AS reuse_rate, {_hundred('(part = 2)::INT')} AS replay_rate, {_hundred('(part = 0)::INT')} AS recompile_rate, {_hundred('(part = 2)::INT', 'sum((part <> 1)::INT)')} AS spared FROM ev"""
)
def history_report(spark, sf_dir):
    linked = revisions.linked_documents(bound(spark, sf_dir))
    found = revisions.history_report(revisions.history_events(linked, customer_history(spark, sf_dir)))
    return found.withColumns({c: F.round(c, 6) for c in ("reuse_rate", "replay_rate", "recompile_rate", "spared")})


@query(
    f"""{JUDGED}, b AS (SELECT qid, max(CASE WHEN idx = 0 THEN em END) AS a0, max(CASE WHEN idx = 1 THEN em END) AS a1, max(CASE WHEN idx = 0 AND tier = 2 THEN em ELSE 0.0 END) AS s0, max(CASE WHEN idx = 1 AND tier = 2 THEN em ELSE 0.0 END) AS s1 FROM j WHERE idx < 2 GROUP BY 1),
d AS (SELECT 'answer_f1' AS metric, a1 - a0 AS d FROM b UNION ALL SELECT 'strict_answer_f1', s1 - s0 FROM b)
SELECT metric, count(*) AS examples, round(100.0 * avg(d), 6) AS mean_difference, CAST(sum((d > 0)::INT) AS BIGINT) AS wins, CAST(sum((d < 0)::INT) AS BIGINT) AS losses, CAST(sum((d = 0)::INT) AS BIGINT) AS ties FROM d GROUP BY 1"""
)
def run_comparison(spark, sf_dir):
    """Programs of each order's own kind against those of the next kind; intervals are in ``paired_bootstrap``."""
    rows = orders.contexts(spark, sf_dir)
    other = orders.outputs(rows, F.get(F.array(*map(F.lit, orders.KINDS)), ((F.col("k") + 1) % 12).cast("int")))
    return significance.run_comparison(rows, orders.outputs(rows), other, intervals=False).withColumn("mean_difference", F.round("mean_difference", 6))


#: (base, its score, other, its score, whether examples are eligible): scores of stored outputs as in ``output_baselines``.
TASKS = (
    ("answer", "(k % 4 <> 3)::INT * said", "program-certified", "certified::INT * em", "certified"), ("citation", "(k % 5 <> 0)::INT * said", "program-strict", "valid::INT * em", "true"),
    ("program-answer", "em", "program-literal", "valid::INT * em", "true"),
)


@query(
    f"""{SCORED}, x AS (SELECT *, (nation = truth)::INT AS said FROM s), p AS ({' UNION ALL '.join(f"SELECT '{a}' AS baseline_task, '{b}' AS candidate_task, {x} AS a, {y} AS b, {e} AS eligible FROM x" for a, x, b, y, e in TASKS)}),
v AS (SELECT *, 'all' AS subset, true AS used FROM p UNION ALL SELECT *, 'candidate-eligible', eligible FROM p)
SELECT baseline_task, candidate_task, subset, count(*) AS total_examples, CAST(sum(eligible::INT) AS BIGINT) AS candidate_eligible_examples, {_hundred('eligible::INT')} AS candidate_eligibility_rate, CAST(sum(used::INT) AS BIGINT) AS compared_examples,
round(100.0 * avg(a) FILTER (used), 6) AS baseline_answer_f1, round(100.0 * avg(b) FILTER (used), 6) AS candidate_answer_f1, round(100.0 * avg(b - a) FILTER (used), 6) AS mean_difference,
count(*) FILTER (used AND b > a) AS wins, count(*) FILTER (used AND b < a) AS losses, count(*) FILTER (used AND b = a) AS ties FROM v GROUP BY 1, 2, 3"""
)
def task_comparison(spark, sf_dir):
    rows = orders.contexts(spark, sf_dir)
    runs = {task: (rows.withColumn("output", said(task)), (task,)) for task in ("answer", "citation")}
    runs["program"] = orders.outputs(rows), tuple(sorted({task for pair in TASKS for task in (pair[0], pair[2]) if task.startswith("program-")}))
    scores = shared.written(significance.run_scores(rows, runs), "scores")
    of = lambda task: significance.scored(task if task in runs else "program", task)
    out = None
    for base, _, other, _, _ in TASKS:
        pairs = significance.pairs(scores, of(base), of(other))
        for name, only in (("all", False), ("candidate-eligible", True)):
            one = significance.compared(pairs, only)
            rates = [F.round(c, 6).alias(c) for c in ("candidate_eligibility_rate", "baseline_answer_f1", "candidate_answer_f1", "mean_difference")]
            one = one.select(F.lit(base).alias("baseline_task"), F.lit(other).alias("candidate_task"), F.lit(name).alias("subset"), *rates, *[F.col(c).cast("long").alias(c) for c in ("total_examples", "candidate_eligible_examples", "compared_examples", "wins", "losses", "ties")])
            out = one if out is None else out.unionByName(one)
    return out
