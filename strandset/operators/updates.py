"""Changed contexts: update classes, attacks, provenance baselines and recovery cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandset.functions.text import disjoint_replacement, exact_match, mutate_number, normalize, normalize_all, occurrences, text_digest, token_prf
from strandset.operators.lineage import cell_text, document_digest, key, refresh, verify
from strandset.operators.program import parsed, wrapped_answer
from strandset.operators.vm import execute
from strandset.schema import DOCUMENTS, PROGRAM

#: Update classes and the action that each calls for.
CLASSES = {
    "unread_cell_update": "reuse", "value_preserving_rewrite": "replay", "answer_value_replacement": "recompile", "sentence_insertion": "recompile", "sentence_deletion": "recompile",
}


def with_cell(documents: Column, k: Column, text) -> Column:
    """``documents`` with the text of cell ``k`` put through ``text`` (a function of a column); a question cell changes nothing."""
    return F.transform(
        documents,
        lambda d: F.when(
            d["doc"] == k["doc"],
            F.struct(
                d["doc"].alias("doc"), F.when(k["field"] == "title", text(d["title"])).otherwise(d["title"]).alias("title"),
                F.transform(d["sentences"], lambda s, i: F.when((k["field"] == "sentence") & (i == k["sent"]), text(s)).otherwise(s)).alias("sentences"),
            ),
        ).otherwise(d),
    ).cast(DOCUMENTS)


def with_sentences(documents: Column, doc: Column, sentences) -> Column:
    """``documents`` with the sentences of one document put through ``sentences``."""
    return F.transform(
        documents, lambda d: F.when(d["doc"] == doc, F.struct(d["doc"].alias("doc"), d["title"].alias("title"), sentences(d["sentences"]).alias("sentences"))).otherwise(d)
    ).cast(DOCUMENTS)


def all_cells(documents: Column) -> Column:
    """Keys of titles and sentences, document by document."""
    return F.flatten(
        F.transform(documents, lambda d: F.concat(F.array(key("title", d["doc"], F.lit(-1))), F.transform(d["sentences"], lambda _, i: key("sentence", d["doc"], i))))
    )


def all_sentences(documents: Column) -> Column:
    """Keys of sentences, document by document."""
    return F.flatten(F.transform(documents, lambda d: F.transform(d["sentences"], lambda _, i: key("sentence", d["doc"], i))))


def dependencies(snapshot: Column) -> Column:
    cells = F.filter(snapshot["cells"], lambda c: c["field"] != "question")
    return F.transform(cells, lambda c: key(c["field"], c["doc"], c["sent"]))


def _signature(p: Column) -> Column:
    return F.struct(p["field"], p["doc"], p["sent"], p["quote"])


def value_pointer(program: Column, documents: Column) -> Column:
    """The first quoted pointer of the answer that reads a document, those that no join shares first."""
    a = program["answer"]
    shared = F.transform(program["joins"], lambda j: _signature(j["left"]))
    every = F.concat(F.filter(F.array(a["pointer"]), lambda p: p.isNotNull()), a["operands"])
    every = F.concat(F.filter(every, lambda p: ~F.array_contains(shared, _signature(p))), F.filter(every, lambda p: F.array_contains(shared, _signature(p))))
    holds = lambda p: (p["quote"] != "") & (p["field"] != "question") & F.coalesce(F.contains(cell_text(p, documents, F.lit("")), p["quote"]), F.lit(False))
    return F.get(F.filter(every, holds), F.lit(0))


def repaired(program: Column, target: Column, value: Column) -> Column:
    """``program`` with ``value`` as quote wherever a pointer is ``target``."""
    swap = lambda p: F.when(
        _signature(p) == _signature(target), F.struct(p["doc"].alias("doc"), p["sent"].alias("sent"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), p["field"].alias("field"), value.alias("quote"))
    ).otherwise(p)
    a = program["answer"]
    answer = F.struct(
        a["op"].alias("op"), F.when(a["pointer"].isNotNull(), swap(a["pointer"])).alias("pointer"), a["value"].alias("value"), F.transform(a["operands"], swap).alias("operands"),
        F.transform(a["labels"], swap).alias("labels"), a["value_type"].alias("value_type"),
    )
    joins = F.transform(program["joins"], lambda j: F.struct(swap(j["left"]).alias("left"), j["right_doc"].alias("right_doc"), j["right_field"].alias("right_field"), j["kind"].alias("kind")))
    return F.struct(program["version"].alias("version"), program["mode"].alias("mode"), program["evidence"].alias("evidence"), joins.alias("joins"), answer.alias("answer")).cast(PROGRAM)


def update_workload(bound: DataFrame) -> DataFrame:
    """Rows of certified results, once for each update class that applies: changed documents, class, expected action, and for
    a replaced value the repaired program. ``bound`` has result and snapshot."""
    program, documents, snapshot = F.col("program"), F.col("documents"), F.col("snapshot")
    read, evidence = F.col("__read"), F.col("__evidence")
    # what lambdas read are columns: within a lambda an expression is computed for each of its elements
    rows = bound.where("result.certified").withColumns({"__read": dependencies(snapshot), "__evidence": F.array_sort(program["evidence"]), "__pointer": value_pointer(program, documents)})
    places = {"__unread": F.get(F.array_except(all_sentences(documents), read), F.lit(0)), "__first": F.get(read, F.lit(0)), "__start": F.get(evidence, F.lit(0)), "__end": F.element_at(evidence, -1)}
    rows = rows.withColumns({**places, "__value": disjoint_replacement(F.col("__pointer.quote"))})
    p, value, unread, first, start, end = (F.col(c) for c in ("__pointer", "__value", "__unread", "__first", "__start", "__end"))
    none = F.lit(None).cast(PROGRAM)
    case = lambda name, applies, docs, fixed=none: F.when(applies, F.struct(F.lit(name).alias("class"), docs.alias("documents"), fixed.alias("repaired")))
    cases = F.array(
        case("unread_cell_update", unread.isNotNull(), with_cell(documents, unread, lambda t: F.concat(t, F.lit(" [unread cell updated]")))),
        case("value_preserving_rewrite", first.isNotNull(), with_cell(documents, first, lambda t: F.concat(t, F.lit(" [wording updated]")))),
        case("answer_value_replacement", p.isNotNull(), with_cell(documents, p, lambda t: F.replace(t, p["quote"], value)), repaired(program, p, value)),
        case("sentence_insertion", start.isNotNull(), with_sentences(documents, start["doc"], lambda s: F.array_append(s, F.lit("Newly inserted potentially relevant fact.")))),
        case("sentence_deletion", start.isNotNull(), with_sentences(documents, end["doc"], lambda s: F.filter(s, lambda _, i: i != end["sent"]))),
    )
    rows = rows.withColumn("__case", F.explode(F.filter(cases, lambda c: c.isNotNull())))
    expected = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    return rows.withColumns(
        {"documents": F.col("__case.documents"), "class": F.col("__case.class"), "expected": F.element_at(expected, F.col("__case.class")), "repaired": F.col("__case.repaired"), "cached_answer": F.col("result.answer")}
    ).drop("__case", "__read", "__evidence", "__pointer", "__value", *places)


def update_stress(bound: DataFrame) -> DataFrame:
    """One row for each update class: eligible, reuse, replay, recompile, hits, repair_valid, answer_changed."""
    done = refresh(update_workload(bound))
    fixed = execute(done.withColumns({"program": F.col("repaired"), "__old": F.col("result.answer")}), into="__fixed")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return fixed.groupBy("class").agg(
        F.count("*").alias("eligible"), *[n(F.col("action") == a).alias(a) for a in ("reuse", "replay", "recompile")], n(F.col("action") == F.col("expected")).alias("hits"),
        n(F.col("__fixed.certified")).alias("repair_valid"), n(F.col("__fixed.certified") & (F.col("__fixed.answer") != F.col("__old"))).alias("answer_changed"),
    )


def one_cell_updates(bound: DataFrame, suffix: str = " [updated]", contexts: bool = False) -> DataFrame:
    """Valid results with a suffix added to the first read cell (relevant) and to the first unread one, titles included. With ``contexts`` each row, valid
    or not, is there as itself too, without documents, program and snapshot, so that what counts contexts needs no execution of its own."""
    documents, read = F.col("documents"), F.col("__read")
    places = {"__relevant": F.array_min(read), "__irrelevant": F.array_min(F.array_except(all_cells(documents), read))}
    case = lambda name, k: F.when(k.isNotNull(), F.struct(F.lit(name).alias("kind"), with_cell(documents, k, lambda t: F.concat(t, F.lit(suffix))).alias("documents")))
    itself = F.struct(F.lit("context").alias("kind"), F.lit(None).cast(DOCUMENTS).alias("documents"))
    cases = F.array(case("relevant", F.col("__relevant")), case("irrelevant", F.col("__irrelevant")), *([itself] if contexts else []))
    rows = (bound if contexts else bound.where("result.valid")).withColumn("__read", dependencies(F.col("snapshot"))).withColumns(places)
    rows = rows.withColumn("__case", F.explode(F.filter(cases, lambda c: c.isNotNull())))
    rows = rows.withColumns({"documents": F.col("__case.documents"), "kind": F.col("__case.kind"), "cached_answer": F.col("result.answer")}).drop("__case", "__read", *places)
    changed = F.col("kind") != "context"
    return rows.withColumns({c: F.when(changed, F.col(c)) for c in ("program", "snapshot")}) if contexts else rows


def attacks(bound: DataFrame) -> DataFrame:
    """One row for each attack on valid results: attempts, lineage responses, execution responses, safe.

    A counterfactual counts as safe when the snapshot is stale; a disconnected program and a missing source when execution
    rejects them (and the snapshot is stale); poison in an unread sentence when neither snapshot nor answer change."""
    program, documents, snapshot = F.col("program"), F.col("documents"), F.col("snapshot")
    a = program["answer"]
    pointers = F.concat(F.filter(F.array(a["pointer"]), lambda p: p.isNotNull()), a["operands"], a["labels"])
    source = lambda p: cell_text(key(p["field"], p["doc"], p["sent"]), documents, F.col("question"))
    quoted = lambda p: (p["quote"] != "") & F.coalesce(F.contains(source(p), p["quote"]), F.lit(False))
    target = F.get(F.filter(pointers, lambda p: quoted(p) | ((p["start"] >= 0) & (p["end"] > p["start"]))), F.lit(0))
    read = F.transform(snapshot["cells"], lambda c: key(c["field"], c["doc"], c["sent"]))
    free = F.array_except(all_sentences(documents), read)
    claim = F.array_join(F.filter(F.concat(F.array(F.col("result.answer")), F.transform(program["joins"], lambda j: j["left"]["quote"])), lambda x: x != ""), " ")
    cut = F.array_max(F.filter(program["evidence"], lambda r: F.get(F.get(documents, r["doc"])["sentences"], r["sent"]).isNotNull()))
    # what lambdas read are columns: within a lambda an expression is computed for each of its elements
    rows = bound.where("result.valid").withColumns({"__target": target, "__free": free, "__claim": claim, "__cut": cut})
    rows = rows.withColumn("__last", F.element_at(F.when(F.size("__free") > 0, F.col("__free")), -1)).drop("__free")
    t, last, claim, cut = (F.col(c) for c in ("__target", "__last", "__claim", "__cut"))

    def struck(text):
        place = F.position(t["quote"], text)
        by_quote = F.concat(F.substr(text, F.lit(1), place - 1), F.lit("Counterfactual Entity 99173"), F.substr(text, place + F.length(t["quote"])))
        by_offset = F.concat(F.substr(text, F.lit(1), t["start"]), F.lit("99173"), F.substr(text, t["end"] + 1))
        return F.when((t["quote"] != "") & F.contains(text, t["quote"]), by_quote).otherwise(by_offset)

    docs = F.array_distinct(F.transform(program["evidence"], lambda r: r["doc"]))
    loose = program.withField("joins", F.filter(program["joins"], lambda _: F.lit(False)))
    case = lambda name, applies, d, q=F.col("question"), p=program: F.when(
        applies, F.struct(F.lit(name).alias("attack"), d.alias("documents"), q.alias("question"), p.cast(PROGRAM).alias("program"))
    )
    cases = F.array(
        case("counterfactual_entity_or_number", F.col("result.certified") & t.isNotNull(), with_cell(documents, t, struck), F.when(t["field"] == "question", struck(F.col("question"))).otherwise(F.col("question"))),
        case("disconnected_evidence", program["mode"].isin("bridge", "composition") & (F.size(docs) > 1), documents.cast(DOCUMENTS), F.col("question"), loose),
        case("distractor_poisoning", last.isNotNull(), with_cell(documents, last, lambda s: F.concat(s, F.lit(" Poisoned claim: "), claim, F.lit(".")))),
        case("missing_source", cut.isNotNull(), with_sentences(documents, cut["doc"], lambda s: F.slice(s, F.lit(1), cut["sent"]))),
    )
    rows = rows.withColumn("__case", F.explode(F.filter(cases, lambda c: c.isNotNull())))
    rows = rows.withColumns({c: F.col(f"__case.{c}") for c in ("documents", "question", "program", "attack")}).drop("__case", "__target", "__claim", "__cut", "__last")
    rows = execute(verify(rows, into="__check"), into="__now")
    poison, loose = F.col("attack") == "distractor_poisoning", F.col("attack") == "disconnected_evidence"
    rejected = ~F.col("__now.valid")
    by_run = F.when(poison, F.col("__now.valid") & (F.col("__now.answer") == F.col("result.answer"))).otherwise(rejected)
    by_lineage = F.when(poison, F.col("__check.current")).when(loose, rejected).otherwise(~F.col("__check.current"))
    n = lambda c: F.sum(c.cast("long"))
    out = rows.groupBy("attack").agg(F.count("*").alias("attempts"), n(by_lineage).alias("lineage"), n(by_run).alias("execution"))
    return out.withColumn("safe", F.when(F.col("attack") == "counterfactual_entity_or_number", F.col("lineage")).otherwise(F.least("lineage", "execution")))


def document_gate(bound: DataFrame, changed: DataFrame) -> DataFrame:
    """(dataset, qid, gate, lineage): whether a gate on digests of cited documents, and one on cells, lets a result stand in
    the changed context. ``changed`` has dataset, qid, question, documents."""
    new = changed.select("dataset", "qid", "question", "documents")
    cited = F.array_distinct(F.transform(dependencies(F.col("snapshot")), lambda k: k["doc"]))
    digested = F.transform(cited, lambda d: F.struct(d.alias("doc"), document_digest(F.get(F.col("documents"), d)).alias("sha256")))
    # documents are digested before rows move, so that only the changed ones do
    old = bound.where("result.certified").select("dataset", "qid", "snapshot", digested.alias("__cited"))
    same = F.forall("__cited", lambda c: c["sha256"].eqNullSafe(document_digest(F.get(F.col("documents"), c["doc"]))))
    rows = verify(old.join(new, ["dataset", "qid"]), into="__check")
    return rows.select("dataset", "qid", same.alias("gate"), F.col("__check.current").alias("lineage"))


def recovery_cases(bound: DataFrame) -> DataFrame:
    """Certified copies with a right answer whose value stands once in the context and can be edited as a number: changed_documents, the repaired program, new_result
    (where it is certified and answers something else), old_answer, and new_answers, the one right answer from now on. ``bound`` has answers."""
    documents, p = F.col("documents"), F.col("__pointer")
    rows = bound.where("result.certified and program.answer.op = 'copy'").withColumns({"__p": normalize(F.col("result.answer")), "__a": normalize_all("answers")})
    rows = rows.where(exact_match(F.col("__p"), F.col("__a")) == 1).drop("__p", "__a").withColumn("__pointer", value_pointer(F.col("program"), documents))
    rows = rows.where(p.isNotNull()).withColumn("new_value", mutate_number(p["quote"])).where("new_value is not null")
    cells = F.concat(F.array(F.col("question")), F.flatten(F.transform(documents, lambda d: F.concat(F.array(d["title"]), d["sentences"]))))
    rows = rows.where((occurrences(cells, p["quote"]) == 1) & (occurrences(cells, F.col("new_value")) == 0))
    rows = rows.withColumns({"repaired": repaired(F.col("program"), p, F.col("new_value")), "__old": documents, "__program": F.col("program"), "old_answer": F.col("result.answer")})
    rows = rows.withColumns({"documents": with_cell(documents, p, lambda t: F.replace(t, p["quote"], F.col("new_value")))})
    rows = execute(rows.withColumn("program", F.col("repaired")), into="new_result").where("new_result.certified and new_result.answer != old_answer")
    rows = rows.withColumns({"program": F.col("__program"), "changed_documents": F.col("documents"), "documents": F.col("__old"), "new_answers": F.array("new_result.answer")})
    return rows.drop("__old", "__program", "__pointer")


def first_cases(cases: DataFrame, most: int = 200) -> DataFrame:
    """The ``most`` cases of each dataset with the lowest digest of dataset:qid."""
    place = F.row_number().over(W.partitionBy("dataset").orderBy(text_digest(F.concat_ws(":", "dataset", "qid")), "qid"))
    return cases.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def update_summary(bound: DataFrame, suffix: str = " [updated]") -> DataFrame:
    """One row over all contexts: examples, valid, certified, corpus_cells and dependency_cells of valid results, mean_cells, the uniform-cell
    expected_recompute, and what one-cell updates of a read and of an unread cell came to. ``bound`` has results of all contexts."""
    valid = F.coalesce(F.col("result.valid"), F.lit(False))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    sizes = {"__cells": F.size(all_cells(F.col("documents"))), "__deps": F.size(dependencies(F.col("snapshot"))), "__all": F.size("snapshot.cells")}
    done = refresh(one_cell_updates(bound.withColumns(sizes), suffix, contexts=True))
    itself, relevant, irrelevant, act = F.col("kind") == "context", F.col("kind") == "relevant", F.col("kind") == "irrelevant", F.col("action")
    own = itself & valid
    both = done.agg(
        F.count(F.when(itself, 1)).alias("examples"), n(own).alias("valid"), n(own & F.col("result.certified")).alias("certified"), F.sum(F.when(own, F.col("__cells"))).alias("corpus_cells"), F.sum(F.when(own, F.col("__deps"))).alias("dependency_cells"),
        F.avg(F.when(own, F.col("__all"))).alias("mean_cells"),
        n(relevant).alias("relevant"), n(relevant & (act != "reuse")).alias("relevant_detected"), n(relevant & (act == "replay")).alias("relevant_replayed"), n(relevant & (act == "recompile")).alias("relevant_recompiled"),
        n(irrelevant).alias("irrelevant"), n(irrelevant & (act == "reuse")).alias("irrelevant_reused"),
    )
    return both.withColumn("expected_recompute", 100.0 * F.col("dependency_cells") / F.greatest("corpus_cells", F.lit(1)))


def _hundred(c: Column) -> Column:
    return 100.0 * F.coalesce(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), F.lit(0.0))


def _with_outputs(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Cases with the stored output of their question (null: none)."""
    stored = outputs.select("dataset", "qid", F.col("output").alias("__output"))
    return cases.drop("output").join(stored, ["dataset", "qid"], "left")


def recovery_report(cases: DataFrame, outputs: DataFrame, *by: str) -> DataFrame:
    """Recompilations after the change, one row (a group): cases, cached_em and cached_f1 of the old answers, old_plan_valid, and of the stored programs
    (dataset, qid, output): parse_rate, valid_rate, certified_rate, candidate_em, candidate_f1, strict_em, strict_f1, per hundred cases. A case without an output counts 0."""
    rows = execute(_with_outputs(cases, outputs).withColumn("documents", F.col("changed_documents")), into="__old_plan")
    rows = execute(parsed(rows, "__output"), into="__again")
    again = F.col("__again")
    said = lambda c: normalize(F.coalesce(c, F.lit("")))
    # one Arrow call folds all texts of a row
    rows = rows.withColumns({"__o": said(F.col("old_answer")), "__c": said(again["candidate_answer"]), "__s": said(again["answer"]), "__right": normalize_all("new_answers")})
    right = F.col("__right")
    f1 = lambda c: token_prf(F.col(c), right)["f1"]
    em = lambda c: exact_match(F.col(c), right)
    sound, valid = F.coalesce(again["answer_valid"], F.lit(False)), F.coalesce(again["valid"], F.lit(False))
    return rows.groupBy(*by).agg(
        F.count("*").alias("cases"), _hundred(em("__o")).alias("cached_em"), _hundred(f1("__o")).alias("cached_f1"), _hundred(F.col("__old_plan.valid")).alias("old_plan_valid"),
        _hundred(F.col("program").isNotNull()).alias("parse_rate"), _hundred(valid).alias("valid_rate"), _hundred(valid & again["certified"]).alias("certified_rate"),
        _hundred(F.when(sound, em("__c"))).alias("candidate_em"), _hundred(F.when(sound, f1("__c"))).alias("candidate_f1"), _hundred(F.when(valid, em("__s"))).alias("strict_em"), _hundred(F.when(valid, f1("__s"))).alias("strict_f1"),
    )


def recovery_answers(cases: DataFrame, outputs: DataFrame, *by: str) -> DataFrame:
    """The same for stored answers: cases, parse_rate (a tagged answer that isn't empty), answer_em, answer_f1."""
    rows = _with_outputs(cases.select("dataset", "qid", "new_answers", *by), outputs).withColumn("__said", F.coalesce(wrapped_answer(F.col("__output")), F.lit("")))
    rows = rows.withColumns({"__p": normalize(F.col("__said")), "__right": normalize_all("new_answers")})
    some, right = F.col("__said") != "", F.col("__right")
    return rows.groupBy(*by).agg(
        F.count("*").alias("cases"), _hundred(some).alias("parse_rate"), _hundred(F.when(some, exact_match(F.col("__p"), right))).alias("answer_em"), _hundred(F.when(some, token_prf(F.col("__p"), right)["f1"])).alias("answer_f1"),
    )
