"""Reports over whole prediction sets: evaluation, contracts, operator coverage, candidates, output baselines, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandset.functions.text import exact_match, normalize, normalize_all, token_prf
from strandset.operators.metrics import error_histogram, last_by_id, matched, scored, set_prf, summary
from strandset.operators.program import citation, parsed, wrapped_answer
from strandset.operators.vm import by_contract, checked


def hundred(part: Column, whole: Column | None = None) -> Column:
    """A sum per hundred of ``whole`` (rows, if not given); an empty whole counts as one."""
    return 100.0 * F.sum(F.coalesce(part.cast("double"), F.lit(0.0))) / F.greatest(F.count("*") if whole is None else whole, F.lit(1))


def variant_of(dataset: Column, variant: str | None = None) -> Column:
    return F.lit(variant) if variant else F.when(dataset == "hotpotqa", "distractor").otherwise("default")


def evaluation(contexts: DataFrame, predictions: DataFrame, variant: str | None = None, order: str = "line", allow_literal: bool = False) -> DataFrame:
    """The evaluation report, a row for each dataset: rates and scores per hundred, granularity of evidence, number of stored predictions,
    and errors (a map from error to rows). The last prediction of an id counts."""
    rows = scored(matched(contexts, last_by_id(predictions, order)), allow_literal=allow_literal)
    report = summary(rows, "dataset")
    errors = error_histogram(rows, "dataset").groupBy("dataset").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("error", "n")))).alias("errors"))
    grain = F.when(F.col("dataset") == "musique", "document").otherwise("sentence")
    out = report.join(errors, "dataset", "left")
    return out.withColumns({"predictions": F.lit(predictions.count()), "dataset_variant": variant_of(F.col("dataset"), variant), "granularity": grain, "errors": F.coalesce("errors", F.create_map().cast("map<string,bigint>"))})


def ablation(rows: DataFrame) -> DataFrame:
    """(variant, examples, parsed, accepted, accepted_rate, answer_em, answer_f1, strict_em, strict_f1) of the same programs under the five
    contracts. ``rows`` has output and answers; a row without a program is accepted under none."""
    done = checked(parsed(rows)).withColumns({"__p": normalize("__found"), "__a": normalize_all("answers")})
    done = done.withColumn("__score", F.struct(exact_match(F.col("__p"), F.col("__a")).alias("em"), token_prf(F.col("__p"), F.col("__a"))["f1"].alias("f1")))
    each = by_contract(done.select(*[c for c in done.columns if c not in ("__p", "__a", "documents")]))
    sound = F.coalesce(F.col("result.answer_valid"), F.lit(False))
    part = lambda on, name: hundred(F.when(on, F.col(f"__score.{name}")))
    return each.groupBy("variant").agg(
        F.count("*").alias("examples"), F.sum(F.col("program").isNotNull().cast("long")).alias("parsed"), F.sum(F.col("accepted").cast("long")).alias("accepted"), hundred(F.col("accepted")).alias("accepted_rate"),
        part(sound, "em").alias("answer_em"), part(sound, "f1").alias("answer_f1"), part(F.col("accepted"), "em").alias("strict_em"), part(F.col("accepted"), "f1").alias("strict_f1"),
    )


def join_family(program: Column) -> Column:
    """both, query_only, equi_only or none, by the kinds of a program's joins."""
    has = lambda kind: F.exists(program["joins"], lambda j: j["kind"] == kind)
    other = F.exists(program["joins"], lambda j: ~j["kind"].isin("query", "equi"))
    return F.when(other, "none").when(has("query") & has("equi"), "both").when(has("query"), "query_only").when(has("equi"), "equi_only").otherwise("none")


def coverage(rows: DataFrame) -> DataFrame:
    """(level, value, examples, share, answer_valid_rate, valid_rate, certified_rate, answer_f1, strict_f1) of scored rows with a program, by
    operator, join family and mode in one pass."""
    r, f1 = F.col("result"), F.col("prf.f1")
    level = lambda name, value: F.struct(F.lit(name).alias("level"), value.alias("value"))
    own = rows.where("program is not null")
    own = own.withColumn("__level", F.explode(F.array(level("operator", F.col("program.answer.op")), level("join_family", join_family(F.col("program"))), level("mode", F.col("program.mode")))))
    found = own.groupBy("__level").agg(
        F.count("*").alias("examples"), hundred(r["answer_valid"]).alias("answer_valid_rate"), hundred(r["valid"]).alias("valid_rate"), hundred(r["certified"]).alias("certified_rate"),
        hundred(F.when(r["answer_valid"], f1)).alias("answer_f1"), hundred(F.when(r["valid"], f1)).alias("strict_f1"),
    )
    share = 100.0 * F.col("examples") / F.sum("examples").over(W.partitionBy("__level.level"))
    return found.withColumn("share", share).select("__level.*", "examples", "share", "answer_valid_rate", "valid_rate", "certified_rate", "answer_f1", "strict_f1")


def output_baseline(rows: DataFrame, task: str) -> DataFrame:
    """(examples, parse_rate, answer_em, answer_f1, valid_citation_rate, evidence_f1) of outputs under the answer or citation protocol; the
    last two are null for answers. ``rows`` has output, answers, documents, support and support_complete."""
    if task == "answer":
        rows = rows.withColumns({"__raw": wrapped_answer(F.col("output")), "__refs": F.array().cast("array<struct<doc:int,sent:int>>")})
    else:
        rows = rows.withColumn("__c", citation("output")).withColumns({"__raw": F.when(F.col("__c.ok"), F.col("__c.answer")), "__refs": F.array_distinct(F.col("__c.evidence"))})
    rows = rows.withColumns({"__p": normalize(F.coalesce("__raw", F.lit(""))), "__a": normalize_all("answers")})
    read = F.col("__raw").isNotNull()
    there = (F.size("__refs") > 0) & F.forall("__refs", lambda e: (e["doc"] >= 0) & (e["sent"] >= 0) & F.get(F.get(F.col("documents"), e["doc"])["sentences"], e["sent"]).isNotNull())
    evidence = F.when(read & F.col("support_complete"), set_prf(F.col("__refs"), F.array_distinct("support"))["f1"])
    none = F.lit(None).cast("double")
    return rows.agg(
        F.count("*").alias("examples"), hundred(read).alias("parse_rate"), hundred(F.when(read, exact_match(F.col("__p"), F.col("__a")))).alias("answer_em"),
        hundred(F.when(read, token_prf(F.col("__p"), F.col("__a"))["f1"])).alias("answer_f1"), (none if task == "answer" else hundred(read & there)).alias("valid_citation_rate"),
        (none if task == "answer" else hundred(evidence)).alias("evidence_f1"),
    )


def candidate_scores(candidates: DataFrame, selected: DataFrame | Column) -> DataFrame:
    """A row for each question: candidates, parsed, sound, and em and f1 of the selected output, of the best candidate, of the best strictly
    valid one, and of two consensus choices (over all sound candidates, and over those of the best tier).

    ``candidates``: (qid, index, parsed, tier, answer (normalised), em, f1); ``selected``: (qid, em, f1), or which candidate it is, so that candidates
    are read once. A consensus is the
    answer with most sound candidates, then the best tier, the earliest candidate, the larger text; its best candidate counts."""
    rows = candidates.withColumn("__best", F.max("tier").over(W.partitionBy("qid")))
    sound = F.col("tier") > 0
    choices = {"consensus": sound, "tier_consensus": sound & (F.col("tier") == F.col("__best"))}
    bests = {"oracle": sound, "strict": F.col("tier") == 2}
    if isinstance(selected, Column):
        bests["selected"] = selected
    n = lambda c: F.sum(c.cast("long"))
    vote = lambda c: F.struct(n(c).alias("n"), F.max(F.when(c, F.struct("tier", (-F.col("index")).alias("early"), "em", "f1"))).alias("x"), F.max(F.when(c, -F.col("index"))).alias("early"))
    votes = rows.groupBy("qid", "answer").agg(
        F.count("*").alias("candidates"), n(F.col("parsed")).alias("parsed"), n(sound).alias("sound"), *[F.max(F.when(c, F.col(m))).alias(f"{k}_{m}") for k, c in bests.items() for m in ("em", "f1")], *[vote(c).alias(k) for k, c in choices.items()]
    )
    first = lambda v: F.max_by(v["x"], F.when(v["n"] > 0, F.struct(v["n"], v["x"]["tier"], v["early"], F.col("answer"))))
    one = votes.groupBy("qid").agg(*[F.sum(c).alias(c) for c in ("candidates", "parsed", "sound")], *[F.max(f"{k}_{m}").alias(f"{k}_{m}") for k in bests for m in ("em", "f1")], *[first(F.col(k)).alias(k) for k in choices])
    out = one if isinstance(selected, Column) else one.join(selected.select("qid", *[F.col(c).alias(f"selected_{c}") for c in ("em", "f1")]), "qid", "left")
    scores = [f"{k}_{m}" for k in ("oracle", "strict") for m in ("em", "f1")]
    out = out.select("qid", "candidates", "parsed", "sound", "selected_em", "selected_f1", *scores, *[F.col(f"{k}.{m}").alias(f"{k}_{m}") for k in choices for m in ("em", "f1")])
    return out.na.fill(0.0, [c for c in out.columns if c.endswith(("_em", "_f1"))])


def candidate_report(scores: DataFrame, examples: int | None = None) -> DataFrame:
    """One row of rates per hundred questions (``examples`` of them, where some have no candidates) and per hundred candidates."""
    whole = F.count("*") if examples is None else F.lit(examples)
    n = F.sum("candidates")
    names = [c for c in scores.columns if c.endswith(("_em", "_f1"))]
    return scores.agg(
        whole.alias("examples"), n.alias("candidates"), hundred(F.col("parsed"), n).alias("parse_rate"), hundred(F.col("sound"), n).alias("sound_rate"), hundred(F.col("sound") > 0, whole).alias("answered"),
        *[hundred(F.col(c), whole).alias(c) for c in names],
    )
