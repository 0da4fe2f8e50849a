"""Scores of answers and evidence, and their reports as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandset.functions.text import exact_match, normalize, normalize_all, token_prf
from strandset.operators.program import parsed
from strandset.operators.ranges import running
from strandset.operators.vm import execute


def set_prf(predicted: Column, gold: Column) -> Column:
    """Struct (em, precision, recall, f1) of two sets given as arrays of distinct values."""
    both = F.size(F.array_intersect(predicted, gold))
    n, m = F.size(predicted), F.size(gold)
    empty = (n == 0) & (m == 0)
    part = lambda size: F.when(empty, 1.0).when(size == 0, 0.0).otherwise(both / F.greatest(size, F.lit(1)))
    p, r = part(n), part(m)
    exact = ((both == n) & (both == m)).cast("double")
    f1 = F.when(empty, 1.0).when(both == 0, 0.0).otherwise(2 * p * r / F.when(p + r == 0, 1.0).otherwise(p + r))
    return F.struct(exact.alias("em"), p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def last_by_id(predictions: DataFrame, order: str = "line") -> DataFrame:
    """One prediction for each id, the last in file order."""
    return predictions.groupBy("id").agg(F.max_by(F.struct(*predictions.columns), order).alias("x")).select("x.*")


def matched(contexts: DataFrame, predictions: DataFrame) -> DataFrame:
    """Contexts with their prediction by qid, else by dataset:qid; null output where there is none."""
    one = predictions.select(F.col("id").alias("__id"), F.col("output").alias("__a"))
    two = predictions.select(F.col("id").alias("__id2"), F.col("output").alias("__b"))
    rows = contexts.join(one, F.col("qid") == F.col("__id"), "left").join(two, F.concat_ws(":", "dataset", "qid") == F.col("__id2"), "left")
    return rows.withColumn("output", F.coalesce("__a", "__b")).drop("__id", "__id2", "__a", "__b")


def scored(rows: DataFrame, *, allow_literal: bool = False) -> DataFrame:
    """Executed rows with status (missing_prediction, parse_error, invalid, valid), answer scores (em, prf) and evidence scores."""
    rows = execute(parsed(rows), allow_literal=allow_literal)
    r = F.col("result")
    rows = rows.withColumns(
        {"__p": normalize(F.coalesce(r["candidate_answer"], F.lit(""))), "__a": normalize_all("answers")}
    )
    sound = F.coalesce(r["answer_valid"], F.lit(False))
    zero = F.struct(F.lit(0.0).alias("f1"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"))
    status = F.when(F.col("output").isNull(), "missing_prediction").when(F.col("program").isNull(), "parse_error").when(r["valid"], "valid").otherwise("invalid")
    by_doc = F.col("dataset") == "musique"
    docs = lambda refs: F.array_distinct(F.transform(refs, lambda x: F.struct(x["doc"].alias("doc"), F.lit(0).alias("sent"))))
    refs = lambda c: F.when(by_doc, docs(c)).otherwise(F.array_distinct(c))
    cited = F.coalesce(F.col("program.evidence"), F.array().cast("array<struct<doc:int,sent:int>>"))
    return rows.withColumns(
        {
            "status": status,
            "em": F.when(sound, exact_match(F.col("__p"), F.col("__a"))).otherwise(0.0),
            "prf": F.when(sound, token_prf(F.col("__p"), F.col("__a"))).otherwise(zero),
            "evidence_score": F.when(F.col("support_complete"), set_prf(refs(cited), refs(F.col("support")))),
        }
    ).drop("__p", "__a")


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """The evaluation report: rates and scores per hundred examples; joint scores only where all evidence is scored."""
    r, e = F.col("result"), F.col("evidence_score")
    f1, p, c = F.col("prf.f1"), F.col("prf.precision") * e["precision"], F.col("prf.recall") * e["recall"]
    valid, certified = F.col("status") == "valid", F.coalesce(r["certified"], F.lit(False))
    n = F.count("*")
    some = lambda cond: F.greatest(F.sum(cond.cast("int")), F.lit(1))
    rate = lambda x, over=n: 100.0 * F.sum(F.coalesce(x.cast("double"), F.lit(0.0))) / F.greatest(over, F.lit(1))
    on = lambda cond, x: F.when(cond, x).otherwise(0.0)
    has = e.isNotNull()
    joint = (F.max(F.when(F.col("dataset") == "musique", 1).otherwise(0)) == 0) & (F.sum(has.cast("int")) == n)
    aggregates = {
        "examples": n, "parse_rate": rate(F.col("program").isNotNull()), "valid_rate": rate(valid), "certified_rate": rate(certified), "candidate_rate": rate(F.coalesce(r["answer_valid"], F.lit(False))),
        "answer_em": rate(F.col("em")), "answer_f1": rate(f1), "strict_em": rate(on(valid, F.col("em"))), "strict_f1": rate(on(valid, f1)), "valid_em": rate(on(valid, F.col("em")), some(valid)),
        "valid_f1": rate(on(valid, f1), some(valid)), "certified_em": rate(on(certified, F.col("em")), some(certified)), "certified_f1": rate(on(certified, f1), some(certified)),
        "evidence_examples": F.sum(has.cast("long")), **{f"evidence_{k}": rate(e[k], some(has)) for k in ("em", "precision", "recall", "f1")},
        "joint_em": F.when(joint, rate(F.col("em") * e["em"])), "joint_f1": F.when(joint, rate(F.when(p + c > 0, 2 * p * c / F.when(p + c > 0, p + c)).otherwise(0.0))),
    }
    return rows.groupBy(*by).agg(*[v.alias(k) for k, v in aggregates.items()])


def error_histogram(rows: DataFrame, *by: str) -> DataFrame:
    """(*by, error, n): execution errors, and missing_prediction, parse_error, valid_wrong_answer."""
    own = F.when(F.col("status").isin("missing_prediction", "parse_error"), F.array(F.col("status"))).when(F.col("status") == "invalid", F.col("result.errors")).when(
        F.col("em") == 0, F.array(F.lit("valid_wrong_answer"))
    )
    return rows.select(*by, F.explode(own).alias("error")).groupBy(*by, "error").agg(F.count("*").alias("n"))


def floor_percentiles(rows: DataFrame, value: str, fractions: dict[str, float], *by: str) -> DataFrame:
    """(*by, n, name, …): for each fraction the value at place floor(fraction * (n - 1)) of a group's sorted values.

    Equal values are counted on the map side; running counts over ranges of the distinct ones tell where each place lies, so that a group may have
    any number of values and no task sorts more than a range of them."""
    keys = list(by) or ["__all"]
    rows = rows if by else rows.withColumn("__all", F.lit(1))
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__value")).agg(F.count("*").alias("__n"))
    ranked = running(counted, tuple(keys), ("__value",), "__n", "__before", "__total")
    at = lambda f: F.min(F.when(F.col("__before") + F.col("__n") > F.floor(F.lit(f) * (F.col("__total") - 1)), F.col("__value")))
    return ranked.groupBy(*keys).agg(F.max("__total").alias("n"), *[at(f).alias(name) for name, f in fractions.items()]).drop("__all")
