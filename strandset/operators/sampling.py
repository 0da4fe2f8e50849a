"""Deterministic samples, splits, and orders by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandset.functions.text import hash_bucket, text_digest
from strandset.operators.metrics import floor_percentiles


def split(rows: DataFrame, key: Column, holdout: float = 0.05, name: str = "part") -> DataFrame:
    """Adds train or holdout by the digest bucket of a key."""
    return rows.withColumn(name, F.when(hash_bucket(key) < int(holdout * 10_000), "holdout").otherwise("train"))


def first_by_digest(rows: DataFrame, key: Column, k: int) -> DataFrame:
    """The k rows with the lowest digest of their key."""
    return rows.withColumn("__d", text_digest(key)).orderBy("__d").limit(k).drop("__d")


def balanced(rows: DataFrame, k: int, seed: int, stratum: str = "dataset", kind: str = "op", id: str = "id") -> DataFrame:
    """k rows shared over the strata evenly (earlier ones get what is left over), in each by turns over the kinds in order,
    within a kind by digest of seed:id."""
    strata = rows.select(stratum).distinct()
    n = strata.count()  # one number
    if k <= 0 or n == 0:
        return rows.limit(0)
    quota = strata.withColumn("__at", F.row_number().over(W.orderBy(stratum)) - 1).withColumn("__quota", F.lit(k // n) + (F.col("__at") < k % n).cast("int"))
    digest = text_digest(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")))
    turn = rows.withColumn("__turn", F.row_number().over(W.partitionBy(stratum, kind).orderBy(digest, id)))
    place = turn.where(F.col("__turn") <= k).withColumn("__place", F.row_number().over(W.partitionBy(stratum).orderBy("__turn", kind)))
    return place.join(F.broadcast(quota), stratum).where("__place <= __quota").drop("__turn", "__place", "__at", "__quota")


def root_weights(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds weight: one over the square root of the size of the row's group."""
    sizes = rows.groupBy(*keys).agg((1 / F.sqrt(F.count("*").cast("double"))).alias("weight"))
    return rows.join(sizes, list(keys))


def length_profile(rows: DataFrame, length: str, most: int, by: str) -> DataFrame:
    """Rows, kept rows and lengths by group: n, kept, shortest, p50, p95, p99, longest."""
    ok = F.col(length) <= most
    ends = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.coalesce(ok, F.lit(False)).cast("long")).alias("kept"), F.min(length).alias("shortest"), F.max(length).alias("longest"))
    middle = floor_percentiles(rows, length, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, by).drop("n")
    return ends.join(middle.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a given order (of files and lines, say), never whichever come first."""
    return rows.orderBy(*order).limit(n)


def longest(rows: DataFrame, length: str, id: str, n: int = 10) -> DataFrame:
    """(id, length) of the n longest rows, ties by id."""
    return rows.select(id, length).orderBy(F.desc(length), id).limit(n)


def within_length(rows: DataFrame, length: str, most: int, id: str, skip: bool = True) -> DataFrame:
    """Rows of at most ``most``; with ``skip`` false one that is longer fails the query, since nothing is ever cut."""
    ok = F.coalesce(F.col(length) <= most, F.lit(False))
    if skip:
        return rows.where(ok)
    message = F.concat(F.col(id).cast("string"), F.lit(" has "), F.coalesce(F.col(length).cast("string"), F.lit("no")), F.lit(f" tokens, more than {most}"))
    return rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
