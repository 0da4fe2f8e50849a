"""Importance resampling towards a target distribution (operator 13).

Words go to a fixed number of buckets by their crc32. Each task counts its own buckets in one array and reports those it met; the sums
over all documents and over all target texts give a gain for each bucket, an array of fixed size that is sent to all workers. A document's
weight is the sum of the gains at its words' buckets. Gumbel noise from a digest of the id, rounded down like the gains, makes
the scores whole numbers, and the highest scores a sample without replacement in proportion to the weights.

The draw sorts no documents: counts of equal scores make an exact histogram, whose suffix sums tell how many documents are above each
score. They are summed through a tree of score ranges (each node has at most FAN children, the leaves are scores), so that no task
sees more than FAN rows of a level. The suffix sums give the cutoff score; documents from it on get the offset of their score plus
their row number by id within it.

A null text has no words, weight 0 and takes part in no draw, as all texts under ``least`` words; a null id has the digest of an empty one and
comes first among equal scores; repeated rows are drawn by themselves, with neighbouring ranks; an empty corpus or target gives the same
formulas with zero counts; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strandset.llm.common import Scratch, arrow_column, binary, lean
from strandset.llm.fill_in_middle import digest_part
from strandset.llm.tokens import text_slices

BUCKETS = 10_000
BITS = 12
FAN = 1 << BITS
RUN = 1 << 20  # bytes of a text that are split into words at once
HELD = 1 << 17  # words whose bucket a worker remembers
LONGEST = 64  # bytes of a word that it does

#: Lower-cases A-Z; what belongs to no word becomes a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def word_runs(raw: bytes, size: int = RUN) -> Iterator[list[bytes]]:
    """The words of a text, in lists of those of about ``size`` bytes; no word is cut."""
    at = 0
    while at < len(raw):
        part = raw[at : at + size].translate(LETTERS)
        end = at + size
        while end < len(raw) and part[-1] != 32:  # the last word goes on
            more = raw[end : end + 256].translate(LETTERS)
            stop = more.find(b" ")
            part += more if stop < 0 else more[: stop + 1]
            end += len(more) if stop < 0 else stop + 1
        at = end
        yield part.split()


class Buckets(dict):
    """Word -> bucket; bounded, since forgetting only costs time."""

    def __init__(self, buckets: int, held: int = HELD):
        super().__init__()
        self.buckets, self.held = buckets, held

    def __missing__(self, word: bytes) -> int:
        from zlib import crc32

        bucket = crc32(word) % self.buckets
        if len(word) <= LONGEST:
            if len(self) >= self.held:
                self.clear()
            self[word] = bucket
        return bucket

    def of(self, words: list[bytes]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): words in each bucket over all texts; every task reports its sums, at most ``buckets`` rows."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own, sums = Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for raw in (x for _, part in text_slices(batch.column(0)) for x in binary(part)):
                for words in word_runs(raw):
                    sums += np.bincount(own.of(words), minlength=buckets)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(sums[met])], ["bucket", "n"])

    told = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lean(count), "bucket int, n long")
    return told.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, floor(1000 ln of the ratio of its smoothed shares); the only thing that reaches the driver, and of fixed size."""
    both = bucket_counts(docs, text, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionAll(bucket_counts(target, target_text, buckets).select("bucket", F.lit(0).cast("long"), "n"))
    s, t = [0] * buckets, [0] * buckets
    for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        s[r.bucket], t[r.bucket] = r.s, r.t
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log((y + 1.0) * all_s / ((x + 1.0) * all_t))) for x, y in zip(s, t)]


def weights(docs: DataFrame, found: list[int], id: str = "doc_id", text: str = "text", seed: str = "2024") -> DataFrame:
    """(id, n_features, weight, score): weight is the sum of gains over a text's words, score the weight with the noise of its id."""
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def weigh(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = np.array(sent.value, dtype=np.int64)
        own = Buckets(len(table))
        for column in batches:
            n, total = [], []
            for raw in (x for _, part in text_slices(column) for x in binary(part)):
                parts = [(len(words), int(table[own.of(words)].sum())) for words in word_runs(raw)]
                n.append(sum(p[0] for p in parts))
                total.append(sum(p[1] for p in parts))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(total, pa.int64())], ["n", "weight"])

    of = arrow_column(weigh, T.StructType([T.StructField("n", T.LongType()), T.StructField("weight", T.LongType())]))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))).cast("binary"), 256)
    noise = F.floor(-1000 * F.log(-F.log((digest_part(digest, 0) + 0.5) / 4294967296.0))).cast("long")
    rows = docs.select(F.col(id).alias("__id"), noise.alias("__noise"), of(F.col(text).cast("string")).alias("__of"))
    return rows.select(F.col("__id").alias(id), F.col("__of.n").alias("n_features"), F.col("__of.weight").alias("weight"), (F.col("__of.weight") + F.col("__noise")).alias("score"))


def above(histogram: DataFrame, scratch: Scratch, score: str = "score", n: str = "n") -> DataFrame:
    """Adds ``above`` to a histogram of distinct whole-number scores: the sum of ``n`` over all higher scores.

    Sums go up a tree of score ranges, level by level, until one node holds all; suffix sums come down again. A level's window has
    at most FAN rows in each part."""
    least, most = histogram.agg(F.min(score), F.max(score)).first()
    parent = F.shiftright(F.col("__node"), BITS)
    levels = [histogram.select((F.col(score) - F.lit(least)).cast("long").alias("__node"), F.col(n).alias("__n"))]
    while (most - least) >> BITS * len(levels):
        up = levels[-1].groupBy(parent.alias("__node")).agg(F.sum("__n").alias("__n"))
        levels.append(scratch.keep(up, f"level-{len(levels)}"))
    over = None
    for level in reversed(levels):
        own = W.partitionBy("__parent").orderBy(F.col("__node").desc()).rowsBetween(W.unboundedPreceding, -1)
        rows = level.withColumn("__parent", parent).withColumn("__beside", F.coalesce(F.sum("__n").over(own), F.lit(0)))
        if over is not None:
            rows = rows.join(over, "__parent")
        else:
            rows = rows.withColumn("__over", F.lit(0).cast("long"))
        over = rows.select(F.col("__node").alias("__parent"), (F.col("__over") + F.col("__beside")).alias("__over"))
    return over.select((F.col("__parent") + F.lit(least)).alias(score), F.col("__over").alias("above"))


def drawn(scored: DataFrame, eligible: Column, percent: int = 10, id: str = "doc_id") -> DataFrame:
    """``scored`` (written, with score) with rank: 1, 2, 3 … by falling score, then id, for the ``percent`` of a hundred of the eligible rows
    that are highest; null for the others."""
    scratch = Scratch(scored.sparkSession, "resampling")
    rows = scratch.keep(scored.withColumn("__in", F.coalesce(eligible, F.lit(False))), "rows")
    counts = scratch.keep(rows.where("__in").groupBy("score").agg(F.count("*").alias("n")), "histogram")
    places = (counts.agg(F.sum("n")).first()[0] or 0) * percent // 100
    if not places:
        return rows.withColumn("rank", F.lit(None).cast("long")).drop("__in")
    over = scratch.keep(above(counts, scratch).where(F.col("above") < places), "above")
    cutoff = over.agg(F.min("score")).first()[0]
    in_reach = F.col("__in") & (F.col("score") >= cutoff)
    own = W.partitionBy("score").orderBy(F.col(id).asc_nulls_first())
    rank = F.col("above") + F.row_number().over(own)
    kept = rows.where(in_reach).join(over, "score").withColumn("rank", rank)
    kept = kept.withColumn("rank", F.when(F.col("rank") <= places, F.col("rank")))
    return kept.select(*rows.columns, "rank").unionAll(rows.where(~in_reach).withColumn("rank", F.lit(None).cast("long"))).drop("__in")


def resampled(
    docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, percent: int = 10, least: int = 20, seed: str = "2024"
) -> DataFrame:
    """(id, n_features, weight, score, rank), one row for each row of ``docs``."""
    found = gains(docs, target, text, target_text, buckets)
    return drawn(weights(docs, found, id, text, seed), F.col("n_features") >= least, percent, id)
