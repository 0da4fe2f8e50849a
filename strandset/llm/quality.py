"""Quality rules with a ledger of bits (operator 12).

Each rule is evaluated once for each document: ``ledger`` keeps its measurements and one bit a rule that failed. Policies are versioned sets
of rules over that ledger, so a new one needs no text; ``ablations`` tells from counts of equal bit sets what each rule of a policy decides alone.

Measurements are whole numbers and rules compare them without fractions, so SQL gives the same bits. Texts are measured in tasks, in
slices of a few MB; a longer text is a slice by itself. Windows of three words are compared as words, not as digests.

A null text has no words and fails the rules that an empty one fails; repeated rows give repeated rows; empty tables give empty
results; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandset.llm.common import arrow_column, binary
from strandset.llm.tokens import text_slices

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks", "n_distinct")


class Rule(NamedTuple):
    """A document fails where ``times`` of ``part`` is more than ``limit`` of ``whole``; without a whole, where ``times`` of part is under ``limit``."""

    name: str
    part: str
    times: int
    limit: int
    whole: str | None = None

    def failed(self) -> Column:
        left = self.times * F.col(self.part)
        return left < self.limit if self.whole is None else left > self.limit * F.col(self.whole)

    def sql(self) -> str:
        return f"{self.times} * {self.part} < {self.limit}" if self.whole is None else f"{self.times} * {self.part} > {self.limit} * {self.whole}"


#: The place of a rule is its bit and never changes; new rules go to the end.
RULES = (
    Rule("few_words", "n_words", 1, 50),
    Rule("repeated_words", "n_repeat_words", 100, 50, "n_words"),
    Rule("symbols", "n_symbols", 100, 20, "n_words"),
    Rule("capitals", "n_upper", 100, 60, "n_lower"),
    Rule("marks", "n_marks", 100, 30, "n_words"),
    Rule("long_words", "word_chars", 1, 14, "n_words"),
    Rule("duplicate_lines", "n_dup_lines", 100, 50, "n_lines"),
    Rule("some_symbols", "n_symbols", 100, 5, "n_words"),
    Rule("some_repeated_words", "n_repeat_words", 100, 20, "n_words"),
)
BITS = {r.name: i for i, r in enumerate(RULES)}

#: Policies by version: a document is rejected where it fails any of these rules. "base" must stay as it is.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "1": ("few_words", "repeated_words", "symbols", "capitals", "marks", "long_words", "duplicate_lines"),
    "2-strict": ("few_words", "repeated_words", "symbols", "capitals", "marks", "long_words", "duplicate_lines", "some_symbols", "some_repeated_words"),
}
CURRENT = "1"


def mask(policy: str | tuple[str, ...]) -> int:
    return sum(1 << BITS[name] for name in (POLICIES[policy] if isinstance(policy, str) else policy))


def repeated(codes):
    """How many places lie in windows of three codes that occur twice or more."""
    import numpy as np

    if len(codes) < 4:
        return 0
    _, pairs = np.unique(codes[:-2] * (int(codes.max()) + 1) + codes[1:-1], return_inverse=True)
    _, at, n = np.unique(pairs * (int(codes.max()) + 1) + codes[2:], return_inverse=True, return_counts=True)
    found = np.flatnonzero(n[at] > 1)
    hit = np.zeros(len(codes), dtype=bool)
    for i in range(3):
        hit[found + i] = True
    return int(hit.sum())


def duplicate_lines(raw: bytes) -> tuple[int, int]:
    """(lines with a word, those that equal an earlier line)."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def measured(column):
    """An Arrow struct of MEASURES for an Arrow column of texts of a few MB."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(column)
    words = lists.flatten()
    ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    some = np.asarray(pc.greater(pc.binary_length(words), 0).cast(pa.int8()), dtype=np.int64) if len(words) else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(some)])[ends]
    words = words.filter(pa.array(some.astype(bool)))  # white space at either end gives empty ones
    chars = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(words), dtype=np.int64))])[before]
    codes = np.asarray(words.dictionary_encode().indices, dtype=np.int64)
    repeats, distinct = [], []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        own = np.unique(codes[a:b], return_inverse=True)
        repeats.append(repeated(own[1]))
        distinct.append(len(own[0]))
    lines = [duplicate_lines(x) for x in binary(column)]
    found = {
        "n_words": np.diff(before), "word_chars": np.diff(chars), "n_symbols": pc.count_substring_regex(column, r"[#*$%&|<>]"), "n_dup_lines": [x[1] for x in lines], "n_repeat_words": repeats, "n_lines": [x[0] for x in lines],
        "n_upper": pc.count_substring_regex(column, "[A-Z]"), "n_lower": pc.count_substring_regex(column, "[a-z]"), "n_marks": pc.count_substring_regex(column, "[!?]"), "n_distinct": distinct,
    }
    return pa.StructArray.from_arrays([(x if isinstance(x, pa.Array) else pa.array(x, pa.int64())).cast(pa.int64()) for x in map(found.__getitem__, MEASURES)], names=list(MEASURES))


def ledger(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, the measurements, failures): bit i of failures is set where rule i of RULES fails."""

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for column in batches:
            parts = [measured(part) for _, part in text_slices(column)]
            yield pa.concat_arrays(parts) if parts else measured(column)

    of = arrow_column(measure, T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
    rows = docs.select(F.col(id).alias("__id"), of(F.col(text).cast("string")).alias("__of"))
    rows = rows.select("__id", *[F.col(f"__of.{m}").alias(m) for m in MEASURES])
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(rule.failed(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return rows.select(F.col("__id").alias(id), *MEASURES, bits.alias("failures"))


def passes(policy: str | tuple[str, ...] = CURRENT, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(rows: DataFrame, policy: str | tuple[str, ...] = CURRENT) -> DataFrame:
    """(policy, rule, documents, rejected, failed, alone): rows of a ledger, those that the policy rejects, those that fail the rule, and those
    that fail no other rule of the policy, so would be kept without it.

    Equal bit sets are counted first; there are at most 2 to the number of rules of them, whatever the number of documents."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    own = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("long").alias("bit")) for r in names]))
    found = own.select("bits", "n", each.alias("x"))
    has = F.col("bits").bitwiseAND(F.col("x.bit")) != 0
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return found.groupBy(F.col("x.rule").alias("rule")).agg(
        F.sum("n").alias("documents"), n(F.col("bits") != 0).alias("rejected"), n(has).alias("failed"), n(F.col("bits") == F.col("x.bit")).alias("alone")
    ).select(F.lit(policy if isinstance(policy, str) else "+".join(policy)).alias("policy"), "rule", "documents", "rejected", "failed", "alone")
