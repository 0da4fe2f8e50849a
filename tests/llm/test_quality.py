import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandset.llm.quality import BITS, MEASURES, POLICIES, RULES, ablations, ledger, mask, passes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    """The measurements in plain Python."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count = lambda pattern: len(re.findall(pattern, text))
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": count(r"[#*$%&|<>]"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_lines": len(lines), "n_upper": count("[A-Z]"),
        "n_lower": count("[a-z]"), "n_marks": count("[!?]"), "n_distinct": len(set(words)),
    }


def failures(m):
    left = {r.name: r.times * m[r.part] for r in RULES}
    return sum(1 << BITS[r.name] for r in RULES if (left[r.name] < r.limit if r.whole is None else left[r.name] > r.limit * m[r.whole]))


def texts():
    draw = random.Random(5)
    made = [" ".join(draw.choice(["a", "b", "C!", "d#", "é"]) for _ in range(draw.randrange(90))) + draw.choice(["", "\n", " \n \n"]) for _ in range(60)]
    odd = [None, "", " \n\t ", "\x0b\x0ca\x1cb\x85c d", "a a a", "a a a a", "a b a b a b", "x\nx\n \n \nx", "&<>|%$*# #", "w " * 60, "中文 \U0001f600 " * 40, "Lead  in\n" * 30, " lead", "trail ", "u" * 300_000, " ".join(str(i) for i in range(400_000)) + " 1 2 3"]
    return made + odd


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", True, 3) for i, t in enumerate(texts())], "doc_id long, text string, n_words string, kept boolean, failures int")


def test_ledger_equals_plain_python(docs):
    want = texts()
    got = ledger(docs).collect()
    assert len(got) == len(want)
    for r in got:
        m = measures(want[r.doc_id])
        assert {k: r[k] for k in MEASURES} == m and r.failures == failures(m), want[r.doc_id][:80]


def test_policies_and_ablations(docs):
    rows = ledger(docs)
    bits = [r.failures for r in rows.collect()]
    for policy, names in POLICIES.items():
        own = [b & mask(policy) for b in bits]
        assert rows.where(passes(policy)).count() == own.count(0)
        got = {r.rule: tuple(r)[2:] for r in ablations(rows, policy).collect()}
        assert got == {n: (len(bits), sum(b != 0 for b in own), sum(b >> BITS[n] & 1 for b in own), own.count(1 << BITS[n])) for n in names}
    assert {r.rule for r in ablations(rows, ("marks", "symbols")).collect()} == {"marks", "symbols"}


def test_kept_never_where_the_base_fails(docs):
    rows = ledger(docs)
    assert all(rows.where(~passes("base") & passes(p)).count() == 0 for p in POLICIES)


def test_repeated_rows_and_empty_tables(docs):
    one = docs.where("doc_id = 7")
    twice = ledger(one.unionAll(one)).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    assert ledger(docs.where("false")).count() == 0 and ablations(ledger(docs.where("false"))).count() == 0
    no_id = ledger(one.withColumn("doc_id", F.lit(None).cast("long"))).first()
    assert no_id.doc_id is None and no_id.failures == twice[0].failures


def test_rules_tell_junk_from_prose(spark, sf):
    rows = ledger(spark.read.parquet(f"{sf}/documents.parquet")).withColumn("keep", passes())
    found = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("n_words >= 50").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept"))
    rate = {r.quality: r.kept for r in found.collect()}
    assert rate[1] > 0.99 and rate[0] < 0.02
