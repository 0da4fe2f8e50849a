import random
import re
from hashlib import sha256

from pyspark.sql import functions as F

from strandset.llm.fill_in_middle import Units, fill_in_middle, restored, runs

COLUMNS = "doc_id long, text string, n string, output string, form string, __cut long"
TEXTS = [
    None, "", "a", "<P> in the text", "x<S>", "ends in <", "<<<S", "<M", "P> starts", "S>M>P>", "one two three.", "é ü\n\t\x00\x0b 中文 \U0001f600\U0001f600 ok", "a" * 70_000, "ab1" * 40_000, ("word " * 9000 + "x" * 40_000) * 3,
    "same text here", "same text here",
]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", "x", "x", 1) for i, t in enumerate(texts)], COLUMNS)


def plain(id, text):
    """The transformation in plain Python."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha256(f"1:{'' if id is None else id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    parts = ["".join(x) for x in (units[:a], units[a:b], units[b:])]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(parts[0]), len(parts[1]), f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return n, "psm", len(parts[0]), len(parts[1]), f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


def test_equals_plain_python_on_odd_rows(spark):
    texts = TEXTS * 12  # each text under many digests
    docs = rows(spark, texts).unionAll(rows(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(texts) + 1 and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        text = "no id" if r.doc_id is None else texts[r.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, text)
        assert r.back == (text or "")


def test_repeated_rows_and_empty_tables(spark):
    docs = rows(spark, ["a b c"])
    twice = fill_in_middle(docs.unionAll(docs)).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    assert fill_in_middle(docs.where("false")).count() == 0


def test_other_names_and_seed(spark):
    docs = spark.createDataFrame([(7, "one two three four five")], "key int, body string")
    got = [fill_in_middle(docs, id="key", text="body", seed=str(s)).first() for s in range(8)]
    assert {r.key for r in got} == {7} and len({r.output for r in got}) > 1


def test_runs_cut_no_unit():
    draw = random.Random(3)
    for _ in range(200):
        text = "".join(draw.choice("ab c1é") for _ in range(draw.randrange(60)))
        parts = list(runs(text, 5))
        assert "".join(p for _, p in parts) == text and all(text[at : at + len(p)] == p for at, p in parts)
        assert [u for _, p in parts for u in re.findall("[A-Za-z]+|[^A-Za-z]", p)] == re.findall("[A-Za-z]+|[^A-Za-z]", text)


def test_ranked_offsets_over_many_runs():
    text = "abc, " * 30_000 + "z" * 50_000
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    starts = [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]
    ranks = [0, 1, len(units) // 2, len(units) - 1, len(units), 17, 80_000, 12]
    assert Units().cuts(text, *ranks) == (len(units), [starts[r] for r in ranks])
