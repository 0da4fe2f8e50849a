import math
import random
import re
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from strandset.llm.common import Scratch
from strandset.llm.resampling import Buckets, above, bucket_counts, drawn, gains, resampled, word_runs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, target, buckets=10_000, percent=10, least=20):
    """(id, n_features, weight, score, rank) in plain Python."""
    bucket = lambda w: crc32(w.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for table, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for w in words(text):
                table[bucket(w)] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    out = []
    for id, text in docs:
        weight = sum(gain[bucket(w)] for w in words(text))
        h = int(sha256(f"2024:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
        out.append([id, len(words(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for i, r in enumerate(order[: percent * len(order) // 100], 1):
        r[4] = i
    return sorted(map(tuple, out), key=str)


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(11)
    made = [" ".join(draw.choice(["Alpha", "beta", "ÉCOLE", "éCole", "x1", "42", "gamma-delta", "\U0001f600"]) for _ in range(draw.randrange(60))) for _ in range(300)]
    made += [None, "", " ., ", "\x7fa\x00b", "w" * 200_000 + " end", "alpha " * 300_000, "ß中文 " * 30] + ["copy of one text " * 8] * 90
    return list(enumerate(made)) + [(None, "nobody " * 25), (5, "same id " * 20), (7, made[7]), (7, made[7])]


TARGET = ["beta beta école", None, "", "alpha copy"]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in docs], "doc_id long, text string, n_features string, weight int, rank int, score int")


@pytest.mark.parametrize("percent, least", [(10, 20), (100, 0), (37, 1), (0, 20)])
def test_equals_brute_force(spark, docs, percent, least):
    target = spark.createDataFrame([(t, "x") for t in TARGET], "text string, bucket string")
    got = resampled(frame(spark, docs), target, percent=percent, least=least).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, TARGET, percent=percent, least=least)


def test_few_buckets_make_ties(spark, docs):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resampled(frame(spark, docs), target, buckets=3, percent=50).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, TARGET, buckets=3, percent=50)


def test_empty_tables(spark, docs):
    own = frame(spark, docs)
    nothing = spark.createDataFrame([], "text string")
    assert resampled(own.where("false"), nothing).count() == 0
    assert sorted((tuple(r) for r in resampled(own, nothing).collect()), key=str) == brute(docs, [])
    assert gains(own.where("false"), nothing, buckets=4) == [0] * 4


def test_ranks_of_equal_scores(spark):
    rows = spark.createDataFrame([(i, 7 if i % 3 else -(1 << 45)) for i in range(40)] + [(None, 7)], "doc_id long, score long")
    got = {r.doc_id: r["rank"] for r in drawn(rows, F.lit(True), 80).collect()}
    order = [None] + [i for i in range(40) if i % 3] + [i for i in range(40) if i % 3 == 0]
    assert {i: got[i] for i in order[:32]} == {i: n for n, i in enumerate(order[:32], 1)} and all(got[i] is None for i in order[32:])


def test_suffix_sums_over_wide_ranges(spark):
    draw = random.Random(2)
    n = {draw.randrange(-(1 << 50), 1 << 50) if i % 2 else draw.randrange(-9000, 9000): draw.randrange(1, 9) for i in range(3000)}
    got = {r.score: r.above for r in above(spark.createDataFrame(list(n.items()), "score long, n long"), Scratch(spark, "test-above")).collect()}
    total = 0
    for score in sorted(n, reverse=True):
        assert got[score] == total
        total += n[score]


def test_words_are_never_cut():
    draw = random.Random(4)
    for _ in range(300):
        raw = "".join(draw.choice("ab é,C9 \n") for _ in range(draw.randrange(700))).encode()
        assert [w for part in word_runs(raw, 7) for w in part] == [w.encode() for w in words(raw.decode())]


def test_bucket_counts_and_bounded_memory(spark, docs):
    got = {r.bucket: r.n for r in bucket_counts(frame(spark, docs), buckets=50).collect()}
    want = {}
    for _, text in docs:
        for w in words(text):
            want[crc32(w.encode()) % 50] = want.get(crc32(w.encode()) % 50, 0) + 1
    assert got == want
    own = Buckets(10, held=3)
    assert own.of([b"a", b"b", b"c", b"d", b"e"]).tolist() == [crc32(x) % 10 for x in (b"a", b"b", b"c", b"d", b"e")] and len(own) <= 3
