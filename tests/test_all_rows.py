import hashlib
import re
import string
import unicodedata
from collections import Counter
from html import unescape

import pytest

from strandset.plans.queries import QUERIES

TEXTS = ["The Straße, an (ﬁne) day! Über 5. Next one.", "One\u00a0two. \u2003Three? 4 is.", "plain. And A &amp; B", "EL AÑO. Él", "el año. él!", "", None, "“The” 中文。 A. B", "yes", "Yés no"]


def clean(text):
    return " ".join(unescape(text or "").split())


def sentences(text):
    return [x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", clean(text)) if x.strip()]


def fold(text):
    value = "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", value, flags=re.I).split())


def prf(a, b):
    x, y = a.split(), b.split()
    if x != y and {"yes", "no"} & {a, b}:
        return 0, 0, 0
    if not x or not y:
        return (float(x == y),) * 3
    n = (Counter(x) & Counter(y)).total()
    return (2 * n / (len(x) + len(y)), n / len(x), n / len(y)) if n else (0, 0, 0)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("rows"))
    for name, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        spark.createDataFrame(list(enumerate(TEXTS)), f"{key} long, text string").write.parquet(f"{at}/{name}.parquet")
    return at


def test_texts_of_all_rows(spark, tables):
    run = lambda name: sorted(map(tuple, QUERIES[name](spark, tables).collect()))
    assert run("sentence_cells") == [(i, k, sha(x)) for i, t in enumerate(TEXTS) for k, x in enumerate(sentences(t))]
    assert run("structure_digest") == [(i, sha(f"[[0,{len(sentences(t))}]]")) for i, t in enumerate(TEXTS)]
    assert run("normalize") == [(i, None if t is None else fold(t)) for i, t in enumerate(TEXTS)]


def test_pairs_of_all_rows(spark, tables):
    pairs = [(fold(a or ""), fold(b or "")) for a, b in zip(TEXTS, TEXTS[1:])]
    em = {r.item_id: r.em for r in QUERIES["exact_match_pairs"](spark, tables).collect()}
    assert em == {i: float(a == b) for i, (a, b) in enumerate(pairs)} and sum(em.values()) == 2
    got = {r.item_id: (r.f1, r.precision, r.recall) for r in QUERIES["token_f1_pairs"](spark, tables).collect()}
    assert got == {i: pytest.approx(prf(a, b), abs=1e-6) for i, (a, b) in enumerate(pairs)}


def test_bootstrap_draws_as_often_as_the_reference(spark, sf):
    assert QUERIES["paired_bootstrap"](spark, sf).first().bootstrap_samples == 5000
