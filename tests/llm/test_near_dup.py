import random

from strandset.llm.common import Scratch
from strandset.llm.components import components
from strandset.llm.near_dup import near_duplicates


def brute(docs):
    sets = []
    for t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(docs)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                comp[y] = x
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def made(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") + r.choice("qrstuv")
    docs = [None, "", " \n", "one two", "One  two", "a b c d", "a b c d e"]
    for _ in range(25):
        base = [word() for _ in range(r.randint(5, 200))]
        for _ in range(r.randint(1, 14)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 30))):
                copy[r.randrange(len(copy))] = word()
            docs.append(" ".join(copy) if r.random() < 0.8 else " ".join(copy).upper())
    docs.append("long text " * 20000)
    r.shuffle(docs)
    return docs


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = made(seed)
        rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, n string")
        got = near_duplicates(rows).orderBy("doc_id").collect()
        assert [(r.n_shingles, r.component_id) for r in got] == brute(docs)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_group_of_near_copies(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(9999)}" for _ in range(120)]
    docs = []
    for _ in range(300):
        copy = list(base)
        for _ in range(r.randint(1, 4)):
            copy[r.randrange(len(copy))] = f"v{r.randrange(9999)}"
        docs.append(" ".join(copy))
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert [(x.n_shingles, x.component_id) for x in near_duplicates(rows).orderBy("doc_id").collect()] == brute(docs)


def test_components_of_a_long_path(spark):
    r = random.Random(3)
    names = r.sample(range(1000), 60)
    edges = [(names[i], names[i + 1]) for i in range(39)] + [(names[i], names[40]) for i in range(41, 60)]
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "c").collect()}
    assert got == {n: min(names[:40]) for n in names[:40]} | {n: min(names[40:]) for n in names[40:]}


def test_empty_table_null_and_equal_ids(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A b c d e f")], "doc_id long, text string")
    assert near_duplicates(rows.limit(0)).count() == 0
    got = near_duplicates(rows).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("3", "3", True), ("3", "3", True), ("9", "3", False), ("None", "None", True)]
