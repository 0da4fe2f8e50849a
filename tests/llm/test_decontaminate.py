import hashlib
import random
import re

from strandset.llm.decontaminate import contamination, judged, without_spans


def brute(docs, items, n=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in docs:
        w, hit, own = cut(t), set(), []
        for item, it in items:
            iw, found = cut(it), False
            size = min(n, len(iw))
            for a in range(len(iw) - size + 1 if iw else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == iw[a : a + size]:
                        hit |= {*range(p, p + size)}
                        found = True
            if found:
                own.append(str(item))
        own = sorted(own)
        out.append((len(w), len(hit), len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def made(seed=3):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "B", "c9", "é", "Ünd", "xx"])
    text = lambda n: r.choice(["", " ", "-"]) + r.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    items = [(i * 7, text(r.choice([0, 1, 3, 12, 13, 14, 30]))) for i in range(12)] + [(5, None), (6, "..."), (999, "zz " * 40)]
    docs = [text(r.randint(0, 60)) for _ in range(40)] + [None, "", "zz " * 39 + "q", "plain", "plain", "a " * 30000]
    docs += [docs[3] + " " + (items[6][1] or "") for _ in range(3)]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id long, text string, n_words string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def test_against_brute_force_in_one_part_and_many(spark):
    docs, items = made()
    d, b = frames(spark, docs, items)
    short = [(i, t) for i, t in items if t is None or len(t.split()) != 1]
    for some in (items, short):
        b = frames(spark, docs, some)[1]
        want = brute(docs, some)
        for part in (8 << 20, 100):
            got = judged(contamination(d, b, part=part)).orderBy("doc_id").collect()
            assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == want


def test_spans_are_cut_out(spark):
    item = " ".join(f"w{i}" for i in range(13))
    d, b = frames(spark, [f"Before, {item.upper()}! After it.", "clean"], [(1, item)])
    found = contamination(d.drop("n_words"), b, keep=("text",))
    assert [r.text for r in without_spans(found, "text").orderBy("doc_id").collect()] == ["Before, After it.", "clean"]


def test_empty_tables(spark):
    d, b = frames(spark, ["a b"], [(1, "a")])
    assert contamination(d.limit(0), b).count() == 0
    row = judged(contamination(d, b.limit(0))).first()
    assert (row.n_hit, row.contaminated, row.n_items) == (0, False, 0)
