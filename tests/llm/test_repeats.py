import random

from strandset.llm.repeats import units, without_repeats


def brute(docs, run_words=20):
    seen, out = set(), []
    for t in docs:
        parts, later = units(t) if t else [], []
        for u in parts:
            k = " ".join(w.decode() for w in u.encode().lower().split())
            later.append(bool(k) and k in seen)
            if k:
                seen.add(k)
        kept, at = [], 0
        while at < len(parts):
            end = at
            while end < len(parts) and later[end] == later[at]:
                end += 1
            if not (later[at] and sum(len(u.encode().split()) for u in parts[at:end]) >= run_words):
                kept += parts[at:end]
            at = end
        out.append("".join(kept) if t is not None else None)
    return out


def test_units_make_up_the_text():
    for t in ("", "a. b\n\nc? d", "  x", "...!", "3.5 a b\r\n", "é. Ü"):
        assert "".join(units(t)) == t


def test_against_brute_force(spark):
    r = random.Random(2)
    stock = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(1, 12))) + r.choice([". ", "\n", "! "]) for _ in range(25)]
    docs = ["".join(r.choice(stock) for _ in range(r.randint(0, 12))) for _ in range(80)] + [None, "", "\n", "x y. " * 3000]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, digest int").repartition(3)
    got = without_repeats(rows, keep=("digest",)).orderBy("doc_id").collect()
    assert [g.text for g in got] == brute(docs)
    for g, t in zip(got, docs):
        chars, at, kept = t or "", 0, []
        for s in g.removed:
            kept.append(chars[at : s.start])
            at = s.end
        assert "".join([*kept, chars[at:]]) == (g.text or "")


def test_passage_inside_a_line_goes_and_short_sentences_stay(spark):
    passage = "It has one long sentence of words. " + "Then " + " ".join(f"w{i}" for i in range(50)) + ". "
    docs = [f"First one here. {passage}End.", f"Other start. {passage}Last.", "End. End."]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    assert [r.text for r in without_repeats(rows).orderBy("doc_id").collect()] == [docs[0], "Other start. Last.", "End. End."]


def test_empty_table_and_equal_rows(spark):
    rows = spark.createDataFrame([(1, "a b c. " * 30), (1, "a b c. " * 30), (None, "q"), (None, None)], "doc_id long, text string")
    assert without_repeats(rows.limit(0)).count() == 0
    got = without_repeats(rows).collect()
    assert sorted(str(r.text) for r in got) == ["None", "a b c. ", "a b c. ", "q"]


def test_later_whole_lines_go_whatever_their_length(spark):
    docs = ["Share this page\nOne text here.\nLast. Word", "Share  this PAGE\nOther. Last.\nShare this page\nOne text here. More", "Last. Word", "\n\nNew.\nNew.\n", "One. Two.\nTwo. One.\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    got = without_repeats(rows, whole_lines=True).orderBy("doc_id").collect()
    assert [r.text for r in got] == [docs[0], "Other. Last.\nOne text here. More", "", "\n\nNew.\n", docs[4]]
    assert [r.n_removed for r in got] == [0, 2, 2, 1, 0]
    assert [(s.start, s.end) for s in got[1].removed] == [(0, 17), (30, 46)]


def test_no_line_stays_twice(spark):
    r = random.Random(4)
    stock = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) + r.choice([".\n", "\n", "! b.\n"]) for _ in range(40)]
    rows = spark.createDataFrame([(i, "".join(r.choice(stock) for _ in range(9))) for i in range(60)], "doc_id long, text string").repartition(3)
    lines = lambda texts: [" ".join(x.split()) for t in texts for x in t.split("\n") if x.strip()]
    before, after = lines(x.text for x in rows.collect()), lines(x.text for x in without_repeats(rows, whole_lines=True).collect())
    assert len(after) == len(set(after)) == len(set(before)) < len(before)
