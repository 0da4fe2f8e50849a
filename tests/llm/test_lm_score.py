import math
import zlib
from collections import Counter

import numpy as np

import strandset.llm.lm_score as lm
from strandset.llm.lm_score import BEGIN, END, MEMBERS, RARE, STRIDE, SYMBOLS, WIDTH, WINDOW, Attention, Symbols, lm_scores, score_streams, train


_fit = lm.fit


def base(rows):
    cut = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not held(i) for w in cut(t))
    n, v = sum(count.values()), len(count)
    return {i: (held(i), len(cut(t)), sum(count[w] > 0 for w in cut(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in cut(t))) for i, t in rows}


def test_counts_and_scores(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(1000, None), (1001, ""), (1002, "É \xa0 \x1f <|endoftext|> 中文 " * 3), (1003, "word " * 40000), (None, "null key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score")
    got = {r.doc_id: r for r in lm_scores(df, steps=20).collect()}
    want = base(rows)
    assert got.keys() == want.keys()
    for i, (held, n, known, total, b) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and math.isclose(r.base_score, b, rel_tol=1e-9) and r.score < 0


def test_held_out_texts_are_likelier_than_by_word_counts(spark, sf):
    df = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    out = lm_scores(df).where("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def plain_logprob(model, symbols):
    """Log-probability of the last symbol after those before it in one window, by the formulas, one place after another."""
    w = {k: v.astype(float) for k, v in model.w.items()}
    e = [w["emb"][x] + w["pos"][i] for i, x in enumerate(symbols[:-1])]
    q = np.split(e[-1] @ w["qkv"], 3)[0]
    weights = [math.exp(min(60.0, q @ np.split(x @ w["qkv"], 3)[1] / math.sqrt(WIDTH))) for x in e]
    taken = sum(a * np.split(x @ w["qkv"], 3)[2] for a, x in zip(weights, e)) / sum(weights)
    h = np.tanh((e[-1] + taken) @ w["h"] + w["hb"])
    cls, member = divmod(int(symbols[-1]), MEMBERS)
    c, m = h @ w["c"] + w["cb"], h @ w["m"][cls] + w["mb"][cls]
    return c[cls] - math.log(np.exp(c).sum()) + m[member] - math.log(np.exp(m).sum())


def plain_score(model, stream):
    """Each symbol in the first window that holds it, windows STRIDE apart."""
    given = [BEGIN, *stream]
    out = 0.0
    for t in range(len(stream)):
        first = 0 if t < WINDOW else -(-(t + 1 - WINDOW) // STRIDE) * STRIDE
        out += plain_logprob(model, given[first : t + 2])
    return out


def test_scores_equal_those_of_a_plain_model(spark, monkeypatch):
    """Tokens by the library word by word, probabilities by the formulas."""
    import regex
    from tokenizers import Tokenizer

    from strandset.llm.tokens import tokenizer_path

    made = []
    monkeypatch.setattr(lm, "fit", lambda *a, **k: made.append(_fit(*a, **k)) or made[-1])
    r = np.random.default_rng(4)
    words = ["green", "house", "Über", "ÉTÉ", "river,", "x" * 30, "a.b.c", "中文", "of", "the"]
    rows = [(i, " ".join(r.choice(words, int(n)))) for i, n in enumerate([1, 3, 20, 60, 150, 33, 47, 48, 90])] + [(20, None), (21, ""), (22, "of the"), (22, "of the"), (None, "unseen words \x00 \xa0")]
    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), steps=15).collect()
    model, symbols = made[0]
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    top = len(symbols.symbol) - 2

    def score(text):
        text = regex.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        ids, case = [], 0.0
        for word in regex.findall(r"[^\x20\x09-\x0D]+", text):
            ids += tokenizer.encode(word, add_special_tokens=False).ids or [top + 1]
            if not word.isascii():
                case += sum(math.log(0.97 if c.lower() == c else 0.03) for c in word if not c.isascii() and (c.lower() != c or c.upper() != c))
        ids.append(top)
        return (plain_score(model, symbols.symbol[ids].tolist()) + symbols.left[ids].sum() + case) / math.log(10)

    want = {}
    for i, t in rows:
        want.setdefault(i, score(t))
    assert len(got) == len(rows)
    for x in got:
        assert math.isclose(x.score, want[x.doc_id], rel_tol=2e-4), x


def test_ids_of_one_symbol_share_it_by_their_counts():
    counts = np.concatenate([np.arange(3000, 0, -1), [7, 0]]).astype(float)
    s = Symbols(counts)
    rare = s.symbol == RARE
    assert rare.sum() == 3002 - (SYMBOLS - 3) - 1 and s.symbol[3000] == END and abs(np.exp(s.left[rare]).sum() - 1) < 1e-12
    assert (s.left[~rare] == 0).all() and s.counts.sum() - s.counts[BEGIN] == counts.sum()


def test_each_symbol_is_scored_once_by_its_window():
    r = np.random.default_rng(1)
    model = Attention(3)
    lengths = [1, 5, WINDOW, WINDOW + 1, 200]
    stream = r.integers(1, SYMBOLS, sum(lengths))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    got = score_streams(model, stream, ends)
    assert np.count_nonzero(got) == len(stream)
    for d in range(len(lengths)):
        s = stream[ends[d] : ends[d + 1]].tolist()
        assert math.isclose(plain_score(model, s), got[ends[d] : ends[d + 1]].sum(), rel_tol=1e-4)


def test_probabilities_add_up_and_training_learns():
    model = train([np.array([5, 6, 7, 8] * 50 + [END])] * 20, steps=150)
    x = np.array([[BEGIN] + [5, 6, 7, 8] * 5 + [5, 6, 7]])
    h = model.hidden(x)
    p = np.exp(model.logprob(np.repeat(h[:, 20], SYMBOLS, 0), np.arange(SYMBOLS)))
    assert abs(p.sum() - 1) < 1e-3 and p.argmax() == 5 + 20 % 4 and p.max() > 0.8


def test_gradients():
    model, r = Attention(2), np.random.default_rng(3)
    x, y = r.integers(0, SYMBOLS, (2, WINDOW)), r.integers(0, SYMBOLS, (2, WINDOW))
    x[1, 5] = x[0, 3]
    model.flat = model.flat.astype(np.float64)
    model._name()
    named = model.views(np.zeros_like(model.flat))
    model.gradient(x, y, named)

    def loss():
        return -model.logprob(model.hidden(x).reshape(-1, WIDTH), y.reshape(-1)).mean()

    for name, at in (("qkv", (1, 2)), ("qkv", (3, 40)), ("qkv", (0, 70)), ("h", (2, 2)), ("hb", 3), ("emb", (int(x[0, 3]), 1)), ("pos", (4, 4)), ("c", (3, int(y[0, 0]) // MEMBERS)), ("cb", 1), ("m", (int(y[0, 1]) // MEMBERS, 2, 3)), ("mb", (int(y[0, 1]) // MEMBERS, 5))):
        model.w[name][at] += 1e-5
        up = loss()
        model.w[name][at] -= 2e-5
        assert math.isclose((up - loss()) / 2e-5, named[name][at], rel_tol=2e-2, abs_tol=1e-6), name
        model.w[name][at] += 1e-5


def test_empty_table_and_no_training_rows(spark):
    df = spark.createDataFrame([(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert lm_scores(df.limit(0)).count() == 0
    out = lm_scores(df.selectExpr("*", "'x' AS block", "1 AS held")).collect()
    assert {(r.n_known, r.train_tokens) for r in out} == {(0, 0)} and len({r.score for r in out}) == 1


def test_all_training_documents_are_learned(spark, monkeypatch):
    """Words and order that only documents outside the starting sample hold."""
    from strandset.llm.tokens import encoder, tokenizer_path

    path = tokenizer_path("word_bpe_49k.json")
    other = "green house small river " * 400
    monkeypatch.setattr(lm, "TAKEN", 64)
    rows = spark.createDataFrame([(i, False, "one two " * 20 if k == 0 else other) for k, i in enumerate(range(400))], "id long, held boolean, text string").repartitionByRange(4, "id")

    def loss(rounds):
        parts = lm.blocks(rows, path, 4).cache()
        model, symbols = _fit(parts, encoder(path).ids_in_all, steps=5, **rounds)
        ids = [x for w in "green house small river".split() for x in encoder(path).tokenizer.encode(w).ids]
        stream = np.tile(symbols.symbol[ids], 10)
        assert RARE not in stream
        return -score_streams(model, stream, np.array([0, len(stream)])).mean()

    assert loss({}) < loss({"rounds": 0}) - 0.5


def test_symbols_of_later_windows_see_what_stands_well_before():
    r, model = np.random.default_rng(5), Attention(3)
    stream = r.integers(3, SYMBOLS, 160)
    ends = np.array([0, len(stream)])
    plain = score_streams(model, stream, ends)
    for t in range(24, 160):
        other = stream.copy()
        other[t - 20] = 3 + (stream[t - 20] + 7) % (SYMBOLS - 3)
        assert score_streams(model, other, ends)[t] != plain[t], t


def test_counts_are_added_in_any_number_of_buckets(spark):
    from strandset.llm.tokens import tokenizer_path

    rows = spark.createDataFrame([(i, False, f"a b{i % 5} c{i}") for i in range(50)], "id long, held boolean, text string").repartition(3)
    parts = lm.blocks(rows, tokenizer_path("word_bpe_49k.json"), 4).cache()
    for bits in (0, 1, 5, 9):
        got = lm.totals(parts, bits).where("block is null").selectExpr("sum(v)", "sum(n)", "count(*)").first()
        assert tuple(got)[:2] == (1 + 5 + 50 + 1, 200) and got[2] <= 2**bits
