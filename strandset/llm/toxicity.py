"""Toxicity by weak supervision (operator 10).

1. Lexicon voters: words, word beginnings of 3 to 9 letters, and beginnings met twice in a text, that turn up in toxic
   training texts beyond chance (a tail bound at 0.1 over all candidates; of voters that always agree one stays, and
   of the rest the VOTERS strongest). Pattern voters: shouting, repeated marks, a text of few different words.
2. Label model: a hidden label, one rate of voting for either value of it by voter, and a noise rate for the given label,
   fitted by expectation-maximisation. Voters that agree more than the label explains (partial correlation above
   TIED) are one voter of the model, so that nested beginnings aren't counted several times.
3. A linear (logistic) classifier on the votes is trained on the posterior labels and scores texts from their words alone.

The model is fitted on at most ``sample`` labelled rows with crc32(id as text) mod 4 other than 2, those with the lowest
hash of their id; near copies among them count once. Everything else covers all rows in one map-side pass.

Null and empty texts get the score of a text without votes; without labelled rows, or with one label only, every score is
the (smoothed) share of toxic rows; labels that are null are ignored; a row with a null id is scored; repeated rows
are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandset.llm.common import Scratch, arrow_column, lean
from strandset.llm.tokens import text_slices

SAMPLE = 20_000
BEGINNINGS = range(3, 10)
VOTERS = 512
TIED = 0.5
HELD = 1 << 17  # candidates that a task counts before it reports
PATTERNS = ("shouting", "marks", "few words")


def candidates(piece: str) -> set[str]:
    """Words of a white-space-separated piece and their beginnings (written with a trailing *; with two: met twice)."""
    import re

    out = set()
    for w in re.findall(r"\w+", piece.lower()):
        out.add(w)
        out.update(w[:n] + "*" for n in BEGINNINGS if len(w) >= n)
    return out


def patterns(text: str, n_words: int, n_distinct: int) -> list[int]:
    letters = max(1, len(text))
    upper = sum(map(str.isupper, text)) if n_words else 0
    marks = text.count("!") + text.count("?")
    return [i for i, hit in enumerate((upper * 2 > letters, marks * 20 > letters, n_words >= 20 and n_distinct * 4 < n_words)) if hit]


def _pieces(column):
    """(distinct pieces, number of the piece at each place, places before each text)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.fill_null(column, "").cast(pa.large_string()))
    told = lists.flatten().dictionary_encode()
    ends = np.asarray(lists.offsets)
    return told.dictionary.to_pylist(), np.asarray(told.indices), ends - ends[0]


class Votes:
    """Finds the voters (numbered in ``lexicon``; patterns come after them) of the texts of a column."""

    def __init__(self, lexicon: list[str]):
        self.once = {w: i for i, w in enumerate(lexicon) if not w.endswith("**")}
        self.twice = {w[:-1]: i for i, w in enumerate(lexicon) if w.endswith("**")}
        self.first_pattern = len(lexicon)

    def __call__(self, column) -> list[list[int]]:
        import numpy as np

        pieces, at, ends = _pieces(column)
        once, twice = self.once, self.twice
        found: dict[int, list[str]] = {}
        for i, p in enumerate(pieces):
            if hits := [c for c in candidates(p) if c in once or c in twice]:
                found[i] = hits
        mark = np.zeros(len(pieces) + 1, dtype=bool)
        mark[list(found)] = True
        places = np.flatnonzero(mark[at]) if len(at) else np.zeros(0, int)
        doc = np.searchsorted(ends, places, side="right") - 1
        votes: list[set] = [set() for _ in range(len(ends) - 1)]
        seen: dict[int, set] = {}
        for d, p in zip(doc.tolist(), at[places].tolist()):
            own = seen.setdefault(d, set())
            for c in found[p]:
                votes[d].add(once.get(c))
                if c in own:
                    votes[d].add(twice.get(c))
                own.add(c)
            votes[d].discard(None)
        lengths = np.diff(ends)
        for d, text in enumerate(column.to_pylist()):
            if text:
                a, b = ends[d], ends[d + 1]
                n = int(lengths[d])
                distinct = len(np.unique(at[a:b])) if n >= 20 else n
                votes[d].update(self.first_pattern + k for k in patterns(text, n, distinct))
        return [sorted(v) for v in votes]


def _counts(rows: DataFrame) -> DataFrame:
    """(what, toxic, clean): in how many toxic and clean rows a candidate occurs; what is null for all rows."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        both = (Counter(), Counter())
        known: dict[str, set] = {}

        def told():
            what = list(both[0].keys() | both[1].keys())
            counts = [pa.array([c[w] for w in what], pa.int64()) for c in both]
            both[0].clear(), both[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(what, pa.string()), *counts], ["what", "toxic", "clean"])

        for batch in batches:
            labels = batch.column(1).to_pylist()
            for row, part in text_slices(batch.column(0), 1 << 20):
                pieces, at, ends = _pieces(part)
                for d, label in enumerate(labels[row : row + len(part)]):
                    own: Counter = Counter()
                    for p, times in Counter(at[ends[d] : ends[d + 1]].tolist()).items():
                        if (c := known.get(pieces[p])) is None:
                            c = candidates(pieces[p])
                            if len(known) < 1 << 14:
                                known[pieces[p]] = c
                        for x in c:
                            own[x] += times
                    both[1 - label].update(own.keys())
                    both[1 - label].update(x + "*" for x, times in own.items() if times > 1 and x.endswith("*"))
                    both[1 - label][None] += 1
                    if len(both[0]) + len(both[1]) > HELD:
                        yield told()
        yield told()

    told = rows.select("text", "label").mapInArrow(lean(run), "what string, toxic long, clean long")
    return told.groupBy("what").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _first_copies(rows: DataFrame) -> DataFrame:
    """The ids of the bounded sample (id, text) less near copies: of rows that share a band of minima, those go whose signature shows
    a similarity of 0.75 or more with the first of them (by the hash of the id). Texts without words are no copies."""
    from strandset.llm.near_dup import estimate, signatures

    signed = Scratch(rows.sparkSession, "toxicity-copies").keep(signatures(rows).where("n > 0").select("id", "n", "bands", "planes"), "signed")
    banded = signed.select("id", F.explode("bands").alias("key"))
    first = banded.groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("first"), F.count("*").alias("m")).where("m > 1")
    pairs = banded.join(first.select("key", F.col("first.id").alias("a")), "key").where("id != a").select("a", F.col("id").alias("b")).distinct()
    of = lambda name: signed.select(F.col("id").alias(name), F.struct("n", "planes").alias(f"s{name}"))
    gone = pairs.join(of("a"), "a").join(of("b"), "b").where(estimate("sa", "sb") >= 0.75).select(F.col("b").alias("id")).distinct()
    return rows.select("id").distinct().join(gone, "id", "left_anti")


def lexicon(counts: DataFrame, toxic: int, clean: int) -> list[str]:
    """Candidates whose share of toxic rows is above chance by a tail bound over all candidates (seen three times or more)."""
    rate = toxic / (toxic + clean)
    seen = counts.where("what is not null and toxic + clean >= 3")
    m = seen.count()
    n, p = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    other = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - rate))).otherwise(0.0)
    seen = seen.where((p > 0.5) & (p > rate)).withColumn("strength", n * (p * F.log(p / rate) + other))
    strong = seen.where(F.col("strength") >= F.log(F.lit(10.0 * max(1, m)))).orderBy(F.desc("strength"), F.desc(F.length(F.regexp_replace("what", r"\*", ""))), F.length("what"), "what").limit(4 * VOTERS)
    return [r[0] for r in strong.select("what").collect()]


def distinct_voters(told: list, k: int) -> list[int]:
    """The first of each set of voters that vote alike on all rows; of the lexicon the first VOTERS, and the patterns."""
    by: dict[int, list[int]] = {}
    for i, r in enumerate(told):
        for v in r.votes:
            by.setdefault(v, []).append(i)
    seen, out = set(), []
    for v in range(k):
        if (key := tuple(by.get(v, ()))) not in seen and key:
            seen.add(key)
            out.append(v)
    return [v for v in out if v < k - len(PATTERNS)][:VOTERS] + [*range(k - len(PATTERNS), k)]


def label_model(votes, labels, rounds: int = 50):
    """(posterior of the hidden label, groups of tied voters). ``votes``: 0/1 array of rows by voters."""
    import numpy as np

    rows, k = votes.shape
    post = np.where(labels == 1, 0.95, 0.05)

    def groups_of(post):
        v = votes - np.where(post[:, None] > 0.5, votes[post > 0.5].mean(0) if (post > 0.5).any() else 0, votes[post <= 0.5].mean(0) if (post <= 0.5).any() else 0)
        norm = np.sqrt((v * v).sum(0)) + 1e-12
        tied = (v.T @ v) / norm[:, None] / norm[None, :] > TIED
        group = np.full(k, -1)
        for i in range(k):
            if group[i] < 0:
                group[i], todo = i, [i]
                while todo:
                    for j in np.flatnonzero(tied[todo.pop()] & (group < 0)):
                        group[j] = i
                        todo.append(j)
        return np.unique(group, return_inverse=True)[1]

    group = groups_of(post)
    fired = np.zeros((rows, group.max() + 1 if k else 0))
    for j in range(k):
        fired[:, group[j]] = np.maximum(fired[:, group[j]], votes[:, j])
    for _ in range(rounds):
        w1, w0 = post.sum() + 1e-9, (1 - post).sum() + 1e-9
        share = (w1 + 1) / (rows + 2)
        a, b = (post @ fired + 0.5) / (w1 + 1), ((1 - post) @ fired + 0.5) / (w0 + 1)
        right = np.clip(((post * labels).sum() + (1 - post) @ (1 - labels) + 9.5) / (rows + 10), 0.5, 1 - 1e-3)
        odds = np.log(share / (1 - share)) + fired @ np.log(a / b) + (1 - fired) @ np.log((1 - a) / (1 - b)) + (2 * labels - 1) * np.log(right / (1 - right))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post, group


def logistic(x, target, penalty: float = 1e-3, rounds: int = 30):
    """Weights (last: constant) of a logistic regression on soft labels, by Newton steps."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty * len(x) ** 0.5)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (target - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, words: list[str], weights: list[float], constant: float):
        self.words, self.weights, self.constant = words, weights, constant

    def scores(self, votes: list[list[int]]) -> list[float]:
        from math import exp

        out = []
        for v in votes:
            z = self.constant + sum(self.weights[k] for k in v if k < len(self.weights))
            out.append(1 / (1 + exp(-max(-30.0, min(30.0, z)))))
        return out


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model, from at most ``sample`` labelled rows of the training part."""
    import numpy as np

    spark = docs.sparkSession
    given = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    given = given.where(F.crc32(F.col("id").cast("string")) % 4 != 2).groupBy("id").agg(F.max("label").alias("label"))
    given = given.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(given), "id").dropDuplicates(["id", "text"])
    scratch = Scratch(spark, "toxicity")
    rows = scratch.keep(rows, "sample")
    rows = scratch.keep(rows.join(F.broadcast(_first_copies(rows)), "id"), "distinct")  # at most ``sample`` ids
    counts = scratch.keep(_counts(rows), "counts")
    total = counts.where("what is null").first()
    toxic, clean = (total.toxic, total.clean) if total else (0, 0)
    if not toxic or not clean:
        share = (toxic + 1) / (toxic + clean + 2)
        return Model([], [], float(np.log(share / (1 - share))))
    words = lexicon(counts, toxic, clean)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Votes(words)
        for batch in batches:
            votes = [v for _, part in text_slices(batch.column(0), 1 << 20) for v in own(part)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(votes, pa.list_(pa.int32()))], ["label", "votes"])

    told = rows.select("text", "label").mapInArrow(lean(run), "label int, votes array<int>").collect()
    told.sort(key=lambda r: (r.label, r.votes))
    chosen = distinct_voters(told, len(words) + len(PATTERNS))
    place = {v: i for i, v in enumerate(chosen)}
    matrix = np.zeros((len(told), len(chosen)), dtype=np.float32)
    for i, r in enumerate(told):
        matrix[i, [place[v] for v in r.votes if v in place]] = 1
    post, _ = label_model(matrix, np.array([r.label for r in told]))
    w = logistic(matrix, post)
    return Model([words[v] for v in chosen if v < len(words)], w[:-1].tolist(), float(w[-1]))


def toxicity(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), least: float = 0.3) -> DataFrame:
    """Rows (id, held_out, score, predicted, *keep)."""

    def run(columns: Iterator) -> Iterator:
        import pyarrow as pa

        own = Votes(model.words)
        for column in columns:
            yield pa.array([s for _, part in text_slices(column, 1 << 20) for s in model.scores(own(part))], pa.float64())

    held = F.coalesce(F.crc32(F.col(id).cast("string")) % 4 == 2, F.lit(False))
    # not deterministic for the optimizer, so that a filter on the score doesn't call the function again
    score = arrow_column(run, "double").asNondeterministic()(F.col(text).cast("string"))
    kept = docs.select(F.struct(F.col(id).alias("id"), held.alias("held"), *[F.col(c) for c in keep]).alias("kept"), score.alias("score"))
    return kept.select(
        F.col("kept.id").alias(id), F.col("kept.held").alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), *[F.col(f"kept.{c}").alias(c) for c in keep]
    )
