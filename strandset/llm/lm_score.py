"""Language-model scores by a causal self-attention model on subword ids (operator 4).

Words: texts are lower-cased (A-Z) and cut at ASCII white space; each text ends with one end token. Documents are read once
into blocks (BLOCK bytes of text): the distinct words of a block in the order of their 64-bit hash with their training counts
and their subword ids, and each document as places in that list. Everything after that reads blocks.

Counts: blocks send the counts of their words, cut by hash range, to buckets; a bucket adds them up and answers each
block. So only distinct words of blocks are shuffled, a frequent word no more often than there are blocks, and no word
table is ever broadcast or collected. There are as many buckets as make a bucket about BUCKET bytes, whatever the corpus.
The counts give the base score and n_known, and have no part in ``score``.

Model: one causal head with a residual, a tanh layer and a softmax by class and member, trained in numpy. Its symbols are the
SYMBOLS - 3 most frequent ids of all training documents; the other ids share one, and stand in it by their own training counts.
``steps`` steps on a sample (TAKEN symbols of STARTERS blocks at most) give it a start, no more; then every symbol of every
training document is a target once. Blocks are dealt by hash to ROUNDS rounds; in a round each task learns its blocks with a
copy of the model, and the copies are averaged by the windows that they learned: work grows with the corpus, memory doesn't.

Scoring cuts a text into windows of WINDOW symbols that overlap by half; a batch of masked attention scores each symbol once,
in the first window of a text all, in the others the last STRIDE, so a symbol sees WINDOW - STRIDE symbols at least where the
text has them. ``score`` is the sum of the log10 probabilities of a text's symbols (and of its upper-case non-ASCII
letters, which the ids don't tell) up to its end.

Null and empty texts have the end token alone; without training documents counts are 0 and the model is uniform; a null id
counts as training; repeated rows are scored alike; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandset.llm.common import Scratch, keep_freed, lean
from strandset.llm.tokens import encoder, text_slices, tokenizer_path

BLOCK = 1 << 20
BUCKET = 8 << 20  # bytes of hashes and counts
CACHE = 128 << 20  # bytes of one generation of a worker's token cache
SYMBOLS, MEMBERS = 2048, 43  # symbols; members of a class at most
BEGIN, END, RARE = 0, 1, 2
WINDOW, STRIDE, WIDTH = 48, 24, 32
STARTERS, TAKEN = 16, 1 << 20  # blocks and symbols of the starting sample
STEPS, BATCH = 800, 128
ROUNDS, RATE = 4, 0.006  # of the pass over all training documents
GROUPS = 16  # partial sums that the driver adds
SPAN = 1 << 18  # symbols that a task holds at once, beside those of one document
LOWER = 0.97  # chance that a non-ASCII letter stands in lower case
END_WORD = b" end"  # holds a space, so no word has its hash


def _numbered(column):
    """(distinct words, number of the word at each place, places before each text) of an Arrow column of texts."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "").cast(pa.large_string())))
    flat = lists.flatten()
    there = np.asarray(pc.greater(pc.binary_length(flat), 0)) if len(flat) else np.zeros(0, bool)
    ends = np.asarray(lists.offsets)
    ends = np.concatenate([[0], np.cumsum(there)])[ends - ends[0]]
    told = flat.filter(pa.array(there)).dictionary_encode()
    return told.dictionary.cast(pa.large_binary()).to_pylist(), np.asarray(told.indices).astype(np.int64), ends


def _case(word: bytes) -> float:
    """Log-probability of the upper-case non-ASCII letters of a word, which the tokenizer's ids don't tell."""
    from math import log

    if word.isascii():
        return 0.0
    letters = [c for c in word.decode("utf-8", "replace") if not c.isascii() and (c.lower() != c or c.upper() != c)]
    return sum(log(LOWER if c.lower() == c else 1 - LOWER) for c in letters)


def blocks(rows: DataFrame, path: str, rounds: int) -> DataFrame:
    """(block, round, words, ids, held, sizes, places, hashes, counts, parts, lengths, case) of the rows (id, held, text).

    ``words``: number of distinct words; ``parts`` and ``lengths``: their ids one after another, and how many each has (the
    end token and a word that the tokenizer gives no id have one number above all ids each)."""
    top = encoder(path).ids_in_all

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from xxhash import xxh3_64_intdigest as digest

        own, k = encoder(path), TaskContext.get().partitionId() << 32
        own.kept = CACHE
        marks = [np.array([top + i], dtype="<u4").tobytes() for i in range(2)]
        for batch in batches:
            for row, part in text_slices(batch.column(2), BLOCK):
                words, at, ends = _numbered(part)
                words.append(END_WORD)
                h = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
                order = np.argsort(h, kind="stable")
                new = np.empty(len(order), dtype=np.int64)
                new[order] = np.arange(len(order))
                at = np.insert(new[at], ends[1:], new[-1])
                sizes = np.diff(ends) + 1
                held = np.array([bool(x) for x in batch.column(1).slice(row, len(part)).to_pylist()])
                counts = np.bincount(at[np.repeat(~held, sizes)], minlength=len(words)).astype(np.uint32)
                words = [words[i] for i in order.tolist()]
                values = [v or marks[1] for v in own._values(words)]
                values[new[-1]] = marks[0]
                lengths = np.fromiter(map(len, values), dtype=np.uint32, count=len(values)) // 4
                lengths = lengths.astype(np.uint8) if lengths.max() < 256 else lengths
                case = np.fromiter(map(_case, words), dtype=np.float32, count=len(words))
                blobs = (
                    at.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32).tobytes(), h[order].tobytes(), counts.tobytes(),
                    np.frombuffer(b"".join(values), dtype="<u4").astype(np.uint16 if top + 2 <= 1 << 16 else np.uint32).tobytes(), lengths.tobytes(), case.tobytes() if case.any() else b"",
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), pa.array([digest(k.to_bytes(8, "little")) % max(1, rounds)], pa.int32()), pa.array([len(words)], pa.int64()),
                     pa.array([batch.column(0).slice(row, len(part)).to_pylist()], pa.list_(batch.column(0).type)), pa.array([held.tolist()], pa.list_(pa.bool_())),
                     pa.array([sizes.tolist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in blobs)],
                    ["block", "round", "words", "ids", "held", "sizes", "places", "hashes", "counts", "parts", "lengths", "case"],
                )
                k += 1

    kind = rows.schema["id"].dataType.simpleString()
    blobs = ", ".join(f"{x} binary" for x in ("places", "hashes", "counts", "parts", "lengths", "case"))
    return rows.mapInArrow(lean(run, encodes=True), f"block long, round int, words long, ids array<{kind}>, held array<boolean>, sizes array<long>, {blobs}")


class Block:
    """One row of ``blocks`` as arrays; ``top``: number of the tokenizer's ids."""

    def __init__(self, top: int, sizes, places: bytes, words: int, parts: bytes, lengths: bytes):
        import numpy as np

        self.lengths = np.frombuffer(lengths, dtype=np.uint8 if len(lengths) == words else np.uint32).astype(np.int64)
        self.sizes = np.asarray(sizes, dtype=np.int64)
        self.places = np.frombuffer(places, dtype=np.uint16 if len(self.lengths) <= 1 << 16 else np.uint32)
        self.ids = np.frombuffer(parts, dtype=np.uint16 if top + 2 <= 1 << 16 else np.uint32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.edges = np.concatenate([[0], np.cumsum(self.sizes)])

    def spans(self) -> Iterator[tuple[int, int]]:
        """Documents [first, end) of about SPAN symbols."""
        import numpy as np

        before, first = np.concatenate([[0], np.cumsum(self.lengths[self.places])])[self.edges], 0
        while first < len(self.sizes):
            end = max(first + 1, int(np.searchsorted(before, before[first] + SPAN, side="right")) - 1)
            yield first, end
            first = end

    def stream(self, symbols, first: int, end: int):
        """(symbols of the documents, symbols before each word and their total)."""
        import numpy as np

        at = self.places[self.edges[first] : self.edges[end]]
        n = self.lengths[at]
        before = np.concatenate([[0], np.cumsum(n)])
        return symbols[self.ids[np.repeat(self.starts[at] - before[:-1], n) + np.arange(before[-1])]], before


def totals(parts: DataFrame, bits: int) -> DataFrame:
    """(block, bucket, totals, v, n): for each block and hash range the corpus counts of its words; v and n (distinct words and
    tokens of the range) stand in one row of each range, with a null block."""

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                h = np.frombuffer(batch.column(1)[r].as_py(), dtype=np.uint64)
                c = np.frombuffer(batch.column(2)[r].as_py(), dtype=np.uint32)
                to = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
                edge = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(h)]
                own = [(int(to[s]), s, e) for s, e in zip(edge, edge[1:]) if e > s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, *_ in own], pa.int64()), pa.array([batch.column(0)[r].as_py()] * len(own), pa.int64()),
                     pa.array([h[s:e].tobytes() for _, s, e in own], pa.binary()), pa.array([c[s:e].tobytes() for _, s, e in own], pa.binary())],
                    ["bucket", "block", "hashes", "counts"],
                )

    sent = parts.select("block", "hashes", "counts").mapInArrow(lean(cut), "bucket long, block long, hashes binary, counts binary")
    sent = sent.repartition("bucket").sortWithinPartitions("bucket", "block")

    def add(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def answer(bucket, held):
            distinct, at = np.unique(np.concatenate([x[1] for x in held]), return_inverse=True)
            total = np.zeros(len(distinct), dtype=np.int64)
            ends = np.cumsum([0] + [len(x) for _, x, _ in held]).tolist()
            for (_, _, c), s, e in zip(held, ends, ends[1:]):  # the hashes of a block are distinct, but for words that share one
                np.add.at(total, at[s:e], c)
            kind = np.uint32 if total.max(initial=0) < 2**32 else np.uint64
            told = total[at].astype(kind)  # the first byte tells the width
            blobs = [bytes([kind().itemsize]) + told[s:e].tobytes() for s, e in zip(ends, ends[1:])]
            n = len(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([None] + [x[0] for x in held], pa.int64()), pa.array([bucket] * (n + 1), pa.int64()), pa.array([None, *blobs], pa.binary()),
                 pa.array([int((total > 0).sum())] + [0] * n, pa.int64()), pa.array([int(total.sum())] + [0] * n, pa.int64())],
                ["block", "bucket", "totals", "v", "n"],
            )

        now, held = None, []
        for batch in batches:
            for bucket, block, h, c in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and bucket != now:
                    yield answer(now, held)
                    held = []
                now = bucket
                held.append((block, np.frombuffer(h, dtype=np.uint64), np.frombuffer(c, dtype=np.uint32)))
        if held:
            yield answer(now, held)

    return sent.mapInArrow(lean(add), "block long, bucket long, totals binary, v long, n long")


class Attention:
    """One causal attention head with a residual and a tanh layer over symbols; softmax by class, then by member.

    All weights lie in one array, ``flat``; ``w`` has them by name."""

    def __init__(self, seed: int = 7, zero: bool = False):
        import numpy as np

        r, d, self.classes = np.random.default_rng(seed), WIDTH, -(-SYMBOLS // MEMBERS)
        self.flat = np.zeros(sum(int(np.prod(s)) for s in self.shapes().values()), dtype=np.float32)
        self._name()
        if not zero:
            scale = {"emb": 0.3, "pos": 0.05, "cb": 0, "mb": 0, "hb": 0}
            for n, x in self.w.items():
                x[:] = r.normal(0, scale.get(n, d**-0.5), x.shape)
        self.w["mb"][-1, SYMBOLS - MEMBERS * (self.classes - 1) :] = -1e9  # places without a symbol

    def shapes(self) -> dict[str, tuple]:
        d, c = WIDTH, -(-SYMBOLS // MEMBERS)
        return {"emb": (SYMBOLS, d), "pos": (WINDOW, d), "qkv": (d, 3 * d), "h": (d, d), "hb": (d,), "c": (d, c), "cb": (c,), "m": (c, d, MEMBERS), "mb": (c, MEMBERS)}

    def views(self, flat) -> dict:
        out, at = {}, 0
        for name, shape in self.shapes().items():
            size = 1
            for s in shape:
                size *= s
            out[name] = flat[at : at + size].reshape(shape)
            at += size
        return out

    def _name(self) -> None:
        import numpy as np

        self.w = self.views(self.flat)
        self.mask = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32))

    def __getstate__(self):
        return self.classes, self.flat

    def __setstate__(self, state):
        self.classes, self.flat = state
        self.flat = self.flat.copy()
        self._name()

    def _attended(self, e, rows: int):
        """(queries, keys, values, attention, what the last ``rows`` places take from the places before and theirs)."""
        import numpy as np

        b, t, d = e.shape
        qkv = self.w["qkv"]
        kv = (e.reshape(b * t, d) @ qkv[:, d:]).reshape(b, t, 2 * d)
        q = (np.ascontiguousarray(e[:, t - rows :]).reshape(b * rows, d) @ (qkv[:, :d] * np.float32(d**-0.5))).reshape(b, rows, d)
        a = q @ kv[..., :d].transpose(0, 2, 1)
        np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        a *= self.mask[t - rows : t, :t]
        a /= (a @ np.ones(t, dtype=a.dtype))[..., None]
        return q, kv[..., :d], kv[..., d:], a, a @ kv[..., d:]

    def hidden(self, x, rows: int | None = None):
        """Hidden values at the last ``rows`` places (all, if not given) of the windows x."""
        import numpy as np

        b, t = x.shape
        rows = rows or t
        e = self.w["emb"][x] + self.w["pos"][:t]
        u = self._attended(e, rows)[-1]
        u += e[:, t - rows :]
        out = u.reshape(b * rows, WIDTH) @ self.w["h"]
        out += self.w["hb"]
        return np.tanh(out, out=out).reshape(b, rows, WIDTH)

    def _bound(self) -> float:
        """No logit is larger, since hidden values lie in [-1, 1]."""
        import numpy as np

        w = self.w
        return max(float(np.abs(w["c"]).sum(axis=0).max() + w["cb"].max()), float((np.abs(w["m"]).sum(axis=1) + np.maximum(w["mb"], 0)).max()))

    @staticmethod
    def _exp(z, bound: float):
        """exp(z) in place, less its row's largest value where logits may be large; what was taken away."""
        import numpy as np

        top = 0.0
        if bound > 80:
            top = z.max(axis=1)
            z -= top[:, None]
        np.exp(z, out=z)
        return top

    def _members(self, hidden, target):
        """Rows by class: (order, edges of the classes, hidden values in order, member logits in order, members in order)."""
        import numpy as np

        cls = (target // MEMBERS).astype(np.uint16)
        order = np.argsort(cls, kind="stable")
        edge = np.searchsorted(cls[order], np.arange(self.classes + 1)).tolist()
        sorted_hidden = hidden[order]
        z = np.empty((len(target), MEMBERS), dtype=hidden.dtype)
        for c in range(self.classes):
            if edge[c] < edge[c + 1]:
                part = slice(edge[c], edge[c + 1])
                np.matmul(sorted_hidden[part], self.w["m"][c], out=z[part])
                z[part] += self.w["mb"][c]
        return order, edge, sorted_hidden, z, (target % MEMBERS)[order]

    def logprob(self, hidden, target):
        """Natural log-probabilities of the targets given the rows of ``hidden``."""
        import numpy as np

        bound, out = self._bound(), np.empty(len(hidden), dtype=hidden.dtype)
        for a in range(0, len(hidden), 1 << 14):
            h, y = hidden[a : a + (1 << 14)], target[a : a + (1 << 14)]
            lane = np.arange(len(h))
            z = h @ self.w["c"]
            z += self.w["cb"]
            chosen = z[lane, y // MEMBERS]
            top = self._exp(z, bound)
            own = chosen - top - np.log(z @ np.ones(z.shape[1], dtype=z.dtype))
            order, _, _, z, member = self._members(h, y)
            chosen = z[lane, member]
            top = self._exp(z, bound)
            own[order] += chosen - top - np.log(z @ np.ones(MEMBERS, dtype=z.dtype))
            out[a : a + (1 << 14)] = own
        return out

    def gradient(self, x, y, g: dict) -> float:
        """Mean loss on windows x with targets y; its gradient goes into ``g``."""
        import numpy as np

        w, (b, t), d, n = self.w, x.shape, WIDTH, x.size
        xf, yf, lane = x.reshape(n), y.reshape(n), np.arange(n)
        e = w["emb"][x] + w["pos"][:t]
        q, k, v, a, r = self._attended(e, t)
        ef, uf = e.reshape(n, d), r.reshape(n, d)
        uf = uf + ef
        h = uf @ w["h"]
        h += w["hb"]
        np.tanh(h, out=h)
        bound = self._bound()

        def soft(z, at):
            self._exp(z, bound)
            z /= (z @ np.ones(z.shape[1], dtype=z.dtype))[:, None]
            loss = -np.log(z[lane, at] + 1e-30).sum()
            z[lane, at] -= 1
            z *= z.dtype.type(1 / n)
            return loss

        z = h @ w["c"]
        z += w["cb"]
        loss = soft(z, yf // MEMBERS)
        np.matmul(h.T, z, out=g["c"])
        g["cb"][:] = z.sum(axis=0)
        dh = z @ w["c"].T
        order, edge, hs, z, member = self._members(h, yf)
        loss += soft(z, member)
        g["m"][:] = 0
        g["mb"][:] = 0
        back = np.empty_like(hs)
        for c in range(self.classes):
            if edge[c] < edge[c + 1]:
                part = slice(edge[c], edge[c + 1])
                np.matmul(hs[part].T, z[part], out=g["m"][c])
                g["mb"][c] = z[part].sum(axis=0)
                np.matmul(z[part], w["m"][c].T, out=back[part])
        dh[order] += back
        dh *= 1 - h * h
        np.matmul(uf.T, dh, out=g["h"])
        g["hb"][:] = dh.sum(axis=0)
        de = dh @ w["h"].T
        dr = de.reshape(b, t, d)
        da = dr @ v.transpose(0, 2, 1)
        da -= np.einsum("bij,bij->bi", da, a)[..., None]
        da *= a
        dp = np.empty((b, t, 3 * d), dtype=e.dtype)
        dp[..., :d] = da @ k
        dp[..., :d] *= e.dtype.type(d**-0.5)
        dp[..., d : 2 * d] = da.transpose(0, 2, 1) @ q  # q holds the scale
        dp[..., 2 * d :] = a.transpose(0, 2, 1) @ dr
        dp = dp.reshape(n, 3 * d)
        np.matmul(ef.T, dp, out=g["qkv"])
        de += dp @ w["qkv"].T
        g["pos"][:] = 0
        g["pos"][:t] = de.reshape(b, t, d).sum(axis=0)
        order = np.argsort(xf.astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.diff(xf[order], prepend=-1))
        g["emb"][:] = 0
        g["emb"][xf[order[first]]] = np.add.reduceat(de[order], first, axis=0)
        return float(loss / n)


class Adam:
    """Steps on all weights of a model."""

    def __init__(self, model: Attention):
        import numpy as np

        self.model, self.t = model, 0
        self.g, self.m1, self.m2 = (np.zeros_like(model.flat) for _ in range(3))
        self.named = model.views(self.g)

    def step(self, x, y, rate: float) -> float:
        import numpy as np

        loss = self.model.gradient(x, y, self.named)
        self.t += 1
        g, m1, m2 = self.g, self.m1, self.m2
        m1 += np.float32(0.1) * (g - m1)
        np.square(g, out=g)
        g -= m2
        g *= np.float32(0.01)
        m2 += g
        np.multiply(m2, np.float32(1 / (1 - 0.99**self.t)), out=g)
        np.sqrt(g, out=g)
        g += np.float32(1e-8)
        np.divide(m1, g, out=g)
        g *= np.float32(rate / (1 - 0.9**self.t))
        self.model.flat -= g
        return loss


def train(streams: list, steps: int = STEPS, seed: int = 7, counts=None) -> Attention:
    """A model of the symbol streams (each without BEGIN, with END); ``counts``: of each symbol in the corpus."""
    import numpy as np

    model = Attention(seed, zero=not streams)
    if not streams:
        return model
    r = np.random.default_rng(seed)
    whole = np.concatenate([x for s in streams for x in ([BEGIN], s)])
    whole = np.concatenate([whole, np.full(WINDOW + 1, END)]).astype(np.int64)
    freq = np.bincount(whole, minlength=model.classes * MEMBERS).astype(np.float64) + 0.1
    if counts is not None:
        freq[:SYMBOLS] = counts + 0.1
    freq[SYMBOLS:] = 0
    by = freq.reshape(model.classes, MEMBERS)
    model.w["cb"][:] = np.log(by.sum(axis=1))
    model.w["mb"][:] = np.where(by > 0, np.log(np.maximum(by, 1e-9)), -1e9)
    model.w["cb"][:] -= model.w["cb"].max()
    model.w["mb"][:] = np.maximum(model.w["mb"] - model.w["mb"].max(axis=1, keepdims=True), -1e9)
    own = Adam(model)
    for t in range(1, steps + 1):
        at = r.integers(0, len(whole) - WINDOW, BATCH)[:, None] + np.arange(WINDOW)
        own.step(whole[at], whole[at + 1], 0.02 * min(1.0, t / 20) * (1 - t / (steps + 1)) ** 0.5)
    return model


def learn_once(own: Adam, stream, rate: float, seed: int) -> int:
    """Trains on every symbol of the stream (documents with BEGIN and END) once; returns the windows learned."""
    import numpy as np

    size = min(WINDOW, len(stream) - 1)
    first = np.minimum(np.arange(0, len(stream) - 1, size), len(stream) - 1 - size)
    first = np.random.default_rng(seed).permutation(first)
    for a in range(0, len(first), BATCH):
        at = first[a : a + BATCH, None] + np.arange(size)
        own.step(stream[at], stream[at + 1], rate * min(1.0, (own.t + 1) / 20))
    return len(first)


def _added(rows: DataFrame):
    """Sum of the blobs of the rows (part, blob) as one array, added by groups of parts in order; None without rows."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for batch in batches:
            for b in batch.column(1):
                x = np.frombuffer(b.as_py(), dtype="f8")
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "blob"])

    from pyspark import TaskContext

    dealt = rows.withColumn("group", F.pmod("part", F.lit(GROUPS))).repartition(GROUPS, "group").sortWithinPartitions("part").drop("group")
    found = sorted((r.part, r.blob) for r in dealt.mapInArrow(lean(run), "part long, blob binary").collect())
    return sum(np.frombuffer(b, dtype=np.float64) for _, b in found) if found else None


def _training(block: Block, held: list, symbols) -> Iterator:
    """The training documents of a block as streams of BEGIN, symbols and END, about SPAN symbols each time."""
    import numpy as np

    held = np.array(held, dtype=bool)
    for first, end in block.spans():
        stream, before = block.stream(symbols, first, end)
        ends = before[block.edges[first : end + 1] - block.edges[first]]
        keep = ~held[first:end]
        if keep.any():
            kept = np.repeat(keep, np.diff(ends))
            lengths = np.diff(ends)[keep]
            yield np.insert(stream[kept], np.cumsum(lengths) - lengths, BEGIN).astype(np.int64)


def learn(parts: DataFrame, model: Attention, symbols, top: int, rounds: int = ROUNDS) -> Attention:
    """Passes the model once over all training documents of the blocks."""
    import numpy as np

    for k in range(rounds):
        sent = parts.sparkSession.sparkContext.broadcast((model, symbols))
        rate = RATE * (1 - k / rounds)

        def run(batches: Iterator, sent=sent, rate=rate) -> Iterator:
            import copy

            import pyarrow as pa

            keep_freed()
            start, symbols = sent.value
            own, n, least = Adam(copy.deepcopy(start)), 0, None
            for batch in batches:
                for row in range(batch.num_rows):
                    number, held, *rest = (batch.column(c)[row].as_py() for c in range(7))
                    least = number if least is None else min(least, number)
                    for i, stream in enumerate(_training(Block(top, *rest), held, symbols)):
                        n += learn_once(own, stream, rate, (number << 8) + i)
            if n:
                blob = np.append(own.model.flat.astype(np.float64), 1.0) * n
                yield pa.RecordBatch.from_arrays([pa.array([least], pa.int64()), pa.array([blob.tobytes()], pa.binary())], ["part", "blob"])

        own = parts.where(F.col("round") == k).select("block", "held", "sizes", "places", "words", "parts", "lengths")
        total = _added(own.mapInArrow(lean(run), "part long, blob binary"))
        sent.unpersist()
        if total is not None:
            model.flat[:] = total[:-1] / total[-1]
    return model


def score_streams(model: Attention, stream, ends):
    """Log-probability of each symbol of ``stream``; ``ends``: symbols before each text and their total."""
    import numpy as np

    lengths = np.diff(ends)
    windows = np.maximum(1, -(-(lengths - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(lengths)), windows)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    given = np.concatenate([[BEGIN], stream[:-1]])
    given[ends[:-1][lengths > 0]] = BEGIN
    out = np.zeros(len(stream))
    for rows, own in ((WINDOW, np.flatnonzero(nth == 0)), (STRIDE, np.flatnonzero(nth > 0))):
        for a in range(0, len(own), 512):
            which = own[a : a + 512]
            at = (ends[:-1][doc[which]] + nth[which] * STRIDE)[:, None] + np.arange(WINDOW)
            stop = ends[1:][doc[which]][:, None]
            here = at[:, WINDOW - rows :]
            there = here < stop
            hidden = model.hidden(given[np.minimum(at, stop - 1)], rows)[there]
            out[here[there]] = model.logprob(hidden, stream[here[there]])
    return out


class Symbols:
    """What ids stand for: ``symbol`` by id, and ``left``, the log-probability of the id given its symbol."""

    def __init__(self, counts):
        """``counts``: training counts of all ids, then of the end token and of words without ids."""
        import numpy as np

        top = np.argsort(-counts[:-2], kind="stable")[: SYMBOLS - 3]
        self.symbol = np.full(len(counts), RARE, dtype=np.uint16)
        self.symbol[top] = np.arange(len(top)) + 3
        self.symbol[-2] = END
        rare = self.symbol == RARE
        self.left = np.where(rare, np.log((counts + 1) / max(1, (counts[rare] + 1).sum())), 0.0)
        self.counts = np.bincount(self.symbol, counts, minlength=SYMBOLS)
        self.counts[BEGIN] = self.counts[END]


def fit(parts: DataFrame, top: int, steps: int = STEPS, rounds: int = ROUNDS) -> tuple[Attention, Symbols]:
    """The model and its symbols from all training documents of the blocks."""
    import numpy as np

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(top + 2)
        for batch in batches:
            for row in range(batch.num_rows):
                counts, words, ids, lengths = (batch.column(c)[row].as_py() for c in range(4))
                block = Block(top, [], b"", words, ids, lengths)
                total += np.bincount(block.ids, np.repeat(np.frombuffer(counts, dtype=np.uint32), block.lengths), minlength=top + 2)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at].astype(np.int64))], ["number", "n"])

    counts = np.zeros(top + 2)
    for r in parts.select("counts", "words", "parts", "lengths").mapInArrow(lean(count), "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).collect():
        counts[r.number] = r.n
    symbols = Symbols(counts)

    chosen = [r.block for r in parts.where("exists(held, x -> not x)").select("block").orderBy(F.xxhash64("block")).limit(STARTERS).collect()]
    each = TAKEN // max(1, len(chosen))

    def starters(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                number, held, *rest = (batch.column(c)[row].as_py() for c in range(7))
                left = each
                for i, some in enumerate(_training(Block(top, *rest), held, symbols.symbol)):
                    some = some[1 : left + 1].astype("<u2")
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([i], pa.int64()), pa.array([some.tobytes()], pa.binary())], ["block", "at", "stream"])
                    left -= len(some)
                    if left <= 0:
                        break

    some = parts.where(F.col("block").isin(chosen)).select("block", "held", "sizes", "places", "words", "parts", "lengths")
    streams = [np.frombuffer(r.stream, dtype="<u2") for r in sorted(some.mapInArrow(lean(starters), "block long, at long, stream binary").collect())]
    model = train(streams, steps, counts=symbols.counts)
    return (learn(parts, model, symbols.symbol, top, rounds) if streams else model), symbols


def lm_scores(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", steps: int = STEPS, rounds: int = ROUNDS) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``."""
    spark, path = docs.sparkSession, tokenizer_path(tokenizer)
    scratch, top = Scratch(spark, "lm"), encoder(path).ids_in_all
    held = F.coalesce(F.crc32(F.col(id).cast("string")) % 7 == 2, F.lit(False))
    rows = docs.select(F.col(id).alias("id"), held.alias("held"), F.col(text).cast("string").alias("text"))
    parts = scratch.keep(blocks(rows, path, rounds), "blocks", by=("round",), compression="zstd")
    sent = spark.sparkContext.broadcast(fit(parts, top, steps, rounds))
    size = 12 * (parts.agg(F.sum("words")).first()[0] or 0)
    counted = scratch.keep(totals(parts, (-(-size // BUCKET) - 1).bit_length() if size else 0), "totals", compression="zstd")
    of_all = counted.where("block is null").agg(F.sum("v"), F.sum("n")).first()
    distinct, tokens = int(of_all[0] or 0), int(of_all[1] or 0)
    # a block has at most one answer of each bucket that one of its own words is in
    counted = counted.where("block is not null").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "totals"))).alias("totals"))

    def by_model(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        keep_freed()
        model, symbols = sent.value
        for batch in batches:
            for r in range(batch.num_rows):
                case, *rest = (batch.column(c)[r].as_py() for c in range(3, 9))
                block = Block(top, *rest)
                left = np.add.reduceat(symbols.left[block.ids], block.starts)
                if case:
                    left += np.frombuffer(case, dtype=np.float32)
                score = np.add.reduceat(left[block.places], block.edges[:-1])
                for first, end in block.spans():
                    stream, before = block.stream(symbols.symbol, first, end)
                    ends = before[block.edges[first : end + 1] - block.edges[first]]
                    score[first:end] += np.add.reduceat(score_streams(model, stream, ends), ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(r, 1) for c in (0, 1, 2, 4, 5)), pa.array([score / np.log(10)], pa.list_(pa.float64()))],
                    ["block", "ids", "held", "sizes", "places", "scores"],
                )

    kind = docs.schema[id].dataType.simpleString()
    scored = parts.select("block", "ids", "held", "case", "sizes", "places", "words", "parts", "lengths").mapInArrow(
        lean(by_model), f"block long, ids array<{kind}>, held array<boolean>, sizes array<long>, places binary, scores array<double>"
    )
    joined = scored.join(counted, "block").select("ids", "held", "scores", "sizes", "places", F.col("totals.totals").alias("totals"))

    def by_counts(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                sizes, places, answers = (batch.column(c)[r].as_py() for c in range(3, 6))
                count = np.concatenate([np.frombuffer(b, dtype=f"<u{b[0]}", offset=1) for b in answers]).astype(np.int64)
                at = np.frombuffer(places, dtype=np.uint16 if len(count) <= 1 << 16 else np.uint32)
                first = np.cumsum(sizes) - sizes
                known, base = (np.add.reduceat(x[at], first) for x in ((count > 0).astype(np.int64), np.log10((count + 1) / (tokens + distinct + 1))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[r].values, batch.column(1)[r].values, pa.array(sizes, pa.int64()), pa.array(known), pa.array(np.full(len(sizes), tokens)), pa.array(base), batch.column(2)[r].values],
                    [id, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    long, double = T.LongType(), T.DoubleType()
    fields = [("held_out", T.BooleanType()), ("n_tokens", long), ("n_known", long), ("train_tokens", long), ("base_score", double), ("score", double)]
    return joined.mapInArrow(lean(by_counts), T.StructType([docs.schema[id], *(T.StructField(*f) for f in fields)]))
