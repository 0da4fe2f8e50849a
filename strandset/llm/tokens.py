"""Piece-cached encoding with the public tokenizer files.

The normaliser and pre-tokenizer of ``word_bpe_49k.json`` never join text across white space, so the ids of a text
are the ids of its white-space-separated pieces one after another. A batch of texts is split and numbered by Arrow
kernels; each worker keeps a bounded cache of distinct pieces and calls the library only for misses.

Misses made of Latin letters and closing marks are encoded many at a time, joined by spaces: every pre-token ends
in an end-of-word id, which tells the pieces apart again. All other pieces are encoded one by one.
"""

from __future__ import annotations

import os

LONGEST = 64  # bytes of a piece worth keeping
KEPT = 40 << 20  # bytes in one generation of a cache
COST = 220  # bytes that a piece takes in it, about
JOINED = 128
MARKS = "!#$%&()*+,-./:;=?@]_`}~"

_ENCODERS: dict = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCache:
    """Piece -> ids (little-endian unsigned 32-bit) or piece -> number of ids.

    Two generations bound the memory: when the young one is full it becomes the old one, and what is used again
    moves back. Eviction only costs time.
    """

    def __init__(self, path: str, counts: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # an executor core runs one task
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # this cache takes its place
        vocab = self.tokenizer.get_vocab()
        self.suffix = self.tokenizer.model.end_of_word_suffix
        self.ids_in_all = max(vocab.values()) + 1
        self.last = np.zeros(self.ids_in_all, dtype=bool)
        if self.suffix:
            self.last[[i for w, i in vocab.items() if w.endswith(self.suffix)]] = True
        self.counts = counts
        self.fixed: dict = {}
        self.young: dict = {}
        self.old: dict = {}
        self.size, self.kept = 0, KEPT

    def _pre_tokens(self, word: str) -> int:
        """Pre-tokens of a piece that is letters with marks after them at most; 0 for any other."""
        letters = word.rstrip(MARKS)
        if letters.isalpha() and max(letters) < "ɐ" and "İ" not in letters:
            return 1 + (len(letters) < len(word))
        return 0

    def encode(self, pieces: list[bytes]) -> list:
        """The values of some pieces."""
        import numpy as np

        words = [p.decode("utf-8", "replace") for p in pieces]
        sizes = [self._pre_tokens(w) for w in words] if self.suffix else [0] * len(words)
        out: list = [None] * len(words)
        plain = [i for i, n in enumerate(sizes) if n]
        runs = [" ".join([words[i] for i in plain[at : at + JOINED]]) for at in range(0, len(plain), JOINED)]
        if runs:
            ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)])
            ends, upto = np.flatnonzero(self.last[ids]) + 1, np.cumsum([sizes[i] for i in plain])
            if len(ends) == upto[-1] and ends[-1] == len(ids):
                stops = ends[upto - 1].tolist()
                starts = [0, *stops[:-1]]
                data = ids.tobytes()
                for i, a, b in zip(plain, starts, stops):
                    out[i] = b - a if self.counts else data[4 * a : 4 * b]
        rest = [i for i, v in enumerate(out) if v is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False) if rest else ()):
            out[i] = len(e.ids) if self.counts else np.array(e.ids, dtype="<u4").tobytes()
        return out

    def _values(self, pieces: list[bytes]) -> list:
        young, fixed, old = self.young, self.fixed, self.old
        out = list(map(young.get, pieces))
        missing = []
        for i, v in enumerate(out):
            if v is None:
                w = pieces[i]
                if (v := fixed.get(w)) is None and (v := old.get(w)) is None:
                    missing.append(i)
                else:
                    out[i] = young[w] = v
                    self.size += COST
        for at in range(0, len(missing), 1 << 14):
            part = missing[at : at + (1 << 14)]
            for i, v in zip(part, self.encode([pieces[i] for i in part])):
                out[i] = v
                if len(pieces[i]) <= LONGEST:
                    young[pieces[i]] = v
                    self.size += COST
        if self.size > self.kept:
            self.old, self.young, self.size = young, {}, 0
        return out

    def _pieces(self, column):
        """(values of the distinct pieces, number of the piece at each place, places before each text)."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(pc.fill_null(column, "").cast(pa.large_string()))
        ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        told = lists.flatten().dictionary_encode()
        _, offsets, data = told.dictionary.buffers()
        stops = np.frombuffer(offsets, dtype=np.int64, count=len(told.dictionary) + 1 + told.dictionary.offset)[told.dictionary.offset :].tolist() if len(told.dictionary) else [0]
        data = data.to_pybytes() if data else b""
        return self._values([data[a:b] for a, b in zip(stops, stops[1:])]), np.asarray(told.indices), ends

    def ids(self, column):
        """(all ids of an Arrow text column one after another, ids before each text and their total)."""
        import numpy as np

        values, at, ends = self._pieces(column)
        flat = np.frombuffer(b"".join(values), dtype="<u4")
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        starts = np.cumsum(sizes) - sizes
        n = sizes[at]
        before = np.concatenate([[0], np.cumsum(n)])
        return flat[np.repeat(starts[at] - before[:-1], n) + np.arange(before[-1])], before[ends]

    def lengths(self, column):
        """Number of ids of each text of an Arrow column."""
        import numpy as np

        values, at, ends = self._pieces(column)
        before = np.concatenate([[0], np.cumsum(np.array(values, dtype=np.int64)[at])])
        return np.diff(before[ends])


def encoder(path: str, counts: bool = False) -> PieceCache:
    """The worker's cache; it outlives a task where Python workers are reused."""
    key = (path, counts)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceCache(path, counts)
    return _ENCODERS[key]


def forget() -> None:
    """Drops the worker's caches."""
    _ENCODERS.clear()


def slices(lengths: list[int], size: int = 8 << 20):
    """Runs of rows of about ``size`` bytes, so that no batch holds more than that beside one long text."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        total += n
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def text_slices(column, size: int = 4 << 20):
    """(first row, slice) of an Arrow text column in runs of about ``size`` bytes.

    Slices are copies: some Arrow kernels misread the offsets of a slice that was cast."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in slices(lengths, size):
        yield a, column.take(np.arange(a, b))
