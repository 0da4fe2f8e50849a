"""Sequence packing by best-fit decreasing (operator 7).

Each task encodes its documents and packs them by itself, so nothing is shuffled. A document longer than the window is
first cut into full windows, which are sequences of their own. What remains of it waits in a group of about GROUP
ids and PIECES pieces at most; a group is packed longest first, each piece into the open window with the least room that still takes it. A
segment tree indexed by remaining room finds that window. Windows that stay more than 1/16 empty are cut at powers of
two, where a sequence needs no padding.

A task holds the ids of one group and one slice of texts, so its memory is bounded by GROUP and PIECES beside one long text. A
lost task packs again to the same result, since its split of the input is the same. Sequence ids carry the task's number in their upper bits.

Null texts count as empty (one piece holding the end id); repeated rows are packed as rows of their own; empty tables
give no pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandset.llm.common import lean
from strandset.llm.tokens import encoder, text_slices, tokenizer_path

GROUP = 1 << 22  # ids, 1,024 windows of 4,096
PIECES = 1 << 16  # pieces that wait at most


class RoomTree:
    """Open windows by remaining room 1..window; the segment tree holds for every range whether it has any."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.full = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, room: int, window_id: int) -> None:
        self.bins[room].append(window_id)
        node = room + self.size
        while node and not self.full[node]:
            self.full[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest window with room for ``need``."""
        full, node = self.full, need + self.size
        if not full[node]:
            while node > 1 and (node & 1 or not full[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if full[2 * node] else 2 * node + 1
        room = node - self.size
        window_id = self.bins[room].pop()
        if not self.bins[room]:
            full[node] = 0
            node >>= 1
            while node and not (full[2 * node] or full[2 * node + 1]):
                full[node] = 0
                node >>= 1
        return room, window_id


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Indices of ``lengths`` by window; every length is at most ``window``. Ties keep their order."""
    tree, windows = RoomTree(window), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if (found := tree.take(lengths[i])) is None:
            found = (window, len(windows))
            windows.append([])
        room, w = found
        windows[w].append(i)
        if room > lengths[i]:
            tree.put(room - lengths[i], w)
    return windows


def cut_at_powers(lengths: list[int]) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, first, length) whose totals are the powers of two that make up the sum, largest first."""
    total, out, at, first = sum(lengths), [], 0, 0
    for bit in range(total.bit_length() - 1, -1, -1):
        left = (1 << bit) & total
        if left:
            out.append([])
        while left:
            n = min(left, lengths[at] - first)
            out[-1].append((at, first, n))
            left, first = left - n, first + n
            if first == lengths[at]:
                at, first = at + 1, 0
    return out


def pack(
    docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", window: int = 4096, end: int = 2,
    ids: bool = False,
) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]); ``ids`` adds the little-endian
    unsigned 32-bit ids of each piece."""
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator) -> Iterator:
        from zlib import crc32

        import pyarrow as pa
        from pyspark import TaskContext

        own, last = encoder(path), end.to_bytes(4, "little")
        base, made = TaskContext.get().partitionId() << 40, 0
        waiting: list[tuple] = []
        held = 0
        names = [id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * ids
        id_type = None

        def rows(out: list[tuple]):
            cols = list(zip(*out))
            arrays = [pa.array(cols[0], id_type)] + [pa.array(c, pa.int64()) for c in cols[1:7]]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(c, pa.binary()) for c in cols[7:]], names)

        def piece(doc, start, data, total, seq, offset):
            return (doc, start, len(data) // 4, crc32(data), total, base + seq, offset) + ((data,) if ids else ())

        def flush() -> list[tuple]:
            nonlocal made, held
            out = []
            lengths = [len(w[2]) // 4 for w in waiting]
            for members in best_fit_decreasing(lengths, window):
                total = sum(lengths[i] for i in members)
                cut = [[(k, 0, lengths[i]) for k, i in enumerate(members)]]
                if (window - total) * 16 > window:
                    cut = cut_at_powers([lengths[i] for i in members])
                for seq in cut:
                    offset = 0
                    for k, first, n in seq:
                        doc, start, data, size = waiting[members[k]]
                        out.append(piece(doc, start + first, data[4 * first : 4 * (first + n)], size, made, offset))
                        offset += n
                    made += 1
            waiting.clear()
            held = 0
            return out

        for batch in batches:
            id_type = batch.column(0).type
            keys = batch.column(0).to_pylist()
            for row, part in text_slices(batch.column(1)):
                out = []
                flat, ends = own.ids(part)
                flat, ends = memoryview(flat).cast("B"), (4 * ends).tolist()
                for doc, first, stop in zip(keys[row:], ends, ends[1:]):
                    data = bytes(flat[first:stop]) + last
                    n = len(data) // 4
                    full = n - n % window
                    for start in range(0, full, window):
                        out.append(piece(doc, start, data[4 * start : 4 * (start + window)], n, made, 0))
                        made += 1
                    if full < n:
                        waiting.append((doc, full, data[4 * full :], n))
                        held += n - full
                        if held >= GROUP or len(waiting) >= PIECES:
                            out += flush()
                if out:
                    yield rows(out)
        if waiting:
            yield rows(flush())

    long = T.LongType()
    fields = [docs.schema[id]] + [T.StructField(n, long) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * ids)
    return docs.select(F.col(id), F.col(text).cast("string").alias("__text")).mapInArrow(lean(run, encodes=True), schema)
