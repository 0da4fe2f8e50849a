"""Token counts by a map-side two-tier lookup (operator 9).

Tier one is a broadcast table of the lengths of frequent pieces; tier two is each worker's cache, filled by the
library for pieces that the table lacks. No piece is ever shuffled.

The table is chosen from counts over all documents. Every task reports only pieces with at least 1/SHARE of its
own pieces, so at most SHARE rows a task, and the final table keeps those with at least 1/SHARE of all pieces: at most
SHARE entries of at most 64 bytes, whatever the size of the corpus. It decides speed alone, never a count.

Null texts count as empty; empty tables give empty results; repeated rows give repeated rows; other columns of the
input are ignored unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandset.llm.common import Scratch, binary, lean
from strandset.llm.tokens import LONGEST, encoder, slices, text_slices, tokenizer_path

SHARE = 1 << 13
HELD = 1 << 17  # distinct pieces a task holds while it counts


def frequent_pieces(docs: DataFrame, text: str) -> DataFrame:
    """(piece, n): pieces that make up at least 1/SHARE of all pieces, by lossy counting in each task."""

    def count(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        seen, total = Counter(), 0
        for batch in batches:
            texts = binary(batch.column(0))
            for a, b in slices([len(t) for t in texts], 1 << 20):
                words = b" ".join(texts[a:b]).split()
                total += len(words)
                seen.update(words)
                if len(seen) > HELD:
                    floor = sorted(seen.values())[len(seen) - HELD // 2]
                    seen = Counter({w: n for w, n in seen.items() if n > floor})
        kept = [(w, n) for w, n in seen.items() if n * SHARE >= total and len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays(
            [pa.array([None] + [w for w, _ in kept], pa.binary()), pa.array([total] + [n for _, n in kept], pa.int64())],
            ["piece", "n"],
        )

    told = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "piece binary, n long")
    return told.groupBy("piece").agg(F.sum("n").alias("n"))


def length_table(docs: DataFrame, text: str, path: str) -> dict[bytes, int]:
    """Lengths in tokens of the frequent pieces; at most SHARE entries by the share each must have."""
    found = Scratch(docs.sparkSession, "token-counts").keep(frequent_pieces(docs, text), "pieces")
    total = found.where("piece is null").agg(F.sum("n")).first()[0] or 0
    rows = found.where(F.col("piece").isNotNull() & (F.col("n") * SHARE >= total)).select("piece").collect()
    pieces = [bytes(r[0]) for r in rows]
    own = encoder(path, counts=True)
    return dict(zip(pieces, own.encode(pieces))) if pieces else {}


def token_counts(
    docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", limit: int = 2048
) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one for each row of ``docs``."""
    path = tokenizer_path(tokenizer)
    sent = docs.sparkSession.sparkContext.broadcast(length_table(docs, text, path))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        own = encoder(path, counts=True)
        own.fixed = sent.value
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            n = pa.array([x for _, part in text_slices(batch.column(1)) for x in own.lengths(part).tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, n, pc.greater(n, limit)],
                [id, "n_bytes", "n_tokens", "over_limit"],
            )

    schema = T.StructType(
        [docs.schema[id], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    )
    return docs.select(F.col(id), F.col(text).cast("string").alias("__text")).mapInArrow(lean(count, encodes=True), schema)
