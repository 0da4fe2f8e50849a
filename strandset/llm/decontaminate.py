"""Benchmark decontamination by word windows (operator 5).

The windows of the test items (13 normalised words; a shorter item is one window) form a hash set that is broadcast.
Documents are scanned in one map-side pass: words are numbered by the item vocabulary, runs of known words are
hashed with a polynomial over all windows at once, and every hash hit is verified word by word.

The broadcast is bounded: items are measured first and split into parts of at most PART bytes of text; with more than
one part the documents are scanned once for each, and the spans are merged by row. No part is ever skipped.

Null or word-free texts have no words and no hits; null items and items without words have no windows; repeated rows
are judged row by row; empty tables on either side work; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandset.llm.common import Scratch, arrow_column, binary
from strandset.llm.tokens import text_slices

N = 13
PART = 8 << 20
#: Lower-cases A-Z; digits, letters and bytes of non-ASCII characters stay; all else separates words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Windows:
    """The windows of some items: vocabulary, distinct windows by length, and the items of each."""

    def __init__(self, items: list[tuple[object, bytes]], n: int = N):
        self.vocab: dict[bytes, int] = {}
        distinct: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            size = min(n, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                distinct.setdefault(size, {}).setdefault(tuple(ids[at : at + size]), set()).add(item)
        self.factor = 0x9E3779B97F4A7C15
        while not self._index(distinct):  # two windows met in one hash: another factor
            self.factor = (self.factor * 0xD1342543DE82EF95 + 2) % 2**64 | 1

    def _index(self, distinct: dict[int, dict[tuple, set]]) -> bool:
        import numpy as np

        self.by_size = {}
        for size, found in sorted(distinct.items()):
            rows = np.array(list(found), dtype=np.uint32)
            hashes = self.hashes(rows.T.astype(np.uint64))
            if len(np.unique(hashes)) < len(hashes):
                return False
            order, owners = np.argsort(hashes), list(found.values())
            self.by_size[size] = (hashes[order], rows[order], [owners[i] for i in order.tolist()])
        return True

    def hashes(self, columns):
        """Polynomial hashes; ``columns`` yields the first words of all windows, then the second words, and so on."""
        import numpy as np

        h, f = None, np.uint64(self.factor)
        with np.errstate(over="ignore"):
            for c in columns:
                h = c.copy() if h is None else h * f + c
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        return h

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list]]:
        """For each text: its number of words, the hit spans [first, end) of words, the items that occur."""
        import numpy as np

        get, flat, starts, counts = self.vocab.get, [], [], []
        for t in texts:
            ws = words(t)
            starts.append(len(flat))
            counts.append(len(ws))
            flat.extend(map(get, ws))
            flat.append(0)
        ids = np.array([x or 0 for x in flat], dtype=np.uint64)
        known = np.concatenate([[0], np.cumsum(ids == 0)])
        edge, items = np.zeros(len(ids) + 1, dtype=np.int64), {}
        first = np.array(starts, dtype=np.int64)
        for size, (hashes, rows, owners) in self.by_size.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] == known[:-size])
            if not len(at):
                continue
            h = self.hashes(ids[at + k] for k in range(size))
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[k] == h
            at, k = at[hit], k[hit]
            hit = (ids[at[:, None] + np.arange(size)] == rows[k]).all(axis=1)
            at, k = at[hit], k[hit]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            doc = np.searchsorted(first, at, side="right") - 1
            for d, w in {*zip(doc.tolist(), k.tolist())}:
                items.setdefault(d, set()).update(owners[w])
        mask = np.diff(np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8))
        opens, closes = np.flatnonzero(mask == 1), np.flatnonzero(mask == -1)
        spans: dict[int, list] = {}
        for a, b in zip(opens.tolist(), closes.tolist()):
            d = int(np.searchsorted(first, a, side="right")) - 1
            spans.setdefault(d, []).append((a - starts[d], b - starts[d]))
        return [(n, spans.get(d, []), sorted(items.get(d, ()), key=str)) for d, n in enumerate(counts)]


def _scan(docs: DataFrame, key: str, items: list[tuple[object, bytes]], item_type: T.DataType) -> DataFrame:
    """(key, n_words, spans, items) of the rows (key, __text)."""
    sent = docs.sparkSession.sparkContext.broadcast(Windows(items))

    def run(columns: Iterator) -> Iterator:
        import pyarrow as pa

        index = sent.value
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        kind = pa.int64() if isinstance(item_type, T.LongType) else pa.int32() if isinstance(item_type, T.IntegerType) else pa.string()
        for column in columns:
            found = []
            for _, part in text_slices(column, 1 << 20):
                found += index.scan(binary(part))
            arrays = [pa.array([f[0] for f in found], pa.int64()), pa.array([[{"first": a, "end": b} for a, b in f[1]] for f in found], span), pa.array([f[2] for f in found], pa.list_(kind))]
            yield pa.StructArray.from_arrays(arrays, ["n_words", "spans", "items"])

    span_type = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", span_type), T.StructField("items", T.ArrayType(item_type))])
    # not deterministic for the optimizer, so that it calls the function once for its three fields
    return docs.select(key, arrow_column(run, schema).asNondeterministic()("__text").alias("__found")).select(key, "__found.*")


def contamination(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = (),
    part: int = PART,
) -> DataFrame:
    """Rows (id, n_words, spans, items, *keep), one for each document: disjoint hit spans of word positions [first, end) in
    ascending order, and the ids of the items with a window in it, sorted as strings. ``keep`` names columns of ``docs`` to carry."""
    spark = docs.sparkSession
    items = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null and item is not null")
    item_type = items.schema["item"].dataType
    if not isinstance(item_type, (T.LongType, T.IntegerType)):
        items, item_type = items.withColumn("item", F.col("item").cast("string")), T.StringType()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // part)
    kept = F.struct(F.col(id).alias("id"), *[F.col(c) for c in keep]).alias("__kept")
    rows = docs.select(kept, F.col(text).cast("string").alias("__text"))
    if parts <= 1:
        found = _scan(rows, "__kept", [(r.item, r.text.encode()) for r in items.collect()], item_type)
    else:
        scratch = Scratch(spark, "decontaminate")
        rows = scratch.keep(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
        every = None
        for k in range(parts):
            some = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k).collect()
            one = _scan(rows, "__row", [(r.item, r.text.encode()) for r in some], item_type)
            every = one if every is None else every.unionAll(one)
        merged = every.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        step = lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["first"]),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(s)))
        merged = merged.withColumn("spans", F.aggregate(F.array_sort("spans"), F.array().cast(merged.schema["spans"].dataType), step))
        in_order = F.transform(F.array_sort(F.transform(F.array_distinct("items"), lambda x: F.struct(x.cast("string").alias("s"), x.alias("x")))), lambda x: x["x"])
        found = rows.join(merged.withColumn("items", in_order), "__row").drop("__row")
    return found.select(F.col("__kept.id").alias(id), "n_words", "spans", "items", *[F.col(f"__kept.{c}").alias(c) for c in keep])


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit (words in spans), n_items, items_sha256 and contaminated (a twentieth of the words or more are hit)."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    found = found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
    found = found.withColumn("items_sha256", F.sha2(F.array_join(F.transform("items", lambda x: x.cast("string")), ",").cast("binary"), 256))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def without_spans(found: DataFrame, text: str) -> DataFrame:
    """``found`` with the hit words cut out of column ``text``, each with the white space after it."""
    import re

    own = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            where = batch.schema.get_field_index(text)
            out = []
            for t, spans in zip(batch.column(where).to_pylist(), batch.column(batch.schema.get_field_index("spans")).to_pylist()):
                if t is None or not spans:
                    out.append(t)
                    continue
                data, at, parts = t.encode(), 0, []
                found = [m.span() for m in own.finditer(data)]
                for s in spans:
                    end = found[s["end"]][0] if s["end"] < len(found) else len(data)
                    parts.append(data[at : found[s["first"]][0]])
                    at = end
                out.append(b"".join([*parts, data[at:]]).decode())
            yield batch.set_column(where, batch.schema.field(where), pa.array(out, batch.schema.field(where).type))

    return found.mapInArrow(run, found.schema)
