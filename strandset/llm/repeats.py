"""Substring dedup by hashing lines and the sentences in them (operator 8).

A unit is a stretch up to a line end or sentence end with the marks and white space after it, so the units of a text make
it up without gaps. Its digest covers its words, lower-cased (A-Z), with single spaces. Digests are grouped over the
whole corpus; the occurrence that comes first by (id, position) stays. A later occurrence is removed when it stands in
a run of adjacent later occurrences that holds at least ``run_words`` words, so repeated lines, paragraphs and
passages inside a line go, while short common sentences stay where they are. With ``whole_lines`` lines have digests too,
and a later occurrence of a whole line goes whatever its length.

The first occurrence of a digest is a minimum, combined on the map side; marks come back through an equi join whose hot
keys adaptive execution splits, so no digest is ever gathered in one task. What one document holds is gathered by
document only.

Rows with the same id and text count as one document (they get the same result); null texts stay null and have no
units; null ids rank first; empty tables give no rows; columns named in ``keep`` are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandset.llm.common import Scratch, lean

RUN_WORDS = 20
UNIT = r"[^.!?\n]+[.!?\x09-\x0D ]*|[.!?\x09-\x0D ]+"


def units(text: str) -> list[str]:
    import re

    return re.findall(UNIT, text)


def lines(parts: list) -> list[tuple[int, int]]:
    """The units [start, end) of each line."""
    newline = b"\n" if parts and isinstance(parts[0], bytes) else "\n"
    ends = [i + 1 for i, u in enumerate(parts) if newline in u]
    if parts and (not ends or ends[-1] < len(parts)):
        ends.append(len(parts))
    return list(zip([0, *ends], ends))


def _digests(rows: DataFrame, whole_lines: bool) -> DataFrame:
    """(id, tie, digests): one 128-bit digest (two numbers) for each unit, 0 for a unit without words, then one for each line."""

    def run(batches: Iterator) -> Iterator:
        import re

        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest as digest

        find, none = re.compile(UNIT.encode()).findall, bytes(16)
        for batch in batches:
            flat, ends = [], [0]
            for t in batch.column(2).cast(pa.large_binary()).to_pylist():
                parts = find(t.lower()) if t else []
                for u in parts:
                    ws = u.split()
                    flat.append(digest(b" ".join(ws)) if ws else none)
                for a, b in lines(parts) if whole_lines else ():
                    ws = b"".join(parts[a:b]).split()
                    flat.append(digest(b" ".join(ws), seed=1) if ws else none)
                ends.append(len(flat))
            pairs = np.frombuffer(b"".join(flat), dtype="<i8").reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["a", "b"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["id", "tie", "digests"])

    schema = T.StructType([rows.schema["id"], rows.schema["tie"], T.StructField("digests", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))])
    return rows.select("id", "tie", "text").mapInArrow(lean(run), schema)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(rows: DataFrame, run_words: int) -> DataFrame:
    """Cuts the runs of later occurrences (positions ``later``) that are long enough."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    add = [T.StructField("n_units", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", span), T.StructField("clean", T.StringType())]
    fields = [f for f in rows.schema.fields if f.name not in ("later", "text")] + add

    def run(batches: Iterator) -> Iterator:
        import re

        import pyarrow as pa

        find = re.compile(UNIT).findall
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for text, later in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), batch.column(batch.schema.get_field_index("later")).to_pylist()):
                parts = find(text) if text else []
                gone, n = [], 0
                if later:
                    whole = [p - len(parts) for p in later if p >= len(parts)]
                    later, runs = sorted(p for p in later if p < len(parts)), []
                    for p in later:
                        if runs and runs[-1][1] == p:
                            runs[-1][1] = p + 1
                        else:
                            runs.append([p, p + 1])
                    for a, b in runs:
                        if sum(len(u.encode().split()) for u in parts[a:b]) >= run_words:
                            gone.append((a, b))
                    if whole:
                        of = lines(parts)
                        gone = _joined(gone + [of[k] for k in whole])
                    n = sum(b - a for a, b in gone)
                kept, cuts, at, pos = [], [], 0, 0
                for a, b in gone:
                    kept.extend(parts[at:a])
                    pos += sum(map(len, parts[at:a]))
                    size = sum(map(len, parts[a:b]))
                    cuts.append({"start": pos, "end": pos + size})
                    pos, at = pos + size, b
                for o, v in zip(out, (len(parts), n, cuts, "".join([*kept, *parts[at:]]) if gone else text)):
                    o.append(v)
            keep = [batch.column(i) for i, f in enumerate(batch.schema.names) if f not in ("later", "text")]
            yield pa.RecordBatch.from_arrays(
                keep + [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], spans), pa.array(out[3], pa.string())], [f.name for f in fields]
            )

    return rows.mapInArrow(lean(run), T.StructType(fields))


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), run_words: int = RUN_WORDS, whole_lines: bool = False) -> DataFrame:
    """Rows (id, text, n_units, n_removed, removed, *keep): the text without later occurrences, and the code-point
    spans [start, end) of the original text that went."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.struct(*[F.col(c) for c in keep], F.lit(0).alias("__none")).alias("kept"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    found = _digests(rows.where("text is not null"), whole_lines).select("id", "tie", F.posexplode("digests").alias("pos", "d")).where("d.a != 0 or d.b != 0").select("id", "tie", "pos", "d.a", "d.b")
    place = F.struct("id", "tie", "pos")
    firsts = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last")
    firsts = Scratch(docs.sparkSession, "repeats").keep(firsts, "firsts")  # so that the join below deals both its sides anew and can split hot digests
    later = found.join(firsts, ["a", "b"]).where(~place.eqNullSafe(F.col("first"))).select("id", "tie", "pos").distinct()
    later = later.groupBy("id", "tie").agg(F.collect_list("pos").alias("later"))
    later = later.select(F.col("id").alias("id2"), F.col("tie").alias("tie2"), "later")
    joined = rows.join(later, F.col("id").eqNullSafe(F.col("id2")) & F.col("tie").eqNullSafe(F.col("tie2")), "left").drop("id2", "tie2", "tie")
    done = _cut(joined, run_words)
    return done.select(F.col("id").alias(id), F.col("clean").alias(text), "n_units", "n_removed", "removed", *[F.col(f"kept.{c}").alias(c) for c in keep])
