"""One ordered JSON Lines file, written by all tasks and put in place at once."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from strandset.operators.ranges import running


@dataclass
class Piece(WriterCommitMessage):
    rows: int
    size: int


class PlacedWriter(DataSourceArrowWriter):
    """Writes each line at its own offset of a file made beforehand. A task that runs twice writes the same bytes to the same places; one that
    still runs after an abort finds no file to write to."""

    def __init__(self, path: str, draft: str):
        self.path, self.draft = path, draft

    def write(self, iterator):
        rows = size = 0
        file = os.open(self.draft, os.O_WRONLY)
        try:
            for batch in iterator:
                lines = batch.column("line").to_pylist()
                at, lengths = batch.column("at").to_numpy(), np.fromiter(map(len, lines), "int64", len(lines))
                starts = np.flatnonzero(np.r_[True, at[1:] != (at + lengths)[:-1]]) if len(lines) else []
                for first, end in zip(starts, [*starts[1:], len(lines)]):
                    _put(file, b"".join(lines[first:end]), int(at[first]))
                rows, size = rows + len(lines), size + int(lengths.sum())
            os.fsync(file)
        finally:
            os.close(file)
        return Piece(rows, size)

    def commit(self, messages):
        whole, found = sum(m.size for m in messages if m), os.path.getsize(self.draft)
        if whole != found:
            os.unlink(self.draft)
            raise RuntimeError(f"{self.draft} has {found} bytes in place of {whole}")
        os.replace(self.draft, self.path)

    def abort(self, messages):
        if os.path.exists(self.draft):
            os.unlink(self.draft)


def _put(file: int, data: bytes, at: int) -> None:
    rest = memoryview(data)
    while rest:
        done = os.pwrite(file, rest, at)
        rest, at = rest[done:], at + done


class PlacedLines(DataSource):
    """Rows (at, line): bytes and where they go. Options: path, and draft, the empty file beside it that becomes it."""

    @classmethod
    def name(cls):
        return "placed_lines"

    def schema(self):
        return "at long, line binary"

    def writer(self, schema, overwrite):
        return PlacedWriter(self.options["path"], self.options["draft"])


def write_jsonl(rows: DataFrame, path: str, *order: str) -> None:
    """Writes ``rows`` as one JSON Lines file sorted by ``order`` (nulls first, ties by the digest of the line). Null fields are written.

    ``path`` lies in a mounted folder that driver and executors share. Offsets are running sums of bytes over sorted ranges, so each task
    writes its own part of one file and neither the driver nor any task sees the whole; equal rows spread over ranges too. The file takes its name when
    all tasks are done; if one fails, what stood there stays. No rows give an empty file; a row is one line, however long."""
    spark, names = rows.sparkSession, [f"__o{i}" for i in range(len(order))]
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    lines = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(order, names)], F.encode(F.concat(text, F.lit("\n")), "UTF-8").alias("line"))
    lines = lines.withColumns({"bytes": F.octet_length("line").cast("long"), "digest": F.sha2("line", 256), "salt": F.rand(7)})
    placed = running(lines, (), (*names, "digest", "salt"), "bytes", "at").select("at", "line")
    spark.dataSource.register(PlacedLines)
    folder, name = os.path.split(os.path.abspath(path))
    draft = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
    open(draft, "xb").close()
    try:
        placed.write.format("placed_lines").option("draft", draft).mode("append").save(os.path.join(folder, name))
    finally:
        if os.path.exists(draft):
            os.unlink(draft)
