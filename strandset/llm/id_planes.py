"""Token ids in byte planes (operator 1).

A chunk holds the ids of whole documents, cut into blocks of BLOCK ids. Each block is transposed into byte planes (all
lowest bytes, then all next bytes, as many as its largest id needs) or, where ``kind`` is 1, bit planes; each
plane is compressed with zstandard by itself. Layout of a chunk, little-endian:

    magic b"IDPL1\\0\\0\\0", number of blocks (u32), ids in the chunk (u64)
    chunk index: for each block its number of ids (u32), kind (u8: 0 byte planes, 1 bit planes), number of planes (u8),
    then the compressed size of each plane (u32)
    the planes, block after block

Chunks are rows of a Parquet table in the shared folder, written by Spark's committer, so a lost task leaves nothing
behind and no local file is used. Their order is (shard, chunk): documents in ascending order of id, rows with equal
ids by the hash of their text. Shards are ranges of ids found by sampling; a shard's first id position is the sum of
the shards before it (one number a shard reaches the driver).

Null texts count as empty; repeated rows are stored as often as they occur; null ids come first; empty tables give an
empty file; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandset.llm.common import Scratch, lean
from strandset.llm.tokens import encoder, text_slices, tokenizer_path

MAGIC = b"IDPL1\0\0\0"
BLOCK = 1 << 16
CHUNK = 1 << 20  # ids after which a chunk ends at the next document's end
LEVEL = 1


def pack_ids(ids, block: int = BLOCK, kind: int = 0) -> bytes:
    """A chunk of the unsigned 32-bit array ``ids``; ``kind`` 0: byte planes, 1: bit planes."""
    import numpy as np
    import zstandard

    press = zstandard.ZstdCompressor(level=LEVEL)
    index, body = [], []
    for at in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[at : at + block], dtype="<u4")
        width = max(1, int(part.max()).bit_length())
        if kind == 0:
            n = (width + 7) // 8
            planes = [p.tobytes() for p in np.ascontiguousarray(part.view(np.uint8).reshape(-1, 4)[:, :n].T)]
        else:
            planes = [np.packbits((part >> bit & 1).astype(np.uint8)).tobytes() for bit in range(width)]
        pressed = [press.compress(p) for p in planes]
        index.append(struct.pack(f"<IBB{len(pressed)}I", len(part), kind, len(pressed), *map(len, pressed)))
        body += pressed
    return MAGIC + struct.pack("<IQ", len(index), len(ids)) + b"".join(index) + b"".join(body)


def unpack_ids(chunk: bytes):
    """The ids of a chunk as an unsigned 32-bit array."""
    import numpy as np
    import zstandard

    if chunk[:8] != MAGIC:
        raise ValueError("not a chunk of id planes")
    blocks, total = struct.unpack_from("<IQ", chunk, 8)
    at, index = 20, []
    for _ in range(blocks):
        n, kind, planes = struct.unpack_from("<IBB", chunk, at)
        index.append((n, kind, struct.unpack_from(f"<{planes}I", chunk, at + 6)))
        at += 6 + 4 * planes
    press, out, done = zstandard.ZstdDecompressor(), np.zeros(total, dtype="<u4"), 0
    for n, kind, sizes in index:
        part = out[done : done + n]
        for k, size in enumerate(sizes):
            plane = np.frombuffer(press.decompress(chunk[at : at + size]), dtype=np.uint8)
            if kind == 0:
                part.view(np.uint8).reshape(-1, 4)[:, k] = plane
            else:
                part |= np.unpackbits(plane, count=n).astype("<u4") << k
            at += size
        done += n
    return out


def write_ids(
    docs: DataFrame, where: str, id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", end: int = 1, kind: int = 0
) -> None:
    """Encode every document, append ``end`` and write the chunk table to ``where``."""
    path, spark = tokenizer_path(tokenizer), docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, "id", "tie").sortWithinPartitions("id", "tie").drop("tie")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        own, last, shard = encoder(path), end.to_bytes(4, "little"), TaskContext.get().partitionId()
        ids, lengths, data, held, chunk, done = [], [], [], 0, 0, 0
        id_type = None

        def flush():
            nonlocal ids, lengths, data, held, chunk, done
            arrays = [
                pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([done], pa.int64()), pa.array([held], pa.int64()),
                pa.array([ids], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int64())),
                pa.array([pack_ids(np.frombuffer(b"".join(data), dtype="<u4"), kind=kind)], pa.binary()),
            ]
            done, chunk = done + held, chunk + 1
            ids, lengths, data, held = [], [], [], 0
            return pa.RecordBatch.from_arrays(arrays, ["shard", "chunk", "first", "n_ids", "doc_ids", "lengths", "planes"])

        for batch in batches:
            id_type = batch.column(0).type
            keys = batch.column(0).to_pylist()
            for row, part in text_slices(batch.column(1)):
                flat, ends = own.ids(part)
                flat, ends = memoryview(flat).cast("B"), ends.tolist()
                for key, start, stop in zip(keys[row:], ends, ends[1:]):
                    n = stop - start + 1
                    ids.append(key), lengths.append(n), data.extend((flat[4 * start : 4 * stop], last))
                    held += n
                    if held >= CHUNK:
                        yield flush()
        if ids:
            yield flush()

    schema = T.StructType(
        [T.StructField("shard", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()),
         T.StructField("doc_ids", T.ArrayType(docs.schema[id].dataType)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("planes", T.BinaryType())]
    )
    rows.mapInArrow(lean(run, encodes=True), schema).write.option("compression", "uncompressed").parquet(where)


def read_ids(spark, where: str, id: str = "doc_id", ids: bool = False) -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32[, ids]) from the chunk table at ``where``."""
    chunks = spark.read.parquet(where)
    totals = {r[0]: r[1] for r in chunks.groupBy("shard").agg(F.sum("n_ids")).collect()}
    before, at = {}, 0
    for shard in sorted(totals):
        before[shard], at = at, at + totals[shard]

    def run(batches: Iterator) -> Iterator:
        from zlib import crc32

        import pyarrow as pa

        names = [id, "start", "n_tokens", "ids_crc32"] + ["ids"] * ids
        for batch in batches:
            for row in range(batch.num_rows):
                shard, first, keys, lengths, planes = (batch.column(k)[row] for k in range(5))
                data = memoryview(unpack_ids(planes.as_py())).cast("B")
                start, at, out = before[shard.as_py()] + first.as_py(), 0, []
                for n in lengths.as_py():
                    part = data[4 * at : 4 * (at + n)]
                    out.append((start + at, n, crc32(part)) + ((bytes(part),) if ids else ()))
                    at += n
                cols = list(zip(*out))
                arrays = [keys.values] + [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(c, pa.binary()) for c in cols[3:]]
                yield pa.RecordBatch.from_arrays(arrays, names)

    long = T.LongType()
    fields = [T.StructField(id, chunks.schema["doc_ids"].dataType.elementType)] + [T.StructField(n, long) for n in ("start", "n_tokens", "ids_crc32")]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * ids)
    return chunks.select("shard", "first", "doc_ids", "lengths", "planes").mapInArrow(run, schema)


def stored_ids(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", end: int = 1) -> DataFrame:
    """Write to a new folder in the shared place and read back."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "id-planes")
    where = f"{scratch.path}/chunks"
    write_ids(docs, where, id, text, tokenizer, end)
    return read_ids(spark, where, id)
