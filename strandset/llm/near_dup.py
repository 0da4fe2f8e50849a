"""Near-duplicate documents by b-bit MinHash (operator 6).

1. Every text becomes its set of hashed five-word shingles, ROWS * BANDS minima over them, a key for each band of ROWS
   minima, and BITS low bits of each mixed minimum, packed plane by plane.
2. Texts with the same set are one node, the smallest id among them.
3. Nodes that share a band key are candidates. In each bucket every member is compared with one only, the most central:
   the node whose buckets hold the most members in all. A comparison first takes the bit counts of the packed signatures, corrected for chance agreement; a link
   must show at least LEAST, more than four standard deviations below 0.75. Survivors are confirmed on full sets.
4. Buckets that still hold several components are gone through again: members of different components are compared in
   blocks of packed signatures, in the first band they share, and confirmed on full sets in the same task. Pairs inside
   one component cannot change the result and are passed over; no pair becomes a row unless it is a link. No bucket is
   capped: a large one is dealt over several tasks, in blocks of its main component and of the others.

A pair at similarity 0.75 shares no band with probability (1 - 0.75 ** 3) ** 32, 3e-8. Signatures, links and components
stay in tables; the driver holds none of them.

Empty and null texts have no shingles and are linked with nothing; rows with a null id stand alone; rows with equal ids
count as linked; fewer than five words make one shingle; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandset.llm.common import Scratch, lean
from strandset.llm.components import components
from strandset.llm.tokens import text_slices

WORDS, ROWS, BANDS, BITS = 5, 3, 32, 4
LEAST = 0.55
WORDS_OF = 2  # 64-bit words that hold one plane of the ROWS * BANDS signature slots
BLOCK = 2_000_000  # shingles of a bucket's main component, or of its others, in one task, about
ROWS_OF = 1 << 10  # and rows
SHARE = 512  # documents confirmed against one copy of their partner


def mixed(x):
    """The splitmix64 finaliser on an array."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_sets(column):
    """For each text of an Arrow column its sorted distinct shingle hashes."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from xxhash import xxh3_64_intdigest

    lower = pc.ascii_lower(pc.fill_null(column, "").cast(pa.large_string()))
    lists = pc.ascii_split_whitespace(lower)
    flat = lists.flatten()
    ends = np.asarray(lists.offsets)
    ends = ends - ends[0]
    there = np.asarray(pc.greater(pc.binary_length(flat), 0)) if len(flat) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(there)])[ends]
    told = flat.filter(pa.array(there)).dictionary_encode()
    own = np.fromiter((xxh3_64_intdigest(w) for w in told.dictionary.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(told.dictionary))
    w = own[np.asarray(told.indices)]
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(w) - WORDS + 1), dtype=np.uint64)
        for k in range(WORDS if len(h) else 0):
            h = h * factor + w[k : len(w) - WORDS + 1 + k]
        h = mixed(h)
        for a, b in zip(ends.tolist(), ends[1:].tolist()):
            if b - a >= WORDS:
                yield np.unique(h[a : b - WORDS + 1])
            elif b > a:
                one = np.uint64(b - a)
                for x in w[a:b]:
                    one = one * factor + x
                yield mixed(np.array([one]))
            else:
                yield h[:0]


def factors():
    import numpy as np

    return mixed(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minima(hashes, by):
    """The ROWS * BANDS minima of one set."""
    import numpy as np

    out = None
    for at in range(0, len(hashes), 4096):
        with np.errstate(over="ignore"):
            low = (by[:, None] * hashes[None, at : at + 4096]).min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(id, n, digest, bands, planes) of the rows (id, text)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        by, seeds = factors(), np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            n, digest, found = [], [], []
            for _, part in text_slices(batch.column(1), 4 << 20):
                for s in shingle_sets(part):
                    n.append(len(s))
                    digest.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                    found.append(minima(s, by) if len(s) else np.zeros(ROWS * BANDS, np.uint64))
            low = mixed(np.array(found, dtype=np.uint64).reshape(-1, ROWS * BANDS))
            key = np.broadcast_to(seeds, (len(low), BANDS)).copy()
            with np.errstate(over="ignore"):
                for r in range(ROWS):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + low[:, r::ROWS])
            bits = np.zeros((len(low), BITS, WORDS_OF * 64), dtype=np.uint8)
            for b in range(BITS):
                bits[:, b, : ROWS * BANDS] = (low >> np.uint64(b)) & np.uint64(1)
            planes = np.packbits(bits.reshape(len(low), -1), axis=1).view(np.int64)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists(key.view(np.int64)), lists(planes)], ["id", "n", "digest", "bands", "planes"]
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(lean(run), f"id {kind}, n long, digest binary, bands array<long>, planes array<long>")


def estimate(a: str, b: str):
    """Similarity that the signatures in columns ``a`` and ``b`` show, less chance agreement."""
    size = ROWS * BANDS
    differ = None
    for w in range(WORDS_OF):
        word = None
        for p in range(BITS):
            x = F.get(f"{a}.planes", F.lit(p * WORDS_OF + w)).bitwiseXOR(F.get(f"{b}.planes", F.lit(p * WORDS_OF + w)))
            word = x if word is None else word.bitwiseOR(x)
        differ = F.bit_count(word) if differ is None else differ + F.bit_count(word)
    chance = 2.0**-BITS
    return ((1 - differ / size) - chance) / (1 - chance)


def alike(a: str, b: str):
    """Whether the signatures in columns ``a`` and ``b`` may belong to a link: sizes and corrected agreement."""
    return (estimate(a, b) >= LEAST) & (F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * 75)


def confirmed(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """The edges (a, b) whose documents have 100 * intersection >= 75 * union, by their full shingle sets.

    Texts go once to their partners: b's text to a's group, where a's own text comes first. A group of more than SHARE
    documents is dealt over several, each with a copy of a's text."""
    sizes = edges.groupBy("a").agg(F.count("*").alias("m")).select("a", F.ceil(F.col("m") / SHARE).cast("int").alias("groups"))
    calls = edges.join(sizes, "a").select(F.col("b").alias("id"), F.col("a"), F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"), F.lit(1).alias("role"))
    calls = calls.unionAll(sizes.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(0).alias("role")))
    calls = calls.groupBy("id").agg(F.collect_set(F.struct("a", "part", "role")).alias("calls"))
    sent = docs.join(calls, "id").select("id", "text", F.explode("calls").alias("c")).select("c.a", "c.part", "c.role", "id", "text")
    sent = sent.repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        now = own = None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
            out = []
            for row, part in text_slices(batch.column(4), 4 << 20):
                for (a, p, role, b), s in zip(keys[row:], shingle_sets(part)):
                    if role == 0:
                        own = s if (a, p) != now or own is None else np.union1d(own, s)
                        now = (a, p)
                    else:
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if both and 100 * both >= 75 * (len(own) + len(s) - both):
                            out.append((a, b))
            kind = batch.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], kind)], ["a", "b"])

    kind = docs.schema["id"].dataType.simpleString()
    return sent.mapInArrow(lean(run), f"a {kind}, b {kind}")


def _buckets(batches: Iterator) -> Iterator:
    """The rows of each (key, part) of sorted batches as Arrow tables."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part = np.asarray(batch.column(0)), batch.column(1).dictionary_encode()
        code = np.asarray(part.indices)
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            own = (int(key[a]), part.dictionary[int(code[a])].as_py())
            if own != now and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = own
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _whole(table, name: str):
    """A column of a bucket as one array."""
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def _pairs(table) -> Iterator[tuple[int, list[int]]]:
    """(i, js): rows of different components in the part that may be linked, each pair in the first band it shares.

    A part "m" holds a block of the main component and one of others, which meet; a part "o" one or two blocks of
    others, which meet each other, or themselves where there is one."""
    import numpy as np
    import pyarrow as pa

    rows = table.num_rows
    n, band = np.asarray(_whole(table, "n")), table.column("band")[0].as_py()
    planes = np.asarray(_whole(table, "planes").flatten()).view(np.uint64).reshape(rows, BITS, WORDS_OF)
    bands = np.asarray(_whole(table, "bands").flatten()).reshape(rows, BANDS)
    comp = np.asarray(_whole(table, "component").cast(pa.string()).dictionary_encode().indices)
    main, block = _whole(table, "main").to_numpy(zero_copy_only=False), np.asarray(_whole(table, "block"))
    meet_main, one = table.column("part")[0].as_py().startswith("m"), (block == block[0]).all()
    for i in np.flatnonzero(~main).tolist():
        rest = main if meet_main else (np.arange(rows) > i) & (one | (block != block[i]))
        at = np.flatnonzero(rest & (comp != comp[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * 75))
        if len(at):
            differ = np.bitwise_count(np.bitwise_or.reduce(planes[at] ^ planes[i], axis=1)).sum(axis=1)
            at = at[((1 - differ / (ROWS * BANDS)) - 2.0**-BITS) / (1 - 2.0**-BITS) >= LEAST]
        if len(at):
            at = at[(bands[at] == bands[i]).argmax(axis=1) == band]
        if len(at):
            yield i, at.tolist()


OPEN = ("key", "part", "main", "block", "component", "id", "n", "planes", "band", "bands")


def taking_part(members: DataFrame) -> DataFrame:
    """The rows of ``members`` (columns OPEN) that are in a pair that may be linked."""

    def mark(batches: Iterator) -> Iterator:
        for table in _buckets(batches):
            keep: set[int] = set()
            for i, js in _pairs(table):
                keep.add(i)
                keep.update(js)
            if keep:
                yield from table.take(sorted(keep)).to_batches()

    rows = members.repartition("key", "part").sortWithinPartitions("key", "part").select(*OPEN)
    return rows.mapInArrow(lean(mark), rows.schema)


def linked(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) among ``members`` (columns OPEN) by full shingle sets; a pair that others have joined is passed over."""
    kind = docs.schema["id"].dataType.simpleString()
    calls = members.groupBy("id").agg(F.collect_list(F.struct(*[c for c in OPEN if c not in ("id", "n", "planes", "bands")])).alias("calls"), *[F.first(c).alias(c) for c in ("n", "planes", "bands")])
    rows = docs.join(calls, "id").withColumn("c", F.explode("calls")).select(*[F.col(c) if c in ("id", "n", "planes", "bands") else F.col(f"c.{c}") for c in OPEN], "text")
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for table in _buckets(batches):
            ids, of = _whole(table, "id"), _whole(table, "component").to_pylist()
            sets = [s for _, part in text_slices(_whole(table, "text"), 4 << 20) for s in shingle_sets(part)]
            up: dict = {}

            def root(x, up=up):
                while x in up:
                    x = up[x]
                return x

            out = []
            for i, js in _pairs(table):
                for j in js:
                    x, y = root(of[i]), root(of[j])
                    if x != y:
                        s, t = sets[i], sets[j]
                        both = len(np.intersect1d(s, t, assume_unique=True))
                        if 100 * both >= 75 * (len(s) + len(t) - both):
                            up[x] = y
                            out.append((i, j))
            if out:
                yield pa.RecordBatch.from_arrays([ids.take([x[k] for x in out]) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(lean(run), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id, kept), one for each row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    signed = scratch.keep(signatures(rows), "signatures")
    kind = rows.schema["id"].dataType.simpleString()
    whole = signed.where("n > 0 and id is not null")
    nodes = whole.groupBy("digest").agg(F.min("id").alias("node"))
    twins = scratch.keep(whole.select("id", "digest").join(nodes, "digest").select("id", "node"), "twins")
    nodes = scratch.keep(
        whole.groupBy("digest").agg(F.min_by(F.struct("id", "n", "planes", "bands"), "id").alias("x")).select("x.*"), "nodes"
    )
    text_of = rows.join(nodes.select("id"), "id", "left_semi")

    banded = nodes.select("id", F.posexplode("bands").alias("band", "key"))
    sizes = banded.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("m")).where("first != last")
    met = scratch.keep(banded.join(sizes.select("key", "m"), "key"), "met")
    central = met.groupBy("id").agg(F.sum("m").alias("score"))
    leads = met.join(central, "id").groupBy("key").agg(F.max(F.struct("score", "id")).alias("x")).select("key", F.col("x.id").alias("lead"))
    members = scratch.keep(met.join(scratch.keep(leads, "leads"), "key"), "members")
    small = nodes.select("id", "n", "planes")
    compared = members.where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    sig = lambda name: small.select(F.col("id").alias(name), F.struct("n", "planes").alias(f"s{name}"))
    likely = compared.join(sig("a"), "a").join(sig("b"), "b").where(alike("sa", "sb")).select("a", "b")
    links = scratch.keep(confirmed(scratch.keep(likely, "likely"), text_of), "links")
    first = components(links, scratch, "first")

    first = scratch.keep(first, "components")
    placed = members.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    leads = first.select(F.col("id").alias("lead"), F.col("component").alias("main_component"))
    placed = placed.join(leads, "lead", "left").withColumn("main", F.col("component") == F.coalesce("main_component", "lead"))
    placed = placed.where("m > 2").join(nodes, "id")
    placed = placed.withColumn("weight", F.greatest(F.col("n") / BLOCK, F.lit(1 / ROWS_OF)))
    blocks = lambda what: F.ceil(F.sum(F.when(what, F.col("weight")).otherwise(0))).cast("int")
    open_keys = placed.groupBy("key").agg(blocks(F.col("main")).alias("mains"), blocks(~F.col("main")).alias("others")).where("others > 0")
    open_keys = scratch.keep(open_keys, "open-keys")  # so that the join deals both its sides anew and can split a hot key
    again = placed.select("key", "band", "id", "component", "main", "n", "planes", "bands").join(open_keys, "key")
    again = again.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    each = lambda n, name: F.transform(F.sequence(F.lit(0), F.col(n) - 1), name)
    parts = F.when(F.col("main"), each("others", lambda q: F.concat_ws("-", F.lit("m"), F.col("block"), q))).otherwise(
        F.concat(
            each("mains", lambda p: F.concat_ws("-", F.lit("m"), p, F.col("block"))),
            each("others", lambda q: F.concat_ws("-", F.lit("o"), F.least(q, F.col("block")), F.greatest(q, F.col("block")))),
        )
    )
    again = taking_part(again.withColumn("part", F.explode(parts)))
    links = links.unionAll(scratch.keep(linked(scratch.keep(again, "again"), text_of), "more-links"))
    last = components(links.unionAll(first.select(F.col("component").alias("a"), F.col("id").alias("b"))), scratch, "last")

    placed = twins.join(last.withColumnRenamed("id", "node"), "node", "left").select(F.col("id").alias("twin"), F.coalesce("component", "node").alias("component")).distinct()
    out = signed.select("id", "n").join(placed, F.col("id") == F.col("twin"), "left")
    out = out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id).eqNullSafe(F.col("component_id")))
