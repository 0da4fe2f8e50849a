"""Exact top-k inner products by norm buckets (operator 2).

Vectors become integers, floor(256 * x), and are sorted by length into buckets of BUCKET. Buckets are dealt over
groups in rounds, in the order of length, so each group has its share of every length; a task holds one group and lets the
query blocks pass. A query starts with the k-th best score among the HEADS longest buckets as threshold; a group goes through its
buckets from the longest on with the k-th best score so far. The local threshold of a query in a bucket is the cosine that a
vector of the bucket's largest length needs: above one the bucket is skipped; from COORDINATE on candidates are those
whose focus coordinate lies in the range that such a cosine allows (coordinate pruning); below, those long enough
(length pruning). Survivors are verified by exact integer products; the best of all groups are merged.

Queries are dealt to the groups in blocks of a fixed size and HEADS is fixed, so no broadcast grows with the data, and no pair of a query
and a vector becomes a row unless it is among the k best of a group.

Null vectors and those with null or non-finite components take no part; vectors meet only vectors of their own number
of components; a vector is no candidate for a query of the same id; ties go to the smaller id; repeated rows are
candidates as often as they occur, and of equal ids one is a query; scores beyond 64 bits are clipped; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandset.llm.common import Scratch, lean, partitions

BUCKET = 512
GROUP = 1 << 17  # vectors in one group at most, on average
BLOCK = 1024  # queries that pass together
HEADS = 4  # longest buckets that give queries their first threshold
COORDINATE = 0.7
SAFE = 1e-9


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Packs (dims, id, values) rows of a task into rows (dims, ids, data, at) of at most ``size`` vectors, in the order that
    they come in; ``at`` numbers those of a task and dims."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}
        made: dict[int, int] = {}

        def out(dims):
            ids, data = zip(*held.pop(dims))
            made[dims] = made.get(dims, -1) + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([dims], pa.int32()), *(pa.array([np.array(x, dtype=np.int64).tobytes()], pa.binary()) for x in (ids, data)), pa.array([made[dims]], pa.int64())],
                ["dims", "ids", "data", "at"],
            )

        for batch in batches:
            for d, i, v in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held.setdefault(d, []).append((i, v))
                if len(held[d]) >= size:
                    yield out(d)
        for d in list(held):
            yield out(d)

    return rows.select("dims", "id", "values").mapInArrow(lean(run), "dims int, ids binary, data binary, at long")


def _started(queries: DataFrame, heads: dict[int, list[tuple]], k: int) -> DataFrame:
    """The query blocks (dims, ids, data) with ``least``: for each query the k-th best score among the head buckets."""
    sent = queries.sparkSession.sparkContext.broadcast(heads)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                dims, ids, data = (batch.column(c)[row].as_py() for c in range(3))
                if dims not in held:
                    held[dims] = [Bucket(*b, dims) for b in sent.value.get(dims, ())]
                one = Bucket(ids, data, dims)
                top = best(one, held[dims], k)
                least = np.full(len(one.ids), -np.inf)
                number = np.arange(len(top)) - np.searchsorted(top[:, 0], top[:, 0])
                kth = top[number == k - 1]
                least[kth[:, 0]] = kth[:, 2]
                again = np.empty(len(one.ids))  # the order of the ids as they were stored
                again[one.order] = least
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(row, 1) for c in range(3)] + [pa.array([again.tobytes()], pa.binary())], ["dims", "ids", "data", "least"])

    return queries.select("dims", "ids", "data").mapInArrow(lean(run), "dims int, ids binary, data binary, least binary")


def _dealing(spark, n: int):
    """A column function: a key that hash partitioning deals to partition 0 .. n - 1, for each of these numbers."""
    rows = spark.range(20 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("part")).groupBy("part").agg(F.min("id")).collect()
    keys = list(range(n))
    for part, key in rows:
        keys[part] = key
    return lambda group: F.element_at(F.array(*map(F.lit, keys)), (group + 1).cast("int")).cast("long") if n <= 1 << 12 else group.cast("long")


class Bucket:
    def __init__(self, ids: bytes, data: bytes, dims: int):
        import numpy as np

        ids, rows = np.frombuffer(ids, dtype=np.int64), np.frombuffer(data, dtype=np.int64).reshape(len(ids) // 8, dims)
        length = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        self.ids, self.rows, self.length, self.order = ids[order], rows[order], length[order], order
        self.most = float(np.abs(rows).max()) if rows.size else 0.0
        self.values = self.rows.astype(np.float64)
        self.unit = self.values / np.maximum(self.length, 1e-300)[:, None]


def products(queries: Bucket, q, bucket: Bucket, b):
    """Exact inner products of the paired rows q, b (index arrays)."""
    import numpy as np

    if queries.most * bucket.most * max(1, queries.rows.shape[1]) < 2.0**53:
        return np.einsum("ij,ij->i", queries.values[q], bucket.values[b]).astype(np.int64)
    whole = [sum(x * y for x, y in zip(u, v)) for u, v in zip(queries.rows[q].tolist(), bucket.rows[b].tolist())]
    return np.array([max(-(2**63), min(2**63 - 1, x)) for x in whole], dtype=np.int64)


def best(queries: Bucket, buckets: list[Bucket], k: int, least=None):
    """(query row, id, score) of the k best of each query among the buckets, which come longest first; lower scores than ``least`` need not
    be told."""
    import numpy as np

    n, dims = queries.rows.shape
    top = np.zeros((0, 3), dtype=np.int64)
    least = np.full(n, -np.inf) if least is None else least.copy()
    focus = np.abs(queries.unit).argmax(axis=1) if dims else np.zeros(n, dtype=int)
    qf = queries.unit[np.arange(n), focus] if dims else np.zeros(n)
    for bucket in buckets:
        longest = bucket.length[0] if len(bucket.ids) else 0.0
        reach = queries.length * longest
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach > 0, least / reach, np.where(least > 0, np.inf, -np.inf))
        live = np.flatnonzero(local <= 1 + SAFE)
        if not len(live) or not len(bucket.ids):
            continue
        by_coordinate = live[local[live] >= COORDINATE]
        by_length = live[local[live] < COORDINATE]
        q, b = [], []
        if len(by_coordinate):
            t = np.minimum(local[by_coordinate], 1.0)
            room = np.sqrt(np.maximum(0.0, (1 - qf[by_coordinate] ** 2) * (1 - t**2))) + 1e-7
            at = bucket.unit[:, focus[by_coordinate]].T
            mid = qf[by_coordinate] * t
            # a cosine above t only narrows the range on one side of the focus
            high = np.where(qf[by_coordinate] >= t, np.inf, mid + room)
            low = np.where(-qf[by_coordinate] >= t, -np.inf, mid - room)
            x, y = np.nonzero((at >= low[:, None]) & (at <= high[:, None]))
            q.append(by_coordinate[x])
            b.append(y)
        if len(by_length):
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(queries.length[by_length] > 0, least[by_length] / queries.length[by_length], -np.inf)
            count = np.searchsorted(-bucket.length, -(need - SAFE * np.abs(need)), side="right")
            count = np.where(np.isfinite(need), count, len(bucket.ids))
            x = np.repeat(np.arange(len(by_length)), count)
            y = np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
            q.append(by_length[x])
            b.append(y)
        q, b = np.concatenate(q), np.concatenate(b)
        other = queries.ids[q] != bucket.ids[b]
        q, b = q[other], b[other]
        s = products(queries, q, bucket, b)
        good = s >= least[q]
        top = np.concatenate([top, np.stack([q[good], bucket.ids[b[good]], s[good]], axis=1)])
        top = top[np.lexsort((top[:, 1], -top[:, 2].astype(object) if (top[:, 2] == -(2**63)).any() else -top[:, 2], top[:, 0]))]
        first = np.searchsorted(top[:, 0], top[:, 0])
        rank = np.arange(len(top)) - first
        top = top[rank < k]
        kth = top[rank[rank < k] == k - 1]
        least[kth[:, 0]] = np.maximum(least[kth[:, 0]], kth[:, 2])
    return top


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, id, score): for each row of ``vectors`` with ``is_query`` its k best others."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "top-k")
    fits = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.where(F.col(id).isNotNull() & fits).select(
        F.col(id).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.transform(vector, lambda x: F.floor(x.cast("double") * 256)).alias("values")
    )
    square = F.aggregate("values", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    rows = scratch.keep(rows.withColumn("dims", F.size("values")).withColumn("length", F.sqrt(square)), "rows")
    groups = max(partitions(spark), -(-rows.count() // GROUP))
    ranged = rows.repartitionByRange(groups, F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    # buckets of a task are in the order of length: one after another goes to the next group
    buckets = _blocks(ranged, BUCKET).withColumn("part", F.spark_partition_id())
    buckets = scratch.keep(buckets.withColumn("group", F.pmod(F.col("at") + F.col("part") * F.lit(7919), F.lit(groups)).cast("int")), "buckets")
    heads: dict[int, list[tuple]] = {}
    for r in buckets.where((F.col("part") == 0) & (F.col("at") < HEADS)).orderBy("dims").limit(4 * HEADS).collect():
        heads.setdefault(r.dims, []).append((bytes(r.ids), bytes(r.data)))
    buckets = buckets.select("dims", "ids", "data", "group", F.lit(None).cast("binary").alias("least"), F.lit(0).alias("role"))
    asking = rows.where("asks").dropDuplicates(["id"]).repartition(max(1, groups // 4), F.xxhash64("id")).sortWithinPartitions("id")
    asking = scratch.keep(_started(_blocks(asking, BLOCK), heads, k), "queries")
    sent = asking.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("role", F.lit(1))
    key = _dealing(spark, groups)
    dealt = buckets.unionByName(sent).withColumn("to", key(F.col("group"))).repartition(groups, "to").sortWithinPartitions("group", "dims", "role")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        now, held, ordered = None, [], False
        for batch in batches:
            for row in range(batch.num_rows):
                group, dims, role, ids, data, least = (batch.column(c)[row].as_py() for c in range(6))
                if (group, dims) != now:
                    now, held, ordered = (group, dims), [], False
                one = Bucket(ids, data, dims)
                if role == 0:
                    held.append(one)
                    continue
                if not ordered:
                    held.sort(key=lambda b: -b.length[0])
                    ordered = True
                top = best(one, held, k, np.frombuffer(least, dtype=np.float64)[one.order])
                if len(top):
                    yield pa.RecordBatch.from_arrays([pa.array(one.ids[top[:, 0]]), pa.array(top[:, 1]), pa.array(top[:, 2])], ["query_id", "id", "score"])

    found = dealt.select("group", "dims", "role", "ids", "data", "least").mapInArrow(lean(run), "query_id long, id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id), "score")
