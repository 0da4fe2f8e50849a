"""A feed of changed contexts that keeps cached results fresh (an extension; the studied operators are batch only)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandset.operators.lineage import refresh

#: What a question's state holds: its cached result and the context version it was bound to, the newest context and its version,
#: and whether an action on this pair has been given.
STATE = "cached string, bound long, context string, version long, told boolean"
JOINED = "qid string, version long, cached string, context string"


def _newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    cached, bound, context, version, told = state.get if state.exists else (None, None, None, None, False)
    before = bound, version
    for frame in frames:
        for is_result, number, body in zip(frame["is_result"], frame["version"], frame["body"]):
            if is_result and (bound is None or (number, body) > (bound, cached)) and number != before[0]:
                cached, bound, told = body, int(number), False
            elif not is_result and (version is None or (number, body) > (version, context)) and number != before[1]:
                context, version, told = body, int(number), False
    ready = not told and cached is not None and context is not None and version > bound
    state.update((cached, bound, context, version, told or ready))
    if ready:
        yield pd.DataFrame([(key[0], version, cached, context)], columns=["qid", "version", "cached", "context"])


def joined_feed(changes: DataFrame, cached: DataFrame) -> DataFrame:
    """(qid, version, cached, context): for each question the newest context beside the cached result it bears on, once, from two streams.

    State is kept by question, so a micro-batch reads and writes the questions it holds and no others. A context older than one already seen, or not newer
    than the one that the result was bound to, gives nothing, whenever it comes; the first of two with equal versions stays (within a batch the greater text). A
    context without a result waits for it. Results and contexts go through JSON; rows with null qid or version are left out."""
    body = lambda rows: F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in ("qid", "version")]))
    part = lambda rows, is_result: rows.where("qid is not null and version is not null").select(
        F.col("qid").cast("string").alias("qid"), F.lit(is_result).alias("is_result"), F.col("version").cast("long").alias("version"), body(rows).alias("body")
    )
    both = part(cached, True).unionByName(part(changes, False))
    return both.groupBy("qid").applyInPandasWithState(_newest, JOINED, STATE, "append", GroupStateTimeout.NoTimeout)


def refresh_feed(changes: DataFrame, cached: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Actions on cached results as contexts change, appended to ``sink`` as Parquet (qid, version, action, new_answer, batch).

    Two streams: ``changes`` (qid, version, question, documents) and ``cached`` (qid, version of the context it was bound to, dataset, program,
    cached_answer, snapshot); a result that was bound anew is sent again with its new version. Each batch puts its own folder in place, so
    that one that runs twice after a failure leaves its rows once."""
    context, result = (rows.drop("qid", "version").schema for rows in (changes, cached))

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.select("qid", "version", F.from_json("cached", result).alias("r"), F.from_json("context", context).alias("c"))
        done = refresh(rows.select("qid", "version", "r.dataset", "r.program", "r.cached_answer", "r.snapshot", "c.question", "c.documents"))
        done.select("qid", "version", "action", "new_answer").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return joined_feed(changes, cached).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
