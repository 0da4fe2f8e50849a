"""Revision histories: consecutive pairs, lost cells, and what a history asks of cached results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandset.functions.text import normalize, normalize_all, strip_wiki, text_digest, wiki_cells


def streams(rows: DataFrame, title: str = "title", id: str = "revid", time: str = "timestamp", line: str = "line") -> DataFrame:
    """One row for each revision id of a title, the last one read."""
    return rows.groupBy(title, id).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (title, id)]), line).alias("x")).select(title, id, "x.*")


def _once_each(rows: DataFrame, *key: str) -> DataFrame:
    """One row for each revision, the last one read where rows have a line (else the latest), so that a revision fetched twice makes no pair with itself."""
    rest = [c for c in ("timestamp", "sha1", "content") if c in rows.columns]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "line" if "line" in rows.columns else F.struct(*rest)).alias("x")).select(*key, "x.*")


def pairs(rows: DataFrame, title: str = "title", id: str = "revid", time: str = "timestamp", value: str = "content") -> DataFrame:
    """Consecutive revisions of each title: (title, revid, next_revid, old, new)."""
    w = W.partitionBy(title).orderBy(time, id)
    nexts = rows.withColumns({"next_revid": F.lead(id).over(w), "new": F.lead(value).over(w)})
    return nexts.where("next_revid is not null").select(title, id, "next_revid", F.col(value).alias("old"), "new")


def lost_cells(changes: DataFrame, k: int, seed: Column) -> DataFrame:
    """Adds read (k cells of the old revision, those with the lowest digest) and recompute (one of them is gone).

    ``changes`` has arrays old and new."""
    order = lambda c: F.struct(text_digest(F.concat_ws(":", seed, c)).alias("d"), c.alias("c"))
    read = F.transform(F.slice(F.array_sort(F.transform("old", order)), 1, k), lambda s: s["c"])
    return changes.withColumn("read", read).withColumn("recompute", F.size(F.array_except("read", "new")) > 0)


def resolved_pages(pages: DataFrame, moves: DataFrame, profiles: DataFrame, order: str = "dataset") -> DataFrame:
    """Pages joined with the profile that asked for them: by the title that was redirected or, else, normalised to theirs, else by their own. Of several
    profiles of a title the last by ``order`` counts, so that a page asked for twice has its events once.

    ``pages``: (response, title, missing, …), a row for each revision; ``moves``: (response, from, to, redirect), ``profiles``: (dataset, title, dependency_cells)."""
    one = lambda redirect, name: moves.where(F.col("redirect") == redirect).groupBy("response", F.col("to").alias("title")).agg(F.max("from").alias(name))
    rows = pages.where(~F.coalesce("missing", F.lit(False))).join(one(True, "__r"), ["response", "title"], "left").join(one(False, "__n"), ["response", "title"], "left")
    rows = rows.withColumn("__asked", F.coalesce("__r", "__n", "title"))
    one_each = profiles.groupBy("title").agg(F.max_by(F.struct("dataset", "title", "dependency_cells"), F.struct(order, "dataset")).alias("x"))
    p = lambda name: one_each.select(F.col("title").alias(f"__{name}"), F.col("x").alias(f"__p{name}"))
    rows = rows.join(p("asked"), "__asked", "left").join(p("own"), F.col("title") == F.col("__own"), "left")
    profile = F.coalesce("__pasked", "__pown")
    rows = rows.where(profile.isNotNull()).withColumns({"dataset": profile["dataset"], "requested": profile["title"], "dependency_cells": profile["dependency_cells"]})
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def stream_events(rows: DataFrame) -> DataFrame:
    """One row for each pair of consecutive revisions of a page whose older one has cells: selected cells (``dependency_cells`` of the old ones
    by digest), lost ones, page_changed, and the timestamps. ``rows``: (dataset, requested, title, dependency_cells, revid, timestamp, sha1, content)."""
    rows = _once_each(rows, "dataset", "requested", "title", "dependency_cells", "revid")
    w = W.partitionBy("dataset", "title").orderBy("timestamp", "revid")
    known = ("revid", "timestamp", "sha1", "__cells")
    own = rows.withColumn("__cells", wiki_cells(F.coalesce("content", F.lit("")))).select("dataset", "requested", "title", "dependency_cells", *known)
    own = own.withColumn("__next", F.lead(F.struct(*known)).over(w)).where(F.col("__next").isNotNull() & (F.size("__cells") > 0))
    seed = F.concat_ws(":", "title", "revid")
    order = lambda c: F.struct(text_digest(F.concat_ws(":", seed, c)).alias("d"), c.alias("c"))
    own = own.withColumn("__read", F.transform(F.slice(F.array_sort(F.transform("__cells", order)), F.lit(1), F.col("dependency_cells").cast("int")), lambda x: x["c"]))
    return own.select(
        "dataset", "requested", "title", "revid", F.col("__next.revid").alias("next_revid"), F.size("__read").cast("long").alias("selected"),
        F.size(F.array_except("__read", "__next.__cells")).cast("long").alias("lost"), (~F.col("sha1").eqNullSafe(F.col("__next.sha1"))).alias("page_changed"),
        F.least("timestamp", "__next.timestamp").alias("earliest"), F.greatest("timestamp", "__next.timestamp").alias("latest"),
    )


def stream_report(events: DataFrame, *by: str) -> DataFrame:
    """Events, changed pages, selected and lost cells, recomputations and rates, over all events or by group (dataset, say)."""
    n = lambda c: F.sum(c.cast("long"))
    whole = F.greatest(F.count("*"), F.lit(1))
    again = F.col("lost") > 0
    return events.groupBy(*by).agg(
        F.count("*").alias("events"), n(F.col("page_changed")).alias("changed_events"), F.sum("selected").alias("selected_cells"), F.sum("lost").alias("changed_cells"), n(again).alias("recomputations"),
        (100.0 * n(again) / whole).alias("recompute_rate"), (100.0 * n(F.col("page_changed")) / whole).alias("document_recompute_rate"), F.min("earliest").alias("earliest"), F.max("latest").alias("latest"),
    )


def page_summaries(pages: DataFrame, events: DataFrame) -> DataFrame:
    """(dataset, requested, title, dependency_cells, revisions, events, recomputations): one row for each page that ``resolved_pages`` found, those without
    events too. A revision fetched twice counts once."""
    own = pages.groupBy("dataset", "requested", "title", "dependency_cells").agg(F.count_distinct("revid").alias("revisions"))
    told = events.groupBy("dataset", "requested", "title").agg(F.count("*").alias("events"), F.sum((F.col("lost") > 0).cast("long")).alias("recomputations"))
    return own.join(told, ["dataset", "requested", "title"], "left").na.fill(0, ["events", "recomputations"])


def unresolved(profiles: DataFrame, pages: DataFrame) -> DataFrame:
    """(title): titles of ``profiles`` for which no page came."""
    return profiles.where("title is not null").select("title").distinct().join(pages.select(F.col("requested").alias("title")).distinct(), "title", "left_anti")


def stream_summary(profiles: DataFrame, pages: DataFrame, events: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row: titles asked for, pages found, those with two revisions or more, titles without a page, failed fetches (rows of ``errors``), and the fields of
    ``stream_report`` with the share of events that cells spare. Without events its counts and rates are 0 and its timestamps null."""
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    found = page_summaries(pages, events).agg(F.count("*").alias("resolved_pages"), F.count_if(F.col("revisions") > 1).alias("pages_with_two_revisions"))
    parts = [count(profiles.where("title is not null").select("title").distinct(), "requested_titles"), found, count(unresolved(profiles, pages), "unresolved_titles"), stream_report(events)]
    if errors is not None:
        parts.append(count(errors, "fetch_errors"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    whole = whole.agg(*[F.max(c).alias(c) for c in whole.columns])
    if errors is None:
        whole = whole.withColumn("fetch_errors", F.lit(0).cast("long"))
    whole = whole.na.fill(0, [c for c, kind in whole.dtypes if kind in ("bigint", "double")])
    return whole.withColumn("spared", F.when(F.col("events") > 0, 100.0 - F.col("recompute_rate")).otherwise(0.0))


def linked_documents(bound: DataFrame) -> DataFrame:
    """(dataset, qid, title, sentences, quotes) of each document that a certified program cites: its cited sentences, and the quotes that the
    program reads in it or joins to it."""
    program, documents = F.col("program"), F.col("documents")
    a = program["answer"]
    points = F.concat(F.filter(F.array(a["pointer"]), lambda p: p.isNotNull()), a["operands"], a["labels"], F.transform(program["joins"], lambda j: j["left"]))
    rows = bound.where("result.certified").withColumn("__doc", F.explode(F.array_distinct(F.transform(program["evidence"], lambda r: r["doc"]))))
    doc = F.col("__doc")
    sentences = F.transform(F.filter(program["evidence"], lambda r: r["doc"] == doc), lambda r: F.get(F.get(documents, r["doc"])["sentences"], r["sent"]))
    read = F.transform(F.filter(points, lambda p: p["doc"] == doc), lambda p: p["quote"])
    joined = F.transform(F.filter(program["joins"], lambda j: j["right_doc"] == doc), lambda j: j["left"]["quote"])
    quotes = F.array_sort(F.array_distinct(F.filter(F.concat(read, joined), lambda q: q != "")))
    rows = rows.select("dataset", "qid", F.get(documents, doc)["title"].alias("title"), sentences.alias("sentences"), quotes.alias("quotes"))
    return rows.where((F.size("sentences") > 0) & (F.size("quotes") > 0))


def history_events(linked: DataFrame, revisions: DataFrame) -> DataFrame:
    """(dataset, qid, title, revid, next_revid, page_changed, action) for each linked document and pair of revisions of its title whose older
    one holds all its sentences and quotes. ``revisions``: (title, revid, timestamp, sha1, content).

    Pages are stripped and folded once each, before the join; consecutive ones are paired within a title, so a program meets
    only the pairs of its own titles."""
    revisions = _once_each(revisions, "title", "revid")
    pages = revisions.withColumn("folded", normalize(strip_wiki(F.coalesce("content", F.lit(""))))).select("title", "revid", "timestamp", F.struct("folded", "sha1").alias("page"))
    steps = pairs(pages, value="page").withColumnsRenamed({"old": "__old", "new": "__new"})
    rows = linked.withColumns({"__sentences": normalize_all("sentences"), "__quotes": normalize_all("quotes")}).join(steps, "title")
    holds = lambda parts, text: F.forall(parts, lambda x: F.contains(text, x))
    rows = rows.where(holds("__sentences", F.col("__old.folded")) & holds("__quotes", F.col("__old.folded")))
    changed = ~F.col("__old.sha1").eqNullSafe(F.col("__new.sha1"))
    action = F.when(~changed | holds("__sentences", F.col("__new.folded")), "reuse").when(holds("__quotes", F.col("__new.folded")), "replay").otherwise("recompile")
    return rows.select("dataset", "qid", "title", "revid", "next_revid", changed.alias("page_changed"), action.alias("action"))


def history_report(events: DataFrame) -> DataFrame:
    """Events, changed ones, actions and their rates, and the share of changed events that cells spare a document gate."""
    n = lambda c: F.sum(c.cast("long"))
    changed, whole = n(F.col("page_changed")), F.greatest(F.count("*"), F.lit(1))
    did = {a: n(F.col("action") == a) for a in ("reuse", "replay", "recompile")}
    return events.agg(
        F.count("*").alias("events"), F.count_distinct("qid", "title").alias("bound_documents"), changed.alias("changed_events"), *[v.alias(a) for a, v in did.items()], *[(100.0 * v / whole).alias(f"{a}_rate") for a, v in did.items()],
        (100.0 * (changed - did["recompile"]) / F.greatest(changed, F.lit(1))).alias("spared"),
    )


def history_action(sentences: Column, quotes: Column, old: Column, new: Column) -> Column:
    """reuse where the page is unchanged or all read sentences persist, replay where the quotes do, else recompile."""
    holds = lambda parts: F.forall(parts, lambda x: F.contains(new, x))
    return F.when((old == new) | holds(sentences), "reuse").when(holds(quotes), "replay").otherwise("recompile")


def title_profiles(bound: DataFrame, k: int) -> DataFrame:
    """(dataset, title, dependency_cells, context_cells): rounded medians over the certified results that cite a title, for the k titles
    with the lowest digest."""
    from strandset.operators.updates import all_cells, dependencies

    rows = bound.where("result.certified").withColumns({"deps": F.size(dependencies(F.col("snapshot"))), "cells": F.size(all_cells(F.col("documents")))})
    titles = F.array_distinct(F.transform(F.col("program.evidence"), lambda r: F.get(F.col("documents"), r["doc"])["title"]))
    rows = rows.select("dataset", F.explode(titles).alias("title"), "deps", "cells")
    found = rows.groupBy("dataset", "title").agg(F.bround(F.percentile("deps", 0.5)).cast("int").alias("dependency_cells"), F.bround(F.percentile("cells", 0.5)).cast("int").alias("context_cells"))
    return found.orderBy(text_digest(F.concat_ws(":", "dataset", "title"))).limit(k)
