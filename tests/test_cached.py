import json
import os
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from strandset.operators import revisions
from strandset.sources.cached import _tried, failed, fetch_missing, http_fetch, parsed_pages, request_digest, responses
from strandset.sources.jsonl import write_jsonl

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import tests
LONG = "a line of the page that is long enough to be a cell, "


def page(title, count, **query):
    found = [{"revid": i, "timestamp": f"2020-01-0{i}T00:00:00Z", "sha1": f"s{i}", "slots": {"main": {"content": f"{LONG}one\n{LONG}{i}"}}} for i in range(count, 0, -1)]
    return json.dumps({"query": {"pages": [{"title": title, "revisions": found}], **query}})


def fake(log, broken=()):
    """A fetch that notes in a folder what it was asked; Spark's tasks run it."""

    def fetch(title, count):
        with open(os.path.join(log, f"{title}-{count}"), "a") as f:
            f.write("x")
        if title in broken:
            raise OSError("no route")
        if title == "gone":
            return json.dumps({"query": {"pages": [{"title": "gone", "missing": True}]}})
        if title == "old name":
            return page("New name", count, redirects=[{"from": "old name", "to": "New name"}])
        return page(title, count)

    return fetch


def asked(log):
    return {f: os.path.getsize(os.path.join(log, f)) for f in os.listdir(log)}


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "log").mkdir()
    return str(tmp_path / "cache"), str(tmp_path / "log")


def wanted(spark, *titles):
    return spark.createDataFrame([("d", t, 1, 9) for t in titles], "dataset string, title string, dependency_cells int, context_cells int")


def files(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs)


def test_second_run_adds_nothing(spark, folders):
    cache, log = folders
    profiles = wanted(spark, "a", "b", "b", None)
    assert responses(spark, cache, "none").count() == 0
    first = fetch_missing(profiles, fake(log), cache, 2, (0,), 2)
    assert asked(log) == {"a-2": 1, "b-2": 1}
    before = files(cache)
    assert fetch_missing(profiles.orderBy(F.desc("title")), fake(log), cache, 2, (0,), 2) == first
    assert asked(log) == {"a-2": 1, "b-2": 1} and files(cache) == before
    assert sorted((r.request, r.title) for r in responses(spark, cache).collect()) == [(first, "a"), (first, "b")]


def test_changed_request_reuses_nothing(spark, folders):
    cache, log = folders
    one = fetch_missing(wanted(spark, "a", "b"), fake(log), cache, 2, (0,))
    more = fetch_missing(wanted(spark, "a", "b"), fake(log), cache, 3, (0,))
    other = fetch_missing(wanted(spark, "a", "c"), fake(log), cache, 2, (0,))
    assert len({one, more, other}) == 3 and asked(log) == {"a-2": 2, "b-2": 1, "a-3": 1, "b-3": 1, "c-2": 1}
    assert sorted(r.title for r in responses(spark, cache, other).collect()) == ["a", "c"]
    assert request_digest(wanted(spark), 2) != request_digest(wanted(spark, "a"), 2) != request_digest(wanted(spark, "a", "a"), 2)


def test_failed_pages_are_tried_again(spark, folders):
    cache, log = folders
    profiles = wanted(spark, "a", "b", "c")
    request = fetch_missing(profiles, fake(log, ("b", "c")), cache, 2, (0, 0))
    assert asked(log) == {"a-2": 1, "b-2": 2, "c-2": 2}
    assert sorted(tuple(r) for r in failed(responses(spark, cache)).collect()) == [(request, "b", "no route"), (request, "c", "no route")]
    assert fetch_missing(profiles, fake(log, ("c",)), cache, 2, (0,)) == request
    assert asked(log) == {"a-2": 1, "b-2": 3, "c-2": 3}
    assert [r.title for r in failed(responses(spark, cache, request)).collect()] == ["c"]


def test_ranges_of_bytes_read_each_line_once(spark, tmp_path):
    folder = tmp_path / "cache" / "request=r"
    folder.mkdir(parents=True)
    lines = [json.dumps({"title": f"t{i}", "response": "é" * (i % 7)}, ensure_ascii=False) for i in range(50)]
    (folder / "part-0.json").write_text("\n".join(lines) + '\n\n{"title": "torn", "resp')
    (folder / "_SUCCESS").write_text("")
    (folder / "part-1.json").write_text('{"title": "whole"}')
    for split in (1, 7, 64, 1 << 20):
        got = responses(spark, str(tmp_path / "cache"), "r", split)
        assert sorted(r.title for r in got.collect()) == sorted([f"t{i}" for i in range(50)] + ["whole"])
    assert responses(spark, f"file://{tmp_path}/cache").count() == 51


def test_fetched_pages_to_a_report(spark, folders):
    cache, log = folders
    profiles = wanted(spark, "a", "old name", "gone", "c")
    request = fetch_missing(profiles, fake(log, ("c",)), cache, 3, (0,))
    tries = responses(spark, cache, request)
    pages = revisions.resolved_pages(*parsed_pages(tries), profiles)
    events = revisions.stream_events(pages)
    got = {r.title: r for r in revisions.page_summaries(pages, events).collect()}
    assert {k: (r.requested, r.revisions, r.events) for k, r in got.items()} == {"a": ("a", 3, 2), "New name": ("old name", 3, 2)}
    assert sorted(r.title for r in revisions.unresolved(profiles, pages).collect()) == ["c", "gone"]
    r = revisions.stream_summary(profiles, pages, events, failed(tries)).first()
    assert (r.requested_titles, r.resolved_pages, r.pages_with_two_revisions, r.fetch_errors, r.unresolved_titles, r.events) == (4, 2, 2, 1, 2, 4)
    none = revisions.stream_summary(profiles.limit(0), pages.limit(0), events.limit(0)).first()
    assert (none.requested_titles, none.resolved_pages, none.events, none.recomputations, none.recompute_rate, none.fetch_errors) == (0, 0, 0, 0, 0, 0)


def test_http_fetch_and_retries():
    calls = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            calls.append((parse_qs(urlparse(self.path).query), self.headers["User-Agent"]))
            self.send_response(500 if len(calls) == 1 else 200)
            self.end_headers()
            self.wfile.write(b'{"error": "slow down"}' if len(calls) == 2 else b"no json" if len(calls) == 3 else page("A b", 1).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    fetch = http_fetch(f"http://127.0.0.1:{server.server_port}/api", "tests")
    title, text, why = _tried(fetch, "A b", 4, (0, 0, 0, 0))
    assert (title, why, json.loads(text)) == ("A b", None, json.loads(page("A b", 1))) and len(calls) == 4
    assert calls[0][0]["titles"] == ["A b"] and calls[0][0]["rvlimit"] == ["4"] and calls[0][1] == "tests"
    server.shutdown()
    server.server_close()
    assert _tried(fetch, "A b", 4, (0,))[1] is None


def test_ordered_file(spark, tmp_path):
    path = str(tmp_path / "out.jsonl")
    rows = spark.range(3000).select(F.when(F.col("id") % 11 > 0, (F.col("id") * 37) % 1000).alias("k"), F.lit("zoë\n").alias("line"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("a.b")).repartition(9)
    same = spark.range(2000).select(F.lit(500).cast("long").alias("k"), F.lit("same").alias("line"), F.lit(None).cast("long").alias("a.b"))
    write_jsonl(rows.unionByName(same), path, "k")
    got = [json.loads(x) for x in open(path, encoding="utf-8")]
    want = [{"k": r[0], "line": r[1], "a.b": r[2]} for r in rows.unionByName(same).collect()]
    keyed = lambda r: (r["k"] is not None, r["k"] or 0)
    assert [r["k"] for r in got] == [r["k"] for r in sorted(want, key=keyed)]
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, want)) and os.listdir(tmp_path) == ["out.jsonl"]
    write_jsonl(rows.limit(0), path, "k")
    assert open(path).read() == ""


def test_a_failing_task_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "out.jsonl")
    rows = spark.range(100).select("id")
    write_jsonl(rows, path, "id")
    old = open(path).read()
    with pytest.raises(Exception, match="bad row"):
        write_jsonl(rows.select(F.when(F.col("id") == 70, F.raise_error(F.lit("bad row")).cast("long")).otherwise(-F.col("id")).alias("id")), path, "id")
    assert open(path).read() == old and os.listdir(tmp_path) == ["out.jsonl"]


def test_a_task_that_fails_while_it_writes(spark, tmp_path):
    """Here the failure comes in a writer, after others have put their lines into the draft."""
    from strandset.sources.jsonl import PlacedLines

    path, draft = str(tmp_path / "out.jsonl"), str(tmp_path / ".draft")
    open(path, "w").write("old\n")
    open(draft, "w").close()
    spark.dataSource.register(PlacedLines)
    rows = spark.range(0, 8, 1, 4).select((F.col("id") * 2).alias("at"), F.when(F.col("id") == 7, F.raise_error(F.lit("bad line")).cast("binary")).otherwise(F.encode(F.lit("x\n"), "UTF-8")).alias("line"))
    with pytest.raises(Exception, match="bad line"):
        rows.write.format("placed_lines").option("draft", draft).mode("append").save(path)
    assert open(path).read() == "old\n" and os.listdir(tmp_path) == ["out.jsonl"]
