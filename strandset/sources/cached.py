"""Revision responses of a wiki API: fetched once, kept as JSON Lines by request, read again in ranges of bytes."""

from __future__ import annotations

import io
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandset.functions.text import text_digest

#: Columns of cached responses: the request's digest, the title asked for, the response as it came or why there is none.
CACHED = "request string, title string, response string, fetch_error string"

#: What the API is asked for, beside titles and rvlimit.
ASKED = {"action": "query", "format": "json", "formatversion": "2", "redirects": "1", "prop": "revisions", "rvslots": "main", "rvprop": "ids|timestamp|sha1|size|content"}

#: Seconds waited before each try.
DELAYS = (0, 1, 3, 10)

MOVE = "array<struct<`from`:string,`to`:string>>"
PAGE = "struct<title:string,missing:boolean,revisions:array<struct<revid:long,timestamp:string,sha1:string,slots:struct<main:struct<content:string>>>>>"
RESPONSE = f"struct<query:struct<normalized:{MOVE},redirects:{MOVE},pages:array<{PAGE}>>>"


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    request: str


class CachedReader(DataSourceReader):
    """Files are cut into ranges of bytes; a line belongs to the range in which it starts."""

    def __init__(self, path: str, request: str | None, split: int):
        self.path, self.request, self.split = path, request, split

    def partitions(self):
        system, root = pyarrow.fs.FileSystem.from_uri(self.path)
        folder = f"{root}/request={self.request}" if self.request else root
        out = []
        for info in system.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True, recursive=True)):
            request = next((p[8:] for p in info.path.split("/") if p.startswith("request=")), None)
            if info.is_file and request and not info.base_name.startswith(("_", ".")):
                out += [Range(info.path, at, min(at + self.split, info.size), request) for at in range(0, info.size, self.split)]
        return out or [Range("", 0, 0, "")]

    def read(self, partition):
        if not partition.file:
            return
        system, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        with io.BufferedReader(system.open_input_file(partition.file), 1 << 20) as lines:
            at = partition.start
            if at:
                lines.seek(at - 1)
                at += len(lines.readline()) - 1
            rows, size = [], 0
            while at < partition.end and (line := lines.readline()):
                at += len(line)
                if not line.endswith(b"\n") and not _whole(line):
                    break
                if line.strip():
                    one = json.loads(line)
                    rows.append({"request": partition.request, **{c: one.get(c) for c in ("title", "response", "fetch_error")}})
                    size += len(line)
                if size > 1 << 22:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _whole(line: bytes) -> bool:
    """A last line without its end may be whole or torn."""
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([(c.split()[0], pa.string()) for c in CACHED.split(", ")]))


class CachedResponses(DataSource):
    """Options: path (a folder or a URI that pyarrow opens), request (only that one's folder is listed and read), split (bytes of a partition)."""

    @classmethod
    def name(cls):
        return "cached_responses"

    def schema(self):
        return CACHED

    def reader(self, schema):
        return CachedReader(self.options["path"], self.options.get("request"), int(self.options.get("split", 64 << 20)))


def responses(spark: SparkSession, cache: str, request: str | None = None, split: int = 64 << 20) -> DataFrame:
    """What a cache holds, for one request or all: a row for each try of a page. No cache, no rows; a torn last line is left out."""
    spark.dataSource.register(CachedResponses)
    reader = spark.read.format("cached_responses").option("split", str(split))
    return (reader.option("request", request) if request else reader).load(cache)


def request_digest(profiles: DataFrame, revisions: int) -> str:
    """Digest of a request: of how many revisions, and of the rows of ``profiles`` in whatever order, repeats counted.

    Digests of rows meet in 65,536 groups, whose digests meet in one row of at most 4 MB; the driver sees that row's digest alone."""
    one = text_digest(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(profiles.columns)]), {"ignoreNullFields": "false"}))
    each = profiles.groupBy(one.alias("d")).count().select(F.substr("d", F.lit(1), F.lit(4)).alias("bucket"), F.concat_ws(":", "d", "count").alias("d"))
    joined = lambda c: text_digest(F.array_join(F.array_sort(F.collect_list(c)), "\n"))
    whole = each.groupBy("bucket").agg(joined("d").alias("d")).agg(joined("d").alias("d"))
    return whole.select(text_digest(F.concat_ws(":", F.lit(revisions), "d"))).first()[0]


def http_fetch(endpoint: str, agent: str, timeout: float = 30) -> Callable[[str, int], str]:
    """A function (title, revisions) that asks an API at ``endpoint``: one title at a time, since several may not ask for several revisions each."""

    def fetch(title: str, revisions: int) -> str:
        asked = urllib.parse.urlencode(ASKED | {"titles": title, "rvlimit": str(revisions)})
        with urllib.request.urlopen(urllib.request.Request(f"{endpoint}?{asked}", headers={"User-Agent": agent}), timeout=timeout) as answer:
            return answer.read().decode("utf-8")

    return fetch


def _tried(fetch: Callable[[str, int], str], title: str, revisions: int, delays: tuple[float, ...]) -> tuple[str, str | None, str | None]:
    why = "no try"
    for delay in delays:
        time.sleep(delay)
        try:
            text = fetch(title, revisions)
            said = json.loads(text)
            if "error" not in said:
                return title, text, None
            why = f"API error: {said['error']}"
        except (OSError, ValueError, RuntimeError) as e:  # no connection, time out, no JSON
            why = str(e) or type(e).__name__
    return title, None, why


def fetch_missing(profiles: DataFrame, fetch: Callable[[str, int], str], cache: str, revisions: int = 5, delays: tuple[float, ...] = DELAYS, tasks: int = 1) -> str:
    """Fetches the pages of ``profiles`` (title, …) that the cache lacks for this request, and returns the request's digest.

    Another number of revisions or other profiles make another request, which reuses nothing. Pages that failed before are tried again; a title asked for
    twice is fetched once, one that is null never. Where nothing is missing nothing is fetched or written. At most ``tasks`` pages are fetched at a
    time. Responses become visible when the job commits; if it is lost, its pages are fetched again the next time."""
    spark = profiles.sparkSession
    request = request_digest(profiles, revisions)
    have = responses(spark, cache, request).where("response is not null").select("title").distinct()
    wanted = profiles.where("title is not null").select("title").distinct().join(have, "title", "left_anti")
    if wanted.isEmpty():
        return request

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for title in batch["title"]:
                yield pd.DataFrame([_tried(fetch, title, revisions, delays)], columns=["title", "response", "fetch_error"])

    found = wanted.repartition(tasks, "title").mapInPandas(run, "title string, response string, fetch_error string")
    found.withColumn("request", F.lit(request)).write.mode("append").partitionBy("request").json(cache)
    return request


def failed(tries: DataFrame) -> DataFrame:
    """(request, title, fetch_error) of pages with no response at all; the least of their errors."""
    each = tries.groupBy("request", "title").agg(F.min("fetch_error").alias("fetch_error"), F.count("response").alias("n"))
    return each.where("n = 0").drop("n")


def parsed_pages(tries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, moves) of one request's responses, as ``resolved_pages`` takes them: a row for each revision (one with null revid for a page without any),
    and (response, from, to, redirect). A page fetched twice counts once."""
    one = tries.where("response is not null").groupBy("title").agg(F.max("response").alias("response"))
    one = one.select(F.col("title").alias("response"), F.from_json("response", RESPONSE).alias("x"))
    page = one.select("response", F.explode("x.query.pages").alias("p"))
    page = page.select("response", "p.title", "p.missing", F.explode_outer("p.revisions").alias("r"))
    pages = page.select("response", "title", "missing", "r.revid", "r.timestamp", "r.sha1", F.col("r.slots.main.content").alias("content"))
    move = lambda name, redirect: one.select("response", F.inline(f"x.query.{name}")).withColumn("redirect", F.lit(redirect))
    return pages, move("redirects", True).unionByName(move("normalized", False))
