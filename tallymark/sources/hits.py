"""A Spark data source over recorded search replies, with the connectors' parameters and caps.

    hits.load(spark, folder, connector="code")
    spark.readStream.format("tally_hits").option("path", folder).load()  # once registered

A recording is a file of JSON lines, each a query and its items, for one connector: one whose name begins with the
connector's (code.jsonl, code-2.jsonl) or that lies in a folder connector=code. Files are found and read through
pyarrow's file systems, so path may be a URI of any of them, and are split by bytes: a line belongs to the split that it
begins in. Filters on query, connector and the least count are taken over by the reader, in any number, where the
session has spark.sql.python.filterPushdown.enabled and the option pushdown=true asks for it; else Spark applies them. Ask only for a table that is
read under one set of filters: all that is made of one load() shares one reader, so the filters of one part would hold for the others. A stream reads the whole lines that
files have gained since its last offset, which has a number for each file.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
)

SCHEMA = "connector string, query string, seq long, id string, url string, title string, body string, count long, comments array<string>, truncated int, file string"
ARROW = pa.schema(
    [(n, pa.string()) for n in ("connector", "query")]
    + [("seq", pa.int64())]
    + [(n, pa.string()) for n in ("id", "url", "title", "body")]
    + [("count", pa.int64()), ("comments", pa.list_(pa.string())), ("truncated", pa.int32()), ("file", pa.string())]
)
#: Bytes of a split, rows of an Arrow batch, bytes read at once when the last line's end is looked for.
SPLIT_BYTES, BATCH_ROWS, TAIL_BYTES = 64 << 20, 4096, 1 << 16
#: Of each connector: id keys, URL keys, body keys, count key. Fixed values.
SHAPES = {
    "code": (("id",), ("html_url", "url"), ("body",), "stars"),
    "forum": (("objectID",), ("url", "story_url"), ("body", "story_text", "comment_text", "title"), "points"),
    "citation": (("id", "doi"), ("doi", "id"), ("body", "abstract", "title"), "cited_by_count"),
}


def search_params(connector: str, query: str, least: int | None = None, since: str | None = None, given: str | None = None) -> dict:
    """The parameters of a search as each service wants them: >= for forum points, strictly > for citations."""
    if connector == "forum":
        filters = [f for f in (given, f"points>={least}" if least is not None else None) if f]
        return {"query": query} | ({"numericFilters": ",".join(filters)} if filters else {})
    if connector == "citation":
        filters = [f for f in (given, f"cited_by_count:>{least}" if least is not None else None, f"from_publication_date:{since}" if since else None) if f]
        return {"search": query} | ({"filter": ",".join(filters)} if filters else {})
    words = [query, given, f"stars:>={least}" if least is not None else None, f"pushed:>={since}" if since else None]
    return {"q": " ".join(w for w in words if w)}


def _first(item: dict, keys: tuple[str, ...]) -> str | None:
    return next((str(item[k]) for k in keys if item.get(k)), None)


def _first(item: dict, keys: tuple[str, ...]) -> str | None:
    return next((str(item[k]) for k in keys if item.get(k)), None)


def _files(path: str) -> tuple[fs.FileSystem, dict[str, tuple[str, int]]]:
    """The file system of a path, and connector and size of each recording below it."""
    system, root = fs.FileSystem.from_uri(path)
    found = {}
    for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        folders, _, name = f.path[len(root) :].rpartition("/")
        if f.type != fs.FileType.File or name[:1] in "._":
            continue
        named = re.search(r"connector=(\w+)", folders) or re.match(r"([a-z]+)[^/]*\.jsonl$", name)
        if named and named[1] in SHAPES:
            found[f.path] = named[1], f.size
    return system, found


class _Part(InputPartition):
    """The lines of a file that begin in [start, end)."""

    def __init__(self, path: str, connector: str, start: int, end: int):
        self.path, self.connector, self.start, self.end = path, connector, start, end


class _Lines:
    """What the batch and the stream reader share: options, splits, and rows of a split."""

    def __init__(self, options: dict):
        self.path, self.connector = options["path"], options.get("connector")
        self.chars, self.most = int(options.get("max_chars", 1500)), int(options.get("max_comments", 10))
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        if self.split < 1:
            raise ValueError("split_bytes must be positive")
        #: What a filter has left of queries and connectors (None: all), and the least count.
        self.queries: set | None = None
        self.connectors: set | None = {self.connector} if self.connector else None
        self.least: int | None = None

    def splits(self, path: str, connector: str, start: int, end: int) -> list[_Part]:
        return [_Part(path, connector, a, min(a + self.split, end)) for a in range(start, end, self.split)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        rows: list[tuple] = []
        with system.open_input_file(part.path) as raw:
            # The byte before the split says whether its first line begins there or in the split before.
            at = max(part.start - 1, 0)
            raw.seek(at)
            lines = io.BufferedReader(raw, 1 << 20)
            if part.start:
                at += len(lines.readline())
            while at < part.end:
                line = lines.readline()
                if not line:
                    break
                if line.strip():
                    rows += self._rows(part, at, line)
                at += len(line)
                if len(rows) >= BATCH_ROWS:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)

    def _rows(self, part: _Part, at: int, line: bytes) -> Iterator[tuple]:
        """Items of a reply; seq is the reply's byte in its file and the item's place after it, so it rises along the file."""
        try:
            reply = json.loads(line)
        except ValueError as e:
            raise ValueError(f"{part.path}: no JSON in the line at byte {at}") from e
        query = reply.get("query")
        if self.queries is not None and query not in self.queries:
            return
        ids, urls, bodies, count = SHAPES[part.connector]
        for k, item in enumerate(reply.get("items") or (), 1):
            n = item.get(count)
            n = int(n) if isinstance(n, (int, float)) else None
            if self.least is not None and (n is None or n < self.least):
                continue
            body, said = _first(item, bodies), item.get("comments")
            said = said if isinstance(said, list) else []
            url = _first(item, urls) or (f"https://news.ycombinator.com/item?id={item['objectID']}" if part.connector == "forum" and item.get("objectID") else None)
            yield (
                part.connector, query, at + k, _first(item, ids), url, item.get("title"), body and body[: self.chars], n,
                [str(c)[: self.chars] for c in said[: self.most]], int(bool(body) and len(body) > self.chars) + max(len(said) - self.most, 0), part.path,
            )


class HitReader(_Lines, DataSourceReader):
    def partitions(self) -> list[_Part]:
        if self.queries == set():
            return []
        _, files = _files(self.path)
        wanted = [(p, c, n) for p, (c, n) in sorted(files.items()) if self.connectors is None or c in self.connectors]
        return [s for p, c, n in wanted for s in self.splits(p, c, 0, n)]


class HitFilterReader(HitReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what narrows queries, connectors and the least count, each filter on top of those before; the rest goes back to Spark."""
        for f in filters:
            # Filters of filters, as Not, name no column.
            attribute = getattr(f, "attribute", ())
            name = attribute[0] if len(attribute) == 1 else None
            if name in ("query", "connector") and isinstance(f, (EqualTo, In)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                kept = self.queries if name == "query" else self.connectors
                kept = values - {None} if kept is None else kept & values
                if name == "query":
                    self.queries = kept
                else:
                    self.connectors = kept
            elif name == "count" and isinstance(f, (GreaterThan, GreaterThanOrEqual)) and isinstance(f.value, int):
                least = f.value + isinstance(f, GreaterThan)
                self.least = least if self.least is None else max(self.least, least)
            else:
                yield f


class HitStream(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Of each file the end of its last whole line."""
        system, files = _files(self.path)
        return {p: self._whole(system, p, n) for p, (c, n) in sorted(files.items()) if self.connectors is None or c in self.connectors}

    @staticmethod
    def _whole(system: fs.FileSystem, path: str, size: int) -> int:
        with system.open_input_file(path) as f:
            while size > 0:
                start = max(size - TAIL_BYTES, 0)
                f.seek(start)
                cut = f.read(size - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                size = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        _, files = _files(self.path)
        shrunk = [p for p in start if end.get(p, 0) < start[p]]
        if shrunk:
            raise ValueError(f"recordings only grow; shorter or gone: {shrunk[:5]}")
        return [s for p, n in sorted(end.items()) for s in self.splits(p, files[p][0], start.get(p, 0), n)]


class HitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tally_hits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HitReader:
        return (HitFilterReader if self.options.get("pushdown", "false") == "true" else HitReader)(self.options)

    def streamReader(self, schema) -> HitStream:
        return HitStream(self.options)


def load(spark: SparkSession, path: str, pushdown: bool = False, **options) -> DataFrame:
    """The recordings below a path; with pushdown, filters are pushed where the session lets Python sources have them: for one set of filters alone."""
    spark.dataSource.register(HitSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") if pushdown else "false"
    return spark.read.format("tally_hits").options(path=path, pushdown=pushed, **options).load()
