"""Listings of a web service, read page by page through a data source of Spark's own kind.

    spark.read.format("paged_listing").schema("number long, title string")
        .option("base", "https://host").option("listings", '["/repos/a/b/pulls"]').load()

Each page of each listing is an input partition, so pages are fetched, decoded and checked in tasks and a lost
executor costs its pages. The columns are those of the declared schema, decoded from the JSON objects of a page, and
any of LISTING, PAGE, ERROR that it names. A listing whose last allowed page is full is longer than allowed, which is
an error. Errors fail the read, or with errors=rows are rows of their own with everything else null.

Options: base, listings (a JSON list of paths), query (a JSON object of fixed parameters), items (the field that
holds the objects; none: the page is the list), size (100), pages (20), attempts (1: a request is made once), errors
(raise), token, pushed (a JSON object, column: parameter; equality on these columns is sent with the request), transport.

A transport is a function (method, url, headers, body, seconds) -> (status, reason, file), named module:function
so that every executor can import it; `web` is the default, `stored` reads responses kept in a folder.
"""

from __future__ import annotations

import bisect
import functools
import importlib
import io
import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, urlencode

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.types import StructType

from docweave.storage import in_ranges
from docweave.storage import stored as table

# Limits and headers of the service.
PAGE_SIZE, PAGES, ERROR_BYTES, SECONDS = 100, 20, 4096, 10
# Rows of check runs that a task holds at once.
BATCH_ROWS = 10_000
HEADERS = {"Accept": "application/vnd.github+json", "X-GitHub-Api-Version": "2022-11-28", "User-Agent": "docweave"}

LISTING, PAGE, ERROR = "listing", "page", "error"


class ServiceError(Exception):
    """A request that failed; the message has at most ERROR_BYTES of the response."""

    def __init__(self, message: str, again: bool = False):
        super().__init__(message)
        self.again = again

    def __reduce__(self):
        return ServiceError, (str(self), self.again)


# --- transports -----------------------------------------------------------------------------------


def web(method: str, url: str, headers: dict, body: bytes | None, seconds: float):
    import urllib.error
    import urllib.request

    try:
        r = urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method), timeout=seconds)
    except urllib.error.HTTPError as e:
        return e.code, e.reason, e
    return r.status, r.reason, r


@functools.lru_cache(maxsize=4)
def _row_groups(root: str, _written: int | None) -> tuple[list, list[str]]:
    """(least path, greatest path, file, row group) of a folder's responses in their order, and the least paths alone. A
    process reads the footers of a folder once for each time it was written."""
    from pyarrow import fs, parquet

    system, folder = fs.FileSystem.from_uri(root)
    groups = []
    for file in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if "/part-" in file.path:
            with parquet.ParquetFile(file.path, filesystem=system) as f:
                for g in range(f.num_row_groups):
                    edge = f.metadata.row_group(g).column(0).statistics
                    if edge is None or not edge.has_min_max:  # paths too long for statistics
                        names = f.read_row_group(g, ["path"])["path"].to_pylist()
                        groups.append((names[0], names[-1], file.path, g))
                    else:
                        groups.append((edge.min, edge.max, file.path, g))
    groups.sort()
    return groups, [g[0] for g in groups]


@functools.lru_cache(maxsize=2)
def _responses(root: str, _written: int | None, path: str, group: int) -> dict[str, tuple]:
    from pyarrow import fs, parquet

    with parquet.ParquetFile(path, filesystem=fs.FileSystem.from_uri(root)[0]) as f:
        columns = f.read_row_group(group, ["path", "status", "reason", "body"]).to_pydict()
    return {name: rest for name, *rest in zip(*columns.values())}


def stored(method: str, url: str, headers: dict, body: bytes | None, seconds: float):
    """Responses that stand in a folder as store_responses() writes them, any file system that Arrow opens. One row group,
    found by its least and greatest path, is read for a request, and kept for the next. What does not stand there is an
    empty list."""
    from pyarrow import fs

    root, _, name = url.partition("/responses/")
    system, folder = fs.FileSystem.from_uri(root)
    written = system.get_file_info(f"{folder}/_SUCCESS").mtime_ns
    groups, least = _row_groups(root, written)
    at = bisect.bisect_right(least, name) - 1
    if at < 0 or groups[at][1] < name:
        return 200, "OK", io.BytesIO(b"[]")
    status, reason, said = _responses(root, written, *groups[at][2:]).get(name, (200, "OK", "[]"))
    return status, reason or "", io.BytesIO(said.encode())


def stored_object(method: str, url: str, headers: dict, body: bytes | None, seconds: float):
    """As stored(), for listings whose pages are objects: what does not stand there is an empty answer."""
    status, reason, answer = stored(method, url, headers, body, seconds)
    whole = answer.read()
    return status, reason, io.BytesIO(b"" if whole == b"[]" else whole)


# --- requests -------------------------------------------------------------------------------------


@dataclass
class Service:
    """Requests to one service. Bodies and answers are JSON; an empty answer is None."""

    base: str
    token: str = ""
    transport: str = f"{__name__}:web"
    attempts: int = 1
    pause: float = 0.5

    def _send(self) -> Callable:
        module, _, name = self.transport.partition(":")
        return getattr(importlib.import_module(module), name)

    def _once(self, method: str, path: str, body):
        headers = dict(HEADERS)
        if self.token:
            headers["Authorization"] = f"token {self.token}"
        data = None
        if body is not None:
            headers["Content-Type"], data = "application/json", json.dumps(body).encode()
        try:
            status, reason, answer = self._send()(method, self.base + path, headers, data, SECONDS)
        except OSError as e:
            raise ServiceError(f"{method} {path}: request failed: {e}", True) from e
        with answer:
            if not 200 <= status < 300:
                said = answer.read(ERROR_BYTES).decode("utf-8", "replace").strip() or f"{status} {reason}".strip()
                raise ServiceError(f"{method} {path}: API error status={status}: {said}", status == 429 or status >= 500)
            raw = answer.read()
        if not raw.strip():
            return None
        try:
            return json.loads(raw)
        except ValueError as e:
            raise ServiceError(f"{method} {path}: failed to decode response: {e}") from e

    def request(self, method: str, path: str, body=None):
        """The decoded answer. Requests that may go well a second time are repeated, the pause doubling."""
        for n in range(self.attempts):
            try:
                return self._once(method, path, body)
            except ServiceError as e:
                if not e.again or n + 1 == self.attempts:
                    raise
                time.sleep(self.pause * 2**n)

    def page(self, path: str, number: int, size: int, query: dict, items: str = "") -> tuple[list[dict], int | None]:
        """The objects of one page, and how many there are in all if the answer says so."""
        sent = urlencode(sorted({**query, "per_page": size, "page": number}.items()))
        answer = self.request("GET", f"{path}?{sent}") or ({} if items else [])
        rows = answer.get(items) or [] if items else answer
        if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
            raise ServiceError(f"GET {path}: failed to decode response: a list of objects is expected")
        return rows, answer.get("total_count") if items else None


def every_page(service: Service, path: str, query: dict, items: str, size: int = PAGE_SIZE, pages: int = PAGES) -> list[dict]:
    """All objects of a listing that tells its total on the first page; fewer than that are an error."""
    rows: list[dict] = []
    total = 0
    for number in range(1, pages + 1):
        more, said = service.page(path, number, size, query, items)
        total = said or 0 if number == 1 else total
        rows += more
        if not total or len(rows) >= total or not more:
            break
    if total and len(rows) < total:
        raise ServiceError(f"GET {path}: pagination truncated: got {len(rows)} of {total}")
    return rows


# --- the source -----------------------------------------------------------------------------------


@dataclass
class Page(InputPartition):
    listing: str
    number: int
    query: dict = field(default_factory=dict)


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return f"{LISTING} string, {PAGE} int, value string, {ERROR} string"

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)
        return (PushingReader if json.loads(options.get("pushed", "{}")) else PageReader)(options, schema)


class PageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        get = lambda k, d: options.get(k, d)
        self.fields = [(f.name, f.dataType) for f in schema.fields]
        self.listings, self.query = json.loads(get("listings", "[]")), json.loads(get("query", "{}"))
        self.items, self.size, self.pages = get("items", ""), int(get("size", PAGE_SIZE)), int(get("pages", PAGES))
        self.pushed, self.as_rows = json.loads(get("pushed", "{}")), get("errors", "raise") == "rows"
        self.service = Service(get("base", ""), get("token", ""), get("transport", f"{__name__}:web"), int(get("attempts", 1)), float(get("pause", 0.5)))
        if self.size < 1 or self.pages < 1:
            raise ValueError("size and pages are one at least")

    def partitions(self) -> list[Page]:
        return [Page(path, n + 1, self.query) for path in self.listings for n in range(self.pages)]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # there is no listing
            return
        marks = {LISTING: partition.listing, PAGE: partition.number}
        try:
            rows, total = self.service.page(partition.listing, partition.number, self.size, partition.query, self.items)
            if partition.number == self.pages and (len(rows) >= self.size if total is None else total > self.size * self.pages):
                raise ServiceError(f"GET {partition.listing}: pagination truncated after {self.pages} pages")
            out = [self._row(r, marks) for r in rows]
        except ServiceError as e:
            if not self.as_rows:
                raise
            out = [tuple({**marks, ERROR: str(e)}.get(name) for name, _ in self.fields)]
        yield from out

    def _row(self, found: dict, marks: dict) -> tuple:
        known = {**found, **marks, "value": json.dumps(found)} if "value" not in found else {**found, **marks}
        return tuple(typed(known.get(name), kind, name) for name, kind in self.fields)


class PushingReader(PageReader):
    """Filters reach the reader where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list) -> Iterable:  # noqa: N802
        """Equality on a column with a parameter goes with the request; Spark still applies it, as a service may not."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] in self.pushed:
                self.query[self.pushed[f.attribute[0]]] = str(f.value)
            yield f


def typed(value, kind, name: str):
    """A decoded JSON value as the declared type; what does not fit is an error of decoding."""
    at = kind.typeName()
    if value is None:
        return None
    try:
        if at == "struct" and isinstance(value, dict):
            return tuple(typed(value.get(f.name), f.dataType, f"{name}.{f.name}") for f in kind.fields)
        if at == "array" and isinstance(value, list):
            return [typed(v, kind.elementType, name) for v in value]
        if at == "map" and isinstance(value, dict):
            return {k: typed(v, kind.valueType, name) for k, v in value.items()}
        if at == "string":
            return value if isinstance(value, str) else _none()
        if at == "boolean":
            return value if isinstance(value, bool) else _none()
        if at in ("byte", "short", "integer", "long"):
            return value if isinstance(value, int) and not isinstance(value, bool) else _none()
        if at in ("float", "double"):
            return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else _none()
    except TypeError:
        pass
    raise ServiceError(f"failed to decode response: {name} is not of type {kind.simpleString()}")


def _none():
    raise TypeError


def listing(spark: SparkSession, base: str, listings: list[str], schema: str, **options) -> DataFrame:
    """All objects of the listings as rows of the schema, read page by page."""
    spark.dataSource.register(PagedListing)
    reader = spark.read.format("paged_listing").schema(schema).option("base", base).option("listings", json.dumps(listings))
    for k, v in options.items():
        reader = reader.option(k, v if isinstance(v, str) else json.dumps(v))
    return reader.load()


# --- change requests ------------------------------------------------------------------------------

REQUEST = "number long, title string, state string, draft boolean, mergeable boolean, user struct<login: string>, labels array<struct<name: string>>, head struct<ref: string, sha: string>, base struct<ref: string, sha: string>"


def open_requests(spark: SparkSession, base: str, repositories: list[str], authors: list[str], target: str = "", **options) -> DataFrame:
    """Open change requests of the repositories by the authors (any case; all if none are named): listing, number,
    title, author, labels, draft, mergeable, head_ref, head_sha, base_ref, error."""
    query = {"state": "open", **({"base": target} if target else {})}
    rows = listing(spark, base, [f"/repos/{r}/pulls" for r in repositories], f"{LISTING} string, {PAGE} int, {ERROR} string, {REQUEST}", query=query, **options)
    if options.get("errors") == "rows":
        rows = _whole_or_failed(rows)
    if authors:
        rows = rows.filter(F.col(ERROR).isNotNull() | F.lower("user.login").isin([a.lower() for a in authors]))
    names = F.transform(F.coalesce("labels", F.array().cast("array<struct<name: string>>")), lambda x: x["name"])
    return rows.select(LISTING, "number", "title", F.col("user.login").alias("author"), names.alias("labels"), F.coalesce("draft", F.lit(False)).alias("draft"), "mergeable", F.col("head.ref").alias("head_ref"), F.col("head.sha").alias("head_sha"), F.col("base.ref").alias("base_ref"), ERROR)


def _whole_or_failed(rows: DataFrame) -> DataFrame:
    """Of a listing with errors only that of its first page with one is left. Pages are fetched once, and stored."""
    rows = table(rows, "listing-pages")
    failed = rows.filter(F.col(ERROR).isNotNull()).groupBy(LISTING).agg(F.min(PAGE).alias("__first"))
    marked = rows.join(F.broadcast(failed), LISTING, "left")  # a row for each listing asked for
    return marked.filter(F.col("__first").isNull() | (F.col("__first") == F.col(PAGE)) & F.col(ERROR).isNotNull()).drop("__first")


def check_runs(commits: DataFrame, service: Service, repository: str, sha: str = "sha") -> DataFrame:
    """sha, status, conclusion, error of all check runs of the commits (a column of DataFrame rows). Requests are made in
    tasks that the commits are dealt to in ranges, however few files they come from. A commit without runs has a row of
    nulls, one that cannot be read its error."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 4, ["sha", "status", "conclusion", "error"])

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for commit in batch.column("sha").to_pylist():
                if len(rows) >= BATCH_ROWS:
                    yield made(rows)
                    rows = []
                try:
                    found = every_page(service, f"/repos/{repository}/commits/{quote(commit or '', safe='')}/check-runs", {}, "check_runs")
                    rows += [(commit, str(r.get("status") or ""), str(r.get("conclusion") or ""), None) for r in found] or [(commit, None, None, None)]
                except ServiceError as e:
                    rows.append((commit, None, None, str(e)))
            yield made(rows)

    asked = in_ranges(commits.select(F.col(sha).alias("sha")), "sha")
    return asked.mapInArrow(run, "sha string, status string, conclusion string, error string")


def details(requests: DataFrame, service: Service) -> DataFrame:
    """repository, number, mergeable, head_sha, error of each change request (repository, number), asked one by one
    where the rows are: only the single answer tells whether it can be merged."""

    def run(batches):
        for batch in batches:
            rows = []
            for repository, number in zip(batch.column("repository").to_pylist(), batch.column("number").to_pylist()):
                try:
                    one = service.request("GET", f"/repos/{repository}/pulls/{number}") or {}
                    rows.append((repository, number, one.get("mergeable"), (one.get("head") or {}).get("sha"), None))
                except ServiceError as e:
                    rows.append((repository, number, None, None, f"PR #{number}: failed to get details: {e}"))
            types = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], ["repository", "number", "mergeable", "head_sha", "error"])

    return requests.select("repository", F.col("number").cast("long")).mapInArrow(run, "repository string, number long, mergeable boolean, head_sha string, error string")


def default_branch(service: Service, repository: str) -> str:
    name = ((service.request("GET", f"/repos/{repository}") or {}).get("default_branch") or "").strip()
    if not name:
        raise ServiceError("repository default_branch is empty")
    return name


# --- responses kept in a folder -------------------------------------------------------------------

# Files of a folder of responses, and bytes of a row group.
FILES, GROUP_BYTES = 64, 1 << 20


def store_responses(responses: DataFrame, folder: str) -> None:
    """responses (path: with its query, status, reason, body) for the transport `stored`: files of ranges of paths, sorted,
    in row groups of a MB, so that there are as many files as tasks and one response costs the reading of one group."""
    rows = responses.select("path", F.col("status").cast("int").alias("status"), F.col("reason").cast("string").alias("reason"), F.coalesce("body", F.lit("")).alias("body"))
    ranges = rows.repartitionByRange(FILES, "path").sortWithinPartitions("path")
    ranges.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(folder)
