"""REST endpoints as a Spark data source: tasks read pages, filters reach the request.

``spark.read.format("paged").option("url", "https://host/items?page={page}&limit={size}")``
needs no page count: every one of ``lanes`` tasks reads each ``lanes``-th page and finds the
end itself, at a page with fewer rows than ``size``. Pages that fail are asked for again when
the lane is through. ``pages`` reads a known number of pages, ``next`` mode follows a cursor in
one task. Every row is one record as JSON text, so that Spark parses it (``from_json``) with a
schema of the caller's, beside the fields that requests can filter by.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition

# Answers that one more attempt may mend, and the seconds to wait for them.
RETRY_STATUS = {401: 0.0, 429: 2.0, 500: 1.0, 502: 1.0, 503: 1.0, 504: 1.0}
TIMEOUT_S = 45
# Where a login answer holds the token, in this order; else in any field with "token" in its name.
TOKEN_FIELDS = ("access_token", "token", "jwt", "accessToken", "authToken")
#: Tasks that share the pages of an endpoint of unknown length.
LANES = 8
#: Failed pages in a row after which a lane gives up looking for the end.
FAILURES = 3


def token_of(answer: dict) -> str:
    """The token in a login answer; raises where there is none."""
    for name in (*TOKEN_FIELDS, *(k for k in answer if "token" in k.lower())):
        if isinstance(answer.get(name), str) and answer[name]:
            return answer[name]
    raise ValueError("the login answer holds no token")


class Client:
    """Requests of one task, with a login where the options name one."""

    def __init__(self, options: dict[str, str]):
        self.token = options.get("token") or None
        self.login_url, self.login_body = options.get("loginurl"), options.get("loginbody", "{}")
        self.pause = float(options["pause"]) if "pause" in options else None

    def login(self) -> None:
        self.token = token_of(self._send(self.login_url, self.login_body.encode(), {}))

    @staticmethod
    def _send(url: str, body: bytes | None, headers: dict[str, str]):
        request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json", **headers})
        with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
            return json.loads(answer.read() or b"null")

    def json(self, url: str, body: dict | None = None, attempts: int = 2):
        """The parsed answer of one request; the last failure is raised. A 401 logs in anew."""
        sent = None if body is None else json.dumps(body).encode()
        if self.login_url and not self.token:
            self.login()
        for left in range(attempts - 1, -1, -1):
            try:
                return self._send(url, sent, {"Authorization": f"Bearer {self.token}"} if self.token else {})
            except urllib.error.HTTPError as error:
                if not left or error.code not in RETRY_STATUS:
                    raise
                if error.code == 401 and self.login_url:
                    self.login()
                else:
                    time.sleep(RETRY_STATUS[error.code] if self.pause is None else self.pause)
            except (urllib.error.URLError, TimeoutError):
                if not left:
                    raise
                time.sleep(1.0 if self.pause is None else self.pause)


def rows_of(answer, field: str) -> list:
    """The records of an answer: the array itself, the named field of an object, or the object where no field is named."""
    if isinstance(answer, dict):
        answer = answer.get(field) if field else [answer]
    return answer or []


def at_path(record, path: str):
    """The value at a dotted path, or null."""
    for part in path.split("."):
        record = record.get(part) if isinstance(record, dict) else None
    return record


@dataclass(frozen=True)
class Parameter:
    """A column that requests can filter by: ``any`` of some values, ``one`` value, or ``from`` a value on."""

    column: str
    name: str
    kind: str
    path: str


class Lane(InputPartition):
    def __init__(self, first: int, step: int, last: int | None):
        super().__init__((first, step, last))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.url = self.options["url"]
        self.method = self.options.get("method", "GET").upper()
        self.body = json.loads(self.options.get("body", "{}"))
        self.pages = int(self.options["pages"]) if "pages" in self.options else None
        self.size = int(self.options.get("size", "50"))
        self.lanes = int(self.options.get("lanes", str(LANES)))
        self.field = self.options.get("field", "rows")
        self.cursor = self.options.get("cursor", "")
        self.single = self.options.get("single", "false") == "true"
        self.keep_going = self.options.get("onfailure", "raise") == "report"
        self.parameters = parameters_of(self.options)
        #: column -> values that are asked for, or the least one
        self.wanted: dict[str, list[str]] = {}
        self.least: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        known = {p.column: p for p in self.parameters}
        for f in filters:
            p = known.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if p and isinstance(f, GreaterThanOrEqual) and p.kind == "from" and p.column not in self.least:
                self.least[p.column] = f.value
            elif p and isinstance(f, EqualTo) and p.kind in ("any", "one") and p.column not in self.wanted:
                self.wanted[p.column] = [f.value]
            elif p and isinstance(f, In) and p.kind == "any" and p.column not in self.wanted:
                self.wanted[p.column] = list(f.value)
            else:
                yield f

    def partitions(self) -> list[Lane]:
        if self.cursor or self.single:
            return [Lane(1, 1, 1)]
        if self.pages is not None:
            return [Lane(n, 1, n) for n in range(1, self.pages + 1)]
        return [Lane(n, self.lanes, None) for n in range(1, self.lanes + 1)]

    def _asked(self) -> dict[str, str]:
        """What the pushed filters add to a request."""
        names = {p.column: p.name for p in self.parameters}
        return {names[c]: ",".join(map(str, v)) for c, v in self.wanted.items()} | {names[c]: str(v) for c, v in self.least.items()}

    def _page(self, client: Client, page) -> object:
        url = self.url.replace("{page}", str(page)).replace("{size}", str(self.size))
        if self.method == "POST":
            where = {} if self.single else {"next": page} if self.cursor and page != 1 else {} if self.cursor else {"page": page}
            return client.json(url, self.body | self._asked() | ({} if self.single else {"size": self.size}) | where)
        if asked := self._asked() if url.startswith("http") else {}:
            url += ("&" if "?" in url else "?") + urllib.parse.urlencode(asked)
        return client.json(url)

    def _tuples(self, rows: list) -> Iterator[tuple]:
        """Records with their filter columns; what a server does not filter is filtered here."""
        for row in rows:
            values = {p.column: at_path(row, p.path) for p in self.parameters}
            values = {k: v if v is None or isinstance(v, str) else json.dumps(v) for k, v in values.items()}
            if all(values[c] in want for c, want in self.wanted.items()) and all(values[c] is not None and values[c] >= low for c, low in self.least.items()):
                yield (*(values[p.column] for p in self.parameters), json.dumps(row), None)

    def _lost(self, page: int) -> tuple:
        return (*(None for _ in self.parameters), None, page)

    def read(self, partition: Lane) -> Iterator[tuple]:
        client, (page, step, last) = Client(self.options), partition.value
        if self.single:
            try:
                yield from self._tuples(rows_of(self._page(client, page), self.field))
            except urllib.error.HTTPError as error:
                if error.code != 404:
                    raise
            return
        if self.cursor:
            while page:
                answer = self._page(client, page)
                yield from self._tuples(rows_of(answer, self.field))
                page = answer.get(self.cursor) if isinstance(answer, dict) else None
            return
        failed, in_a_row = [], 0
        while last is None or page <= last:
            try:
                rows = rows_of(self._page(client, page), self.field)
            except OSError as error:  # of HTTP, connections and time-outs
                code = getattr(error, "code", None)
                if last is None and (code == 404 or isinstance(getattr(error, "reason", None), FileNotFoundError)):
                    break  # beyond the end
                if code is not None and code < 500 and code != 429:
                    raise
                failed, in_a_row = [*failed, page], in_a_row + 1
                if in_a_row == FAILURES:
                    break
            else:
                in_a_row = 0
                yield from self._tuples(rows)
                if last is None and len(rows) < self.size:
                    break
            page += step
        for page in failed:
            try:
                yield from self._tuples(rows_of(self._page(client, page), self.field))
            except OSError:
                if not self.keep_going:
                    raise
                yield self._lost(page)


def parameters_of(options: dict[str, str]) -> list[Parameter]:
    return [Parameter(*p) for p in json.loads(options.get("parameters", "[]"))]


class PagedSource(DataSource):
    """Options: url with ``{page}`` and ``{size}``, method, body, field of the records, size of a
    full page, pages or cursor (the answer's field that names the next page) or single, lanes,
    token or loginUrl and loginBody, parameters, onFailure (raise, or report lost pages)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        own = parameters_of({k.lower(): v for k, v in dict(self.options).items()})
        return ", ".join([*(f"`{p.column}` string" for p in own), "record string", "lost_page int"])

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


_registering = threading.Lock()


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, once, and lets filters reach it."""
    with _registering:
        if not getattr(spark, "_paged_registered", False):
            spark.dataSource.register(PagedSource)
            spark._paged_registered = True
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_raw(spark: SparkSession, **options: str) -> DataFrame:
    """The source as it is: filter columns, record (JSON), and lost_page where a page could not be had."""
    register(spark)
    return spark.read.format("paged").options(**options).load()


def read_pages(spark: SparkSession, schema: str, **options: str) -> DataFrame:
    """Records of an endpoint with the fields of ``schema`` (DDL); fields that a record lacks are null.

    Fields that requests can filter by come from the source itself, so that filters on them
    are pushed.
    """
    raw = read_raw(spark, **options)
    own = [p.column for p in parameters_of(options)]
    parsed = raw.where("record is not null").select(*own, F.from_json("record", schema).alias("r"))
    return parsed.select(*own, *[F.col(f"r.`{name}`") for name in parsed.schema["r"].dataType.names if name not in own])
