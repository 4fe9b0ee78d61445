"""An event web service as a Spark data source: planned time slices are its partitions.

The service answers with comma-separated text and refuses more than a fixed number of
events per request, so the window is halved until each slice fits; nothing is ever
truncated.  A client is anything with ``count(request)`` and ``query(request)``; the
default one speaks HTTP, tests inject their own by ``module:name``.
"""

from __future__ import annotations

import csv
import datetime as dt
import importlib
import io
import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from http import HTTPStatus

from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import model

#: What the service takes, and how patient a client is.
SERVICE_LIMIT, TIMEOUT_S = 20000, 180
ATTEMPTS, BACKOFF_BASE_S, BACKOFF_MOST_S = 5, 2.0, 30.0
BOX = ("minlatitude", "maxlatitude", "minlongitude", "maxlongitude")


@dataclass(frozen=True)
class Request:
    """One question to the service; knows how the service wants it written."""

    starttime: str
    endtime: str
    minmagnitude: float = 0
    eventtype: str = "earthquake"
    box: dict = field(default_factory=dict)

    @classmethod
    def of(cls, options: dict) -> Request:
        """From a source's options, which are text; edges of the box that are missing or empty stay out."""
        given = {k: v for k, v in options.items() if v not in (None, "")}
        window = (moment(given[k]).isoformat() for k in ("starttime", "endtime"))
        return cls(*window, float(given.get("minmagnitude", cls.minmagnitude)), given.get("eventtype", cls.eventtype), {k: given[k] for k in BOX if k in given})

    def between(self, start: dt.datetime, end: dt.datetime) -> Request:
        return replace(self, starttime=start.isoformat(), endtime=end.isoformat())

    def encoded(self, **more: str) -> dict:
        """The service's own parameters."""
        own = {name: getattr(self, name) for name in ("starttime", "endtime", "eventtype", "minmagnitude")}
        return own | {edge: value for edge, value in self.box.items() if value is not None} | more

    def url(self, base: str, service: str, **more: str) -> str:
        return f"{base}/{service}?{urllib.parse.urlencode(self.encoded(**more))}"


def is_transient(error: BaseException) -> bool:
    """Whether asking again may help: the service is overloaded or failing, or wasn't reached."""
    match error:
        case urllib.error.HTTPError(code=code):
            return code == HTTPStatus.TOO_MANY_REQUESTS or code >= HTTPStatus.INTERNAL_SERVER_ERROR
        case OSError():
            return isinstance(error, (TimeoutError, ConnectionError, urllib.error.URLError))
    return False


@dataclass(frozen=True)
class Patience:
    """How often to ask, and how long to wait in between: doubling, half of each wait at random."""

    attempts: int = ATTEMPTS
    first_s: float = BACKOFF_BASE_S
    most_s: float = BACKOFF_MOST_S

    def waits(self) -> Iterator[float]:
        for doubling in range(self.attempts - 1):
            yield min(self.first_s * 2**doubling, self.most_s) * (0.5 + 0.5 * random.random())

    def ask(self, call: Callable, sleep: Callable[[float], None] = time.sleep):
        waits = self.waits()
        while True:
            try:
                return call()
            except Exception as error:
                wait = next(waits, None) if is_transient(error) else None
                if wait is None:
                    raise
                sleep(wait)


class HttpClient:
    """The service at a base address with ``count`` and ``query`` below it."""

    def __init__(self, base: str, timeout: float = TIMEOUT_S, patience: Patience = Patience()):
        self.base, self.timeout, self.patience = base.rstrip("/"), timeout, patience

    def _get(self, url: str) -> bytes:
        def call():
            with urllib.request.urlopen(url, timeout=self.timeout) as answer:
                return answer.read()

        return self.patience.ask(call)

    def count(self, request: Request) -> int:
        return int(json.loads(self._get(request.url(self.base, "count", format="geojson")))["count"])

    def query(self, request: Request) -> bytes:
        return self._get(request.url(self.base, "query", format="csv"))


def moment(text) -> dt.datetime:
    t = text if isinstance(text, dt.datetime) else dt.datetime.fromisoformat(str(text))
    return t if t.tzinfo else t.replace(tzinfo=dt.UTC)


def plan_slices(count: Callable[[dt.datetime, dt.datetime], int], start: dt.datetime, end: dt.datetime, total: int, limit: int = SERVICE_LIMIT) -> list[tuple[dt.datetime, dt.datetime, int]]:
    """Slices of at most ``limit`` events, in time order; one count for each halving."""
    done, open_ = [], [(start, end, total)]
    while open_:
        a, b, n = open_.pop()
        if n <= limit:
            done.append((a, b, n))
            continue
        middle = a + (b - a) / 2
        if not a < middle < b:
            raise ValueError(f"{n} events between {a} and {b} can't be split any further: raise minmagnitude or shrink the region")
        left = count(a, middle)
        open_ += [(middle, b, n - left), (a, middle, left)]  # an event on the border may be in both; ids are unique later on
    return done


def plan(client, options: dict) -> list[tuple[dt.datetime, dt.datetime, int]]:
    """The slices to ask for; an empty window, an empty answer and more events than the limit are errors."""
    request = Request.of(options)
    start, end, most = moment(request.starttime), moment(request.endtime), int(options.get("limit") or 0)
    if end <= start:
        raise ValueError(f"the window is empty or reversed: {start} to {end}")
    total = client.count(request)
    if not total:
        raise ValueError(f"no event between {start} and {end} with magnitude {request.minmagnitude} or more")
    if most and total > most:
        raise ValueError(f"{total} events match and the limit is {most}; nothing is truncated: raise the limit or narrow the query")
    return plan_slices(lambda a, b: client.count(request.between(a, b)), start, end, total, int(options.get("service_limit") or SERVICE_LIMIT))


def rows(body: bytes) -> Iterator[dict]:
    """Records of one answer; an empty one has none."""
    return csv.DictReader(io.StringIO(body.decode("utf-8")))


def concatenate(bodies: list[bytes]) -> bytes:
    """Answers as one file with one header; bodies without records add nothing."""
    kept = [bodies[0].rstrip(b"\n")]
    kept += [b.partition(b"\n")[2].rstrip(b"\n") for b in bodies[1:] if b.partition(b"\n")[2].strip()]
    return b"\n".join(kept) + b"\n" if len(bodies) > 1 else bodies[0]


class Slice(InputPartition):
    def __init__(self, request: Request):
        self.request = request


class FdsnReader(DataSourceReader):
    """Asks for slices of the window that the options name."""

    def __init__(self, options: dict, names: list[str]):
        self.own, self.names = dict(options), names

    def _client(self):
        if spec := self.own.get("client"):
            module, _, name = spec.partition(":")
            return getattr(importlib.import_module(module), name)()
        return HttpClient(self.own["url"])

    def partitions(self):
        request, client = Request.of(self.own), self._client()
        if self._pushed_empty(request, client):
            return []
        return [Slice(request.between(a, b)) for a, b, _ in plan(client, self.own)]

    def _pushed_empty(self, request: Request, client) -> bool:
        """Nothing to ask for because of filters: an empty table and not an error."""
        if not self.own.get("narrowed"):
            return False
        return moment(request.endtime) <= moment(request.starttime) or not client.count(request)

    def read(self, partition):
        for r in rows(self._client().query(partition.request)):
            yield tuple(r.get(n) for n in self.names)


class NarrowingReader(FdsnReader):
    """What filters say of time and type narrows the request, and Spark still applies them."""

    def pushFilters(self, filters):
        for f in filters:
            self._narrow(f)
            yield f  # the service's bounds are inclusive and its answer is text, so Spark filters again

    def _narrow(self, f) -> None:
        column, value = getattr(f, "attribute", None), getattr(f, "value", None)
        if column == ("time",) and isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)):
            edge, tighter = ("starttime", max) if isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)) else ("endtime", min)
            try:
                bound = moment(value)
            except ValueError:
                return  # text that is no time orders as text
            self.own |= {edge: tighter(moment(self.own[edge]), bound).isoformat(), "narrowed": True}
        elif column == ("type",) and isinstance(f, ds.EqualTo) and not self.own.get("eventtype"):
            self.own |= {"eventtype": str(value), "narrowed": True}


class FdsnSource(DataSource):
    """``spark.read.format("fdsn").option("url", ...).option("starttime", ...)...load()``: all columns are text.

    With the option ``pushfilters`` filters reach the service; Spark asks for
    ``spark.sql.python.filterPushdown.enabled`` then.
    """

    @classmethod
    def name(cls) -> str:
        return "fdsn"

    def schema(self) -> str:
        names = dict.fromkeys([*model.REQUIRED_RAW, *model.SILVER])
        return ", ".join(f"`{n}` string" for n in names)

    def reader(self, schema):
        options = {k.lower(): v for k, v in self.options.items()}
        kind = NarrowingReader if str(options.get("pushfilters")).lower() == "true" else FdsnReader
        return kind(options, schema.fieldNames())
