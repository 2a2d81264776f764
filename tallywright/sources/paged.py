"""A paged service as a Spark data source: one partition per range of pages, retries inside the reader."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(first)
        self.first, self.last = first, last


def fetch(url: str, headers: dict[str, str], tries: int = 5, base: float = 0.5, get: Callable | None = None, sleep: Callable = time.sleep) -> dict:
    """The JSON at a url. 429 and 5xx are tried again, after Retry-After or ever longer, with jitter."""
    get = get or (lambda u, h: urllib.request.urlopen(urllib.request.Request(u, headers=h), timeout=60).read())  # noqa: S310
    for n in range(tries):
        try:
            return json.loads(get(url, headers))
        except urllib.error.HTTPError as e:
            if n == tries - 1 or not (e.code == 429 or e.code >= 500):
                raise
            wait = e.headers.get("Retry-After") if e.headers else None
            sleep(float(wait) if wait and wait.isdigit() else base * 2**n * (1 + random.random()))  # noqa: S311
    raise AssertionError


class Breaker:
    """Stops asking a resource for a while after too many refusals in a row; where open, the fallback answers. For callers on the driver."""

    def __init__(self, refusals: int = 3, pause: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.refusals, self.pause, self.clock = refusals, pause, clock
        self.count: dict[str, int] = {}
        self.until: dict[str, float] = {}

    def is_open(self, resource: str) -> bool:
        return self.clock() < self.until.get(resource, float("-inf"))

    def call(self, resource: str, ask: Callable, fallback: Callable):
        if self.is_open(resource):
            return fallback()
        try:
            out = ask()
        except urllib.error.HTTPError as e:
            if e.code != 429:
                raise
            self.count[resource] = self.count.get(resource, 0) + 1
            if self.count[resource] >= self.refusals:
                self.until[resource] = self.clock() + self.pause
                self.count[resource] = 0
            return fallback()
        self.count[resource] = 0
        return out


class PagedReader(DataSourceReader):
    """Options: url with {page} and {size}, pages, size, rows (where in the payload the rows are), parallel, token, next (a field with the next page's address: then one partition follows it)."""

    def __init__(self, options: dict, schema):
        self.options, self.fields = dict(options), [f.name for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        pages, parallel = int(self.options.get("pages", 1)), int(self.options.get("parallel", 8))
        if self.options.get("next"):
            return [Pages(1, 1)]
        step = max(1, -(-pages // parallel))
        return [Pages(p, min(pages, p + step - 1)) for p in range(1, pages + 1, step)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        headers = {"Authorization": f"Bearer {self.options['token']}"} if self.options.get("token") else {}
        for page in range(partition.first, partition.last + 1):
            url = self.options["url"].format(page=page, size=self.options.get("size", 500))
            while url:
                payload = fetch(url, headers)
                rows = payload
                for step in filter(None, self.options.get("rows", "").split(".")):
                    rows = rows[step]
                for r in rows:
                    yield tuple(None if r.get(f) is None else r[f] if isinstance(r[f], str | int | float | bool) else json.dumps(r[f], sort_keys=True) for f in self.fields)
                url = payload.get(self.options["next"]) if self.options.get("next") else None


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged").schema(..).options(..).load()"""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("a paged source needs a schema")

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options, schema)
