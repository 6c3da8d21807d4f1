"""Records of a remote site as a Spark source: one partition for a range of pages, filters answered by the site.

    paged.register(spark)
    orders = spark.read.format("paged_records").option("url", ...).option("table", "Order").schema("name string, total double").load()
    orders.filter("customer = 'A' and total != 0")    # both go to the site

Only the fields of the schema are asked for. Pages are cut by an order over `key`, so a page that is read again after a
lost executor has the same rows, as long as none are added or removed meanwhile.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, Not, StringContains
from pyspark.sql.types import StructType

#: The paths and parameter names of the site's interface.
RESOURCE = "/api/resource/"


class NotFound(LookupError):
    pass


@dataclass(frozen=True)
class Site:
    """Tables of a site by HTTP."""

    url: str
    token: str = ""
    timeout: float = 60.0

    def call(self, method: str, path: str, parameters: dict | None = None, body: dict | None = None, headers: dict | None = None) -> object:
        query = f"?{urllib.parse.urlencode(parameters)}" if parameters else ""
        said = {"Content-Type": "application/json", **({"Authorization": f"token {self.token}"} if self.token else {}), **(headers or {})}
        request = urllib.request.Request(f"{self.url.rstrip('/')}{path}{query}", None if body is None else json.dumps(body, default=str).encode(), said, method=method)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.loads(answer.read() or b"null")
        except urllib.error.HTTPError as e:
            why = e.read(800).decode(errors="replace")
            raise (NotFound if e.code == 404 else RuntimeError)(f"{method} {path}: {e.code} {why}") from e

    def page(self, table: str, filters: list, fields: list[str], start: int, length: int, order: str) -> list[dict]:
        """At most `length` rows from place `start` on; length 0 is all."""
        asked = {"filters": json.dumps(filters), "fields": json.dumps(fields), "limit_start": start, "limit_page_length": length, "order_by": order}
        return (self.call("GET", RESOURCE + urllib.parse.quote(table), asked) or {}).get("data", [])

    def insert(self, table: str, row: dict, once: str = "") -> dict:
        """once: a key under which the site makes the row one time only, however often it is asked."""
        return self.call("POST", RESOURCE + urllib.parse.quote(table), body=row, headers={"Idempotency-Key": once} if once else None)["data"]


@dataclass(frozen=True)
class Pages(InputPartition):
    start: int
    stop: int


def plain(value: object) -> bool:
    return isinstance(value, (str, int, float, bool))


def asked(f: Filter) -> list | None:
    """A filter as the site has it, or None."""
    if isinstance(f, EqualTo) and len(f.attribute) == 1 and plain(f.value):
        return [f.attribute[0], "=", f.value]
    if isinstance(f, In) and len(f.attribute) == 1 and all(map(plain, f.value)):
        return [f.attribute[0], "in", list(f.value)]
    if isinstance(f, StringContains) and len(f.attribute) == 1:
        return [f.attribute[0], "like", f"%{f.value}%"]
    if isinstance(f, Not) and isinstance(f.child, EqualTo) and len(f.child.attribute) == 1 and plain(f.child.value):
        return [f.child.attribute[0], "!=", f.child.value]
    return None


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.site = Site(options["url"], options.get("token", ""))
        self.table, self.key = options["table"], options.get("key", "name")
        self.length, self.pages_each = int(options.get("page_rows", 500)), int(options.get("pages_each", 20))
        self.fields, self.filters = schema.fieldNames(), json.loads(options.get("filters", "[]"))
        self.filled: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """What the site answers goes to it. A pattern stays with Spark, too: the site's doesn't look at letters' case."""
        for f in filters:
            if isinstance(f, IsNotNull) and len(f.attribute) == 1:
                self.filled.append(f.attribute[0])
                continue
            if (own := asked(f)) is not None:
                self.filters.append(own)
                if own[1] == "!=":
                    self.filled.append(own[0])
            if own is None or own[1] == "like":
                yield f

    def ends_before(self, place: int) -> bool:
        return not self.site.page(self.table, self.filters, [self.key], place, 1, f"{self.key} asc")

    def partitions(self) -> list[Pages]:
        """The end is found by doubling and halving, with one row a request."""
        each, high = self.length * self.pages_each, 1
        while not self.ends_before(high * each):
            high *= 2
        low = high // 2
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if self.ends_before(middle * each) else (middle, high)
        return [Pages(k * each, (k + 1) * each) for k in range(high)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        fields = list(dict.fromkeys([*self.fields, *self.filled]))
        for start in range(partition.start, partition.stop, self.length):
            rows = self.site.page(self.table, self.filters, fields, start, min(self.length, partition.stop - start), f"{self.key} asc")
            for row in rows:
                if all(row.get(f) is not None for f in self.filled):
                    yield tuple(row.get(f) for f in self.fields)
            if len(rows) < self.length:
                return


class PagedRecords(DataSource):
    """Options: url, table, key (by which pages are ordered), page_rows, pages_each (pages a partition), filters (as JSON), token."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return f"{self.options.get('key', 'name')} string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedRecords)
