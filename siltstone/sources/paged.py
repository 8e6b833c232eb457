"""A paginated JSON service as a data source: pages follow each other by a link in the answer."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetched(url: str, tries: int = 5, wait: float = 1.0, timeout: float = 30.0) -> dict:
    """One page. Server errors and time-outs are tried again, each wait twice the last; other errors are raised."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
                return json.load(answer)
        except urllib.error.HTTPError as error:
            if error.code < 500 or k == tries - 1:
                raise
        except (urllib.error.URLError, TimeoutError):
            if k == tries - 1:
                raise
        time.sleep(wait * 2**k)
    raise ValueError("tries is at least 1")


def pages(first: str, items: str, following: str, **options: float) -> Iterator[dict]:
    """The entries of all pages from ``first`` on."""
    url: str | None = first
    while url:
        page = fetched(url, **options)
        yield from page.get(items) or []
        url = urljoin(url, page[following]) if page.get(following) else None


class _Chain(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[_Chain]:
        return [_Chain(url) for url in json.loads(self.options["urls"])]

    def read(self, partition: _Chain) -> Iterator[tuple]:
        wait = float(self.options.get("wait", "1"))
        for item in pages(partition.url, self.options.get("items", "objects"), self.options.get("following", "next_url"), wait=wait):
            yield (json.dumps(item),)


class PagedJson(DataSource):
    """``urls`` is a JSON list of first pages; each chain of pages is read by one task."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options)


def paged_json(spark: SparkSession, urls: list[str], items: str = "objects", following: str = "next_url", wait: float = 1.0) -> DataFrame:
    """The entries of several chains of pages, one row ``value`` of JSON each; read them with ``from_json``."""
    spark.dataSource.register(PagedJson)
    return spark.read.format("paged_json").options(urls=json.dumps(urls), items=items, following=following, wait=str(wait)).load()
