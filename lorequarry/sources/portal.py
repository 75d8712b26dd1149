"""A knowledge portal as Spark data sources: topic tree, paginated listings, article details.

The network is behind `fetch`, a function of (path, parameters) that returns (status, body), so
that tests and recorded crawls run offline. One partition per root, topic or article.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str, dict[str, str]], tuple[int, str]]
#: Articles of a listing page.
PAGE = 25
#: Seconds between requests of one task.
DELAY = 2.0


class Key(InputPartition):
    def __init__(self, key: str):
        self.key = key


class Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, kind: str, keys: list[str], delay: float):
        self.fetch, self.kind, self.keys, self.delay = fetch, kind, keys, delay

    def partitions(self):
        return [Key(k) for k in self.keys]

    def read(self, partition: Key) -> Iterator[tuple]:
        yield from {"topics": self.topics, "listing": self.listing, "article": self.article}[self.kind](partition.key)

    def topics(self, root: str) -> Iterator[tuple]:
        status, body = self.fetch(f"topic/{root}", {"$level": "5"})
        if status == 200:  # a root that can't be read is left out
            yield root, 0, body

    def listing(self, topic: str) -> Iterator[tuple]:
        start = 0
        while True:
            status, body = self.fetch("article", {"topic": topic, "$rangestart": str(start), "$rangesize": str(PAGE)})
            if status != 200:
                return
            yield topic, start, body
            count, most = (re.search(rf"<(?:ns2:)?{t}>(\d+)<", body) for t in ("count", "maxRange"))
            start += PAGE
            if not count or count[1] == "0" or not most or start >= int(most[1]):
                return
            time.sleep(self.delay)

    def article(self, article: str) -> Iterator[tuple]:
        status, body = self.fetch(f"article/{article}", {})
        if status == 200:
            yield article, 0, body
        time.sleep(self.delay)


def portal_source(fetch: Fetch, kind: str, keys: list[str], delay: float = DELAY) -> type[DataSource]:
    """A data source class of one kind of response for the given keys."""

    class Portal(DataSource):
        @classmethod
        def name(cls):
            return f"portal_{kind}"

        def schema(self):
            return "key string, offset int, value string"

        def reader(self, schema):
            return Reader(fetch, kind, keys, delay)

    return Portal


def read_portal(spark: SparkSession, fetch: Fetch, kind: str, keys: list[str], delay: float = DELAY) -> DataFrame:
    """(key, offset, value): responses of a kind; roots for topics, topic ids for listing, article ids for article."""
    source = portal_source(fetch, kind, keys, delay)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()


def to_fetch(articles: DataFrame, done: DataFrame) -> DataFrame:
    """Articles that no earlier run has landed, each once."""
    return articles.dropDuplicates(["id"]).join(done.select("id"), "id", "left_anti")
