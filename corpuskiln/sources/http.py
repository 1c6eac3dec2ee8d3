"""Documents over HTTP as a Spark data source, with retries.

``spark.dataSource.register(HttpDocuments)``, then
``spark.read.format("http_documents").option("urls", path_of_a_list).load()``. Tasks fetch
ranges of the list; order is the ``ord`` column, never the order of arrival. A document
that can't be had is a row with a null text and its error, so that nothing is reordered.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRIES, LONGEST_WAIT, TIMEOUT = 5, 20, 180


def _open(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=TIMEOUT) as answer:
        return answer.read()


def fetch(url: str, opener: Callable[[str], bytes] = _open, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body of a URL; a missing one (404) is final, other failures are tried again."""
    for attempt in range(1, TRIES + 1):
        try:
            return opener(url)
        except urllib.error.HTTPError as e:
            if e.code == 404 or attempt == TRIES:
                raise
        except OSError:
            if attempt == TRIES:
                raise
        sleep(min(2**attempt, LONGEST_WAIT))
    raise AssertionError("unreachable")


class _Range(InputPartition):
    def __init__(self, first: int, urls: list[str]):
        self.first, self.urls = first, urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        with open(options["urls"], encoding="utf-8") as f:
            self.urls = [line.strip() for line in f if line.strip()]
        if not self.urls:
            raise ValueError("the list names no documents")
        self.per_task = int(options.get("perTask", 64))

    def partitions(self) -> list[InputPartition]:
        return [_Range(k, self.urls[k : k + self.per_task]) for k in range(0, len(self.urls), self.per_task)]

    def read(self, partition: _Range):
        for k, url in enumerate(partition.urls, partition.first):
            try:
                yield k, url, fetch(url).decode("utf-8"), None
            except (OSError, UnicodeDecodeError) as e:
                yield k, url, None, f"{type(e).__name__}: {e}"[:400]


class HttpDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_documents"

    def schema(self) -> str:
        return "ord long, url string, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
