"""The paged API as a Spark data source: one partition per page."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RETRIES, BACKOFF, TIMEOUT = 3, 2.0, 60
PAGE_SIZE, MAX_PAGES, DELAY = 100, 50, 0.3


def request(send: Callable[[], tuple[int, bytes]], retries: int = RETRIES, backoff: float = BACKOFF, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """Body of a successful answer. Connection errors, 429 and 5xx are tried again after a wait that doubles; any other
    status from 400 up is an error at once."""
    for attempt in range(1, retries + 1):
        try:
            status, body = send()
        except OSError as e:
            if attempt == retries:
                raise ConnectionError(f"no answer after {retries} attempts: {e}") from e
        else:
            if status < 400:
                return body
            if status != 429 and status < 500:
                raise RuntimeError(f"HTTP {status}")
            if attempt == retries:
                raise RuntimeError(f"HTTP {status} after {retries} attempts")
        sleep(backoff * 2 ** (attempt - 1))
    raise AssertionError("unreachable")


def http_post(url: str, payload: dict, headers: dict[str, str] | None = None) -> bytes:
    def send() -> tuple[int, bytes]:
        r = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"} | (headers or {}))
        try:
            with urllib.request.urlopen(r, timeout=TIMEOUT) as answer:
                return answer.status, answer.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    return request(send)


class PagedApi(DataSource):
    """Options: url, city, pageSize, maxPages, delay. Rows: page, place in the page, and the row as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        return "page int, i int, value string"

    def reader(self, schema) -> PagedReader:  # noqa: ANN001
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> PagedStream:  # noqa: ANN001, N802
        return PagedStream(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url = options["url"]
        self.city = int(options.get("city", 0))
        self.size, self.most = int(options.get("pagesize", PAGE_SIZE)), int(options.get("maxpages", MAX_PAGES))
        self.delay = float(options.get("delay", DELAY))

    def fetch(self, page: int) -> dict:
        return json.loads(http_post(self.url, {"cityId": self.city, "page": page, "pageSize": self.size}))

    def partitions(self) -> list[InputPartition]:
        total = int((self.fetch(1).get("pagination") or {}).get("totalPages") or 1)
        return [InputPartition(p) for p in range(1, min(total, self.most) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        time.sleep(self.delay)
        for i, row in enumerate(self.fetch(partition.value).get("result") or []):
            yield partition.value, i, json.dumps(row, ensure_ascii=False)


class Rows(InputPartition):
    """Rows ``low`` to ``high`` of a page, counted from 0."""

    def __init__(self, page: int, low: int, high: int) -> None:
        self.page, self.low, self.high = page, low, high


class PagedStream(DataSourceStreamReader, PagedReader):
    """New rows of a list that grows at its end. The offset is the number of rows read, so a page that was read while it was
    not full is read on from there, and a batch that is replayed reads the same rows."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"rows": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        about = self.fetch(1).get("pagination") or {}
        pages = int(about.get("totalPages") or 1)
        if about.get("totalCount") is None or pages > self.most:
            pages = min(pages, self.most)
            return {"rows": (pages - 1) * self.size + len(self.fetch(pages).get("result") or [])}
        return {"rows": int(about["totalCount"])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = int(start["rows"]), int(end["rows"])
        first, size = low // self.size, self.size
        return [Rows(p + 1, max(low - p * size, 0), min(high - p * size, size)) for p in range(first, -(-high // size))] if high > low else []

    def read(self, partition: Rows) -> Iterator[tuple]:
        time.sleep(self.delay)
        rows = self.fetch(partition.page).get("result") or []
        if len(rows) < partition.high:
            raise RuntimeError(f"page {partition.page} has {len(rows)} rows of the {partition.high} that were announced")
        for i in range(partition.low, partition.high):
            yield partition.page, i, json.dumps(rows[i], ensure_ascii=False)
