"""Web sources: an index of archived pages as a data source, and fetching with the status as data."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Media types by kind; bytes that a document has at least; attempts, and the seconds between them.
TYPES = {"doc": "application/msword", "pdf": "application/pdf", "rtf": "application/rtf", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint"}
LEAST_BYTES, ATTEMPTS, PAUSE = 1024, 3, 2.0


def request(url: str, timeout: float = 60, attempts: int = ATTEMPTS, pause: float = PAUSE) -> bytes:
    """The body behind url; waits longer after each failure and raises the last."""
    for left in range(attempts - 1, -1, -1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "glyphloom"}), timeout=timeout) as answer:
                return answer.read()
        except OSError:
            if not left:
                raise
            time.sleep(pause * (attempts - left))
    raise ValueError("no attempts")


class ArchiveIndex(DataSource):
    """timestamp and original address of what an index lists. Options: endpoint, domains (comma-joined), kind, from, to, limit.

    One partition a domain. The index collapses repeats of an address; a domain whose query fails has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_index"

    def schema(self) -> str:
        return "domain string, timestamp string, original string"

    def reader(self, schema) -> DataSourceReader:
        return _IndexReader(dict(self.options))


class _IndexReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(d.strip()) for d in self.options["domains"].split(",") if d.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        asked = {"url": partition.value, "matchType": "domain", "filter": "mimetype:" + TYPES[o.get("kind", "doc")], "collapse": "urlkey", "fl": "timestamp,original", "output": "text"}
        asked |= {k: o[k] for k in ("from", "to", "limit") if k in o}
        try:
            body = request(f"{o['endpoint']}?{urllib.parse.urlencode(asked)}", pause=float(o.get("pause", PAUSE))).decode("utf-8", "replace")
        except OSError:
            return
        for line in body.splitlines():
            stamp, space, original = line.partition(" ")
            if space:
                yield partition.value, stamp, original


def fetch(url: str, attempts: int = ATTEMPTS, pause: float = PAUSE) -> tuple[str, bytes | None]:
    """ok and the body; throttled if the server ever said so and no attempt succeeded; else unfetched."""
    status = "unfetched"
    for n in range(attempts):
        try:
            body = request(url, 180, 1)
            if len(body) > LEAST_BYTES:
                return "ok", body
        except urllib.error.HTTPError as error:
            status = "throttled" if error.code == 429 else status
        except (OSError, ValueError):
            pass
        if n + 1 < attempts:
            time.sleep(pause * (n + 1))
    return status, None


def fetched(urls: DataFrame, attempts: int = ATTEMPTS, pause: float = PAUSE) -> DataFrame:
    """url, status and content of every row of urls (url); a dead link is a row with a status, not an error. One row a batch holds a body at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for url in pdf["url"]:
                status, body = fetch(url, attempts, pause) if url else ("unfetched", None)
                yield pd.DataFrame({"url": [url], "status": [status], "content": pd.Series([body], dtype=object)})

    return urls.select("url").mapInPandas(run, "url string, status string, content binary")
