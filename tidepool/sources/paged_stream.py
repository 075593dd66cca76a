"""A paged interface as a stream, whose offset is the page cursor.

A batch is the next BATCH_PAGES pages, as far as there are; how many there are isn't asked beforehand but seen while
reading: a page that is shorter than the limit is the last so far, and is read again from its own rows on when the stream
goes on later. A page is fetched once in a run, with retries that wait longer by the same step each time. After a restart
only the last batch that wasn't committed is fetched again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Pages of a batch at most: what a batch costs besides its pages is shared by so many.
BATCH_PAGES = 64

#: Gets (path, params) and returns status, content type and text.
Get = Callable[[str, dict], tuple[int, str, str]]


class Unfetched(Exception):
    """An address that gave no JSON object after all tries."""


@dataclass(frozen=True)
class Fetcher:
    """JSON by ``get``, tried so often, waiting ``step`` seconds after the first failure, twice that after the second."""

    get: Get
    tries: int = 3
    step: float = 1.0
    wait: Callable[[float], None] = time.sleep

    def json(self, path: str, params: dict | None = None) -> dict:
        fault: Exception | None = None
        for attempt in range(1, self.tries + 1):
            try:
                status, kind, text = self.get(path, params or {})
                break
            except Exception as error:  # whatever the transport raises is tried again
                fault = error
                if attempt < self.tries:
                    self.wait(self.step * attempt)
        else:
            raise Unfetched(f"{path}: {fault}") from fault
        # An answer that came is not asked for again, whatever it says.
        if not 200 <= status < 300:
            raise Unfetched(f"{path}: status {status}, {kind} {text[:200]!r}")
        if "json" not in kind.lower() and not text.lstrip().startswith(("{", "[")):
            raise Unfetched(f"{path}: expected JSON, got {kind} {text[:200]!r}")
        try:
            return json.loads(text)
        except ValueError as error:
            raise Unfetched(f"{path}: invalid JSON {text[:200]!r}") from error


def list_params(limit: int, offset: int, sort: str | None = None, include: str | None = None) -> dict:
    """Parameters of one page of a list."""
    out = {"page[limit]": limit, "page[offset]": offset}
    return out | ({"sort": sort} if sort else {}) | ({"include": include} if include else {})


class PageReader(SimpleDataSourceStreamReader):
    def __init__(self, fetch: Callable[[int, int], Sequence[tuple]], limit: int) -> None:
        self.fetch, self.limit = fetch, limit

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows: list[tuple] = []  # of BATCH_PAGES pages
        for _ in range(BATCH_PAGES):
            try:
                page = [tuple(r) for r in self.fetch(start["at"] + len(rows), self.limit)]
            except Exception:
                if not rows:
                    raise
                break  # the pages before it are a batch; the next one begins with this page
            rows += page
            if len(page) < self.limit:
                break
        return iter(rows), {"at": start["at"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch that was planned before a restart, page by page."""
        at = start["at"]
        while at < end["at"]:
            n = min(self.limit, end["at"] - at)
            page = [tuple(r) for r in self.fetch(at, n)][:n]
            yield from page
            at += len(page)
            if len(page) < n:
                break

    def commit(self, end: dict) -> None:
        pass


def list_stream(name: str, fields: str, fetcher: Fetcher, rows_of: Callable[[dict], Sequence[tuple]]) -> type[DataSource]:
    """A streaming source of the items of a list: options ``path``, ``limit`` (50), ``sort`` and ``include``.

    ``rows_of`` makes tuples of ``fields`` of a page's document.
    """

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return fields

        def simpleStreamReader(self, schema) -> PageReader:
            path, limit = self.options["path"], int(self.options.get("limit", 50))
            sort, include = self.options.get("sort"), self.options.get("include")
            return PageReader(lambda offset, n: rows_of(fetcher.json(path, list_params(n, offset, sort, include))), limit)

    return Pages
