"""The search service as a Python data source: its query language, pushed filters, pacing over all tasks, retries, and a stream."""

from __future__ import annotations

import math
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader

#: Where the service is, how far apart calls must be, and the open ends of date ranges.
SERVICE, PAUSE, FIRST_DATE = "http://export.arxiv.org/api/query", 3.0, "200001010000"


def query(terms: list[str] | None = None, *, operator: str = "AND", category: str | None = None, field: str = "all", date_from: str | None = None, date_to: str | None = None) -> str:
    """The service's search expression; parts are joined by AND, in brackets if there are several."""
    parts = []
    if terms:
        joint = f" {operator} " if operator in ("AND", "OR") else " "
        parts.append(joint.join(f"{field}:{t}" for t in terms))
    if category:
        parts.append(f"cat:{category}")
    if date_from or date_to:
        parts.append(f"submittedDate:[{date_from or FIRST_DATE} TO {date_to or time.strftime('%Y%m%d%H%M', time.gmtime())}]")
    if not parts:
        raise ValueError("a search needs terms, a category or dates")
    return parts[0] if len(parts) == 1 else " AND ".join(f"({p})" for p in parts)


def url(expression: str, *, start: int = 0, max_results: int = 10, sort_by: str = "relevance", sort_order: str = "descending", service: str = SERVICE) -> str:
    return service + "?" + urllib.parse.urlencode({"search_query": expression, "start": start, "max_results": max_results, "sortBy": sort_by, "sortOrder": sort_order})


class Slots:
    """Times at which one of ``n`` callers may call, such that all of them together call once every ``pause`` seconds.

    Slot k lies ``k * pause`` seconds after ``began`` and belongs to caller k modulo n, so callers on different machines keep apart
    without a word between them, as far as their clocks agree; a caller that comes late takes its next slot.
    """

    def __init__(self, began: float, n: int, mine: int, pause: float) -> None:
        self.began, self.n, self.mine, self.pause, self.last = began, n, mine, pause, -1

    def wait(self) -> None:
        if self.pause <= 0:
            return
        k = max(self.last + 1, math.ceil((time.time() - self.began) / self.pause))
        self.last = k + (self.mine - k) % self.n
        time.sleep(max(0.0, self.began + self.last * self.pause - time.time()))


def fetch(address: str, *, tries: int = 3, wait: float = 5.0, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep, turn: Callable = lambda: None) -> str | None:
    """The document, or None after ``tries`` failures; waits grow by ``wait``, and every try waits for its ``turn``."""
    for n in range(1, tries + 1):
        turn()
        try:
            with opener(urllib.request.Request(address, headers={"User-Agent": "paperloom/1"}), timeout=30) as answer:
                return answer.read().decode("utf-8", "replace")
        except OSError:
            if n < tries:
                sleep(wait * n)
    return None


def _option(options: dict, name: str, other: str | None = None) -> str | None:
    return options.get(name) or options.get(name.lower()) or other


def address(topic: str, options: dict, start: int | None = None) -> str:
    """The address that a topic is asked for under the options of a read."""
    got = lambda name, other=None: _option(options, name, other)
    expression = query([topic], operator=got("operator", "AND"), category=got("category"), field=got("field", "all"), date_from=got("dateFrom"), date_to=got("dateTo"))
    first = int(got("start", "0")) if start is None else start
    return url(expression, start=first, max_results=int(got("maxResults", "10")), sort_by=got("sortBy", "relevance"), sort_order=got("sortOrder", "descending"), service=got("service", SERVICE))


def _topics(options: dict) -> list[str]:
    return [t for t in options.get("topics", "").split("\n") if t]


@dataclass
class _Topic(InputPartition):
    topic: str
    slots: Slots

    def __init__(self, value: int, topic: str, slots: Slots) -> None:
        super().__init__(value)
        self.topic, self.slots = topic, slots


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.asked, self.before = options, _topics(options), int(_option(options, "start", "0")) + 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on what is asked for become part of the question: topics, category, dates, and how far the pages go."""
        columns = {"category": "category", "date_from": "dateFrom", "date_to": "dateTo"}
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            now = _option(self.options, columns[name]) if name in columns else None
            if isinstance(f, EqualTo) and name in columns and now in (None, f.value):
                self.options[columns[name]] = f.value
            elif isinstance(f, GreaterThanOrEqual) and name == "date_from":
                self.options["dateFrom"] = max(f.value, now or f.value)
            elif isinstance(f, LessThanOrEqual) and name == "date_to":
                self.options["dateTo"] = min(f.value, now or f.value)
            elif isinstance(f, LessThan) and name == "start":
                self.before = int(f.value)
                yield f
            elif isinstance(f, EqualTo | In) and name == "topic":
                self.asked = [t for t in self.asked if t in ({f.value} if isinstance(f, EqualTo) else set(f.value))]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        began, pause, n = time.time(), float(self.options.get("pause", PAUSE)), len(self.asked)
        return [_Topic(i, t, Slots(began, n, i, pause)) for i, t in enumerate(self.asked)] or [_Topic(0, "", Slots(began, 1, 0, 0))]

    def read(self, partition: _Topic) -> Iterator[tuple]:
        """A row for each page that could be had; pages end with the first that names no entry."""
        step = max(1, int(_option(self.options, "maxResults", "10")))
        for start in range(int(_option(self.options, "start", "0")), self.before, step) if partition.topic else ():
            body = fetch(address(partition.topic, self.options, start), tries=int(self.options.get("tries", 3)), turn=partition.slots.wait)
            if body is None:
                break
            yield partition.topic, _option(self.options, "category"), _option(self.options, "dateFrom"), _option(self.options, "dateTo"), start, body
            if "<entry" not in body:
                break


class _Stream(SimpleDataSourceStreamReader):
    """One page of every topic a batch, as long as pages name entries; an offset is the number of the next page's first entry."""

    def __init__(self, options: dict) -> None:
        self.options, self.slots = options, Slots(time.time(), 1, 0, float(options.get("pause", PAUSE)))
        self.step = max(1, int(_option(options, "maxResults", "10")))

    def initialOffset(self) -> dict:
        return {"start": int(_option(self.options, "start", "0"))}

    def _page(self, start: int) -> list[tuple]:
        rows = []
        for topic in _topics(self.options):
            body = fetch(address(topic, self.options, start), tries=int(self.options.get("tries", 3)), turn=self.slots.wait)
            if body is not None and "<entry" in body:
                rows.append((topic, _option(self.options, "category"), _option(self.options, "dateFrom"), _option(self.options, "dateTo"), start, body))
        return rows

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._page(start["start"])
        return iter(rows), {"start": start["start"] + (self.step if rows else 0)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for at in range(start["start"], end["start"], self.step):
            yield from self._page(at)

    def commit(self, end: dict) -> None:
        pass


class PaperSearch(DataSource):
    """spark.read.format("papersearch").option("topics", ...).load() -> (topic, category, date_from, date_to, start, xml).

    Options: topics (one a line), field, category, operator, dateFrom, dateTo, start, maxResults (entries a page), sortBy, sortOrder,
    pause, tries, service.  Every topic is a task of its own; together they call once every ``pause`` seconds, retries included.  The
    columns beside ``xml`` are what was asked: equality with a category, topic or date, bounds on dates, and ``start < n``, which asks
    for further pages, reach the service.  A topic that cannot be had has no row.  ``readStream`` asks for one page a batch.
    """

    @classmethod
    def name(cls) -> str:
        return "papersearch"

    def schema(self) -> str:
        return "topic string, category string, date_from string, date_to string, start int, xml string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> _Stream:
        return _Stream(dict(self.options))


def register(spark) -> None:
    """Make the format known, and let filters reach it, which Spark has to be told."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PaperSearch)
