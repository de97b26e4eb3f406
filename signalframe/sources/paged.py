"""A paged event service as a data source: filters go to the service, pages are read by tasks."""

from __future__ import annotations

import importlib
import json
import logging
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

log = logging.getLogger(__name__)

# The service's names of its filters.
EQUAL = {"learnerId": "learnerId", "sessionId": "sessionId", "eventType": "eventType"}
START, END = "startTs", "endTs"


@dataclass
class Pages(InputPartition):
    """A run of pages that one task reads, and the number of items that the service has in all."""

    begin: int
    end: int
    total: int


class PagedEvents(DataSource):
    """``spark.read.format("paged_events")``: events (eventType, learnerId, sessionId, timestamp, payload).

    Options: ``provider`` as module:function, called with (page from 1, size, filters) and returning (items, total);
    ``size`` of a page, ``pages`` of a task. Comparisons of learnerId, sessionId, eventType and timestamp with literals are
    sent as the service's filters; all others are Spark's. A page shorter than ``size`` ends its task's run. Where the
    items that a task gets aren't as many as the total says, it logs a warning and goes on with what there is.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_events"

    def schema(self) -> str:
        return "eventType string, learnerId string, sessionId string, timestamp long, payload string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.provider, self.size, self.pages = options["provider"], int(options.get("size", "1000")), int(options.get("pages", "10"))
        self.filters: dict[str, object] = {}

    def _call(self, page: int) -> tuple[list, int]:
        module, _, function = self.provider.partition(":")
        return getattr(importlib.import_module(module), function)(page, self.size, self.filters)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        name = ".".join(getattr(f, "attribute", ()))
        if isinstance(f, EqualTo | In) and name in EQUAL:
            values = sorted(f.value) if isinstance(f, In) else [f.value]
            if any(v is None for v in values):
                return False
            known = self.filters.get(EQUAL[name])
            self.filters[EQUAL[name]] = values if known is None else [v for v in known if v in values]
            return True
        if name != "timestamp":
            return False
        if isinstance(f, EqualTo) and f.value is not None:
            low, high = f.value, f.value
        elif isinstance(f, GreaterThanOrEqual | GreaterThan):
            low, high = f.value + isinstance(f, GreaterThan), None
        elif isinstance(f, LessThanOrEqual | LessThan):
            low, high = None, f.value - isinstance(f, LessThan)
        else:
            return False
        if low is not None:
            self.filters[START] = max(low, self.filters.get(START, low))
        if high is not None:
            self.filters[END] = min(high, self.filters.get(END, high))
        return True

    def partitions(self) -> list[Pages]:
        _, total = self._call(1)
        n = -(-total // self.size)
        return [Pages(p, min(p + self.pages, n + 1), total) for p in range(1, n + 1, self.pages)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        seen = 0
        for page in range(partition.begin, partition.end):
            items, _ = self._call(page)
            for e in items:
                yield e.get("eventType"), e.get("learnerId"), e.get("sessionId"), e.get("timestamp"), json.dumps(e.get("payload"), sort_keys=True)
            seen += len(items)
            if len(items) < self.size:
                break
        due = min(partition.total, (partition.end - 1) * self.size) - (partition.begin - 1) * self.size
        if seen != due:
            log.warning("pages %d to %d hold %d items, the service counts %d", partition.begin, partition.end - 1, seen, due)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedEvents)
