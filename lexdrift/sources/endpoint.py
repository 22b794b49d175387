"""A Python data source over a SPARQL endpoint, whose pages are dealt to lanes or follow each other, and a fetcher of documents.

Whatever is read by several tasks keeps one rate in all: time since a common
start is cut into slots of ``interval`` seconds, and the k-th of n lanes sends
only at the beginnings of slots k, k + n, k + 2 n and so on. A lane that is late
waits for its next slot, so no two requests are closer than the interval,
however long answers take and however many lanes run at once. Clocks of the
machines are taken to agree.
"""

from __future__ import annotations

import http.client
import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: What a request may end with and be tried again.
FAILURES = (OSError, http.client.HTTPException, ValueError)


class Slots:
    """The times at which one of ``lanes`` lanes may send."""

    def __init__(self, start: float, interval: float, lane: int = 0, lanes: int = 1):
        self.start, self.interval, self.lane, self.lanes, self.last = start, interval, lane, lanes, -1

    def next(self, now: float) -> float:
        """The beginning of this lane's first slot from ``now`` on that it has not used."""
        turn = max(self.last + 1, math.ceil(((now - self.start) / self.interval - self.lane) / self.lanes) if self.interval else 0)
        self.last = turn
        return self.start + (self.lane + turn * self.lanes) * self.interval

    def wait(self) -> None:
        if self.interval:
            time.sleep(max(0.0, self.next(time.time()) - time.time()))


class Lane(InputPartition):
    """Every ``lanes``-th page from ``lane`` on of ``pages`` (offset, limit); without pages it reads until a short one."""

    def __init__(self, lane: int, lanes: int, start: float, pages: list[tuple[int, int]] | None):
        super().__init__((lane, lanes))
        self.lane, self.lanes, self.start, self.pages = lane, lanes, start, pages


class SparqlReader(DataSourceReader):
    """Options: endpoint, query (without OFFSET and LIMIT, ordered totally), columns, total, page_size, max_items, tasks, interval seconds between any two requests.

    Without ``total`` one task reads page after page until a short one; with it
    ``tasks`` lanes (4) read pages side by side, at one rate in all. ``max_items``
    bounds the rows of either.
    """

    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.options = options

    def partitions(self):
        size, most, now = int(self.options.get("page_size", 10_000)), int(self.options.get("max_items", 0)), time.time()
        if "total" not in self.options:
            return [Lane(0, 1, now, None)]
        total = min(int(self.options["total"]), most or 1 << 62)
        pages = [(k, min(size, total - k)) for k in range(0, total, size)]
        lanes = max(1, min(int(self.options.get("tasks", 4)), len(pages)))
        return [Lane(k, lanes, now, pages[k::lanes]) for k in range(lanes)]

    def read(self, lane: Lane):
        slots = Slots(lane.start, float(self.options.get("interval", 1.0)), lane.lane, lane.lanes)
        if lane.pages is not None:
            for offset, limit in lane.pages:
                yield from self.rows(offset, limit, slots)
            return
        size, most, at = int(self.options.get("page_size", 10_000)), int(self.options.get("max_items", 0)) or 1 << 62, 0
        while at < most:
            n = 0
            for row in self.rows(at, min(size, most - at), slots):
                n += 1
                yield row
            at += n
            if n < size:
                return

    def rows(self, offset: int, limit: int, slots: Slots):
        query = f"{self.options['query']}\nOFFSET {offset}\nLIMIT {limit}"
        body = urllib.parse.urlencode({"query": query}).encode()
        ask = urllib.request.Request(self.options["endpoint"], body, {"Accept": "application/sparql-results+json"})
        for attempt in range(3):
            if attempt:
                time.sleep(slots.interval * 2**attempt)
            slots.wait()
            try:
                with urllib.request.urlopen(ask, timeout=30) as answer:
                    found = json.load(answer)
                break
            except FAILURES:
                if attempt == 2:
                    raise
        for row in found["results"]["bindings"]:
            yield tuple(row.get(n, {}).get("value") for n in self.names)


class SparqlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparql"

    def schema(self) -> StructType:
        return StructType([StructField(c.strip(), StringType()) for c in self.options["columns"].split(",")])

    def reader(self, schema: StructType) -> SparqlReader:
        return SparqlReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SparqlSource)


PAGE = "celex string, url string, language string, html string, status string, error string"
# Fixed value: what the document service is asked for.
ACCEPT = "application/xhtml+xml, text/html"


def fetch(url: str, language: str | None, slots: Slots, attempts: int = 3, timeout: float = 30) -> str | None:
    """A document's text in a language, which the request's header asks for; None where there is none.

    404 is an answer. Anything else is tried again after waits that double, and
    counts as none in this language after the last attempt.
    """
    headers = {"Accept": ACCEPT} | ({"Accept-Language": language} if language else {})
    for attempt in range(attempts):
        if attempt:
            time.sleep(slots.interval * 2**attempt)
        slots.wait()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
                body = answer.read()
                return body.decode(answer.headers.get_content_charset() or "utf-8", "replace") or None
        except urllib.error.HTTPError as error:
            if error.code == 404:
                return None
        except FAILURES:
            pass
    return None


def fetch_pages(keys: DataFrame, template: str, languages: list[str], key: str = "celex", tasks: int = 1, interval: float = 0.3) -> DataFrame:
    """celex, url, language, html, status, error of each key: the page in the first of ``languages`` that has one.

    ``template`` holds {key}, and {lang} where languages have addresses of their
    own. A key without a page in any language, and one whose requests all
    failed, has status ``not_found`` and says what was tried; neither ends the
    job. ``tasks`` fetch side by side, at one rate in all. Null and repeated keys
    are left out.
    """
    start = time.time()

    def run(frames):
        here = TaskContext.get()
        slots = Slots(start, interval, here.partitionId() if here else 0, tasks)
        for frame in frames:
            rows = []
            for name in frame["celex"]:
                url = lambda lang: template.format(key=urllib.parse.quote(name, safe=""), lang=lang)  # noqa: B023, E731
                for lang in languages:
                    if (body := fetch(url(lang), lang, slots)) is not None:
                        rows.append((name, url(lang), lang, body, "ok", None))
                        break
                else:
                    rows.append((name, url(languages[0]) if languages else None, None, None, "not_found", f"Not available in: {', '.join(languages)}"))
            yield pd.DataFrame(rows, columns=["celex", "url", "language", "html", "status", "error"])

    wanted = keys.select(F.col(key).cast("string").alias("celex")).where("celex is not null").distinct()
    # By number, so that partition k is lane k.
    return wanted.repartition(tasks).mapInPandas(run, PAGE)
