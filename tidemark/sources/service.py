"""A series service as a Spark data source: its requests dealt over a few lanes, each read by a task at a bounded pace.

``spark.dataSource.register(SeriesService)``, then
``spark.read.format("series_service").option("url", "https://host/series.csv?id={series_id}&vintage_date={vintage_date}").option("requests", "A:,B:2000-01-01").load()``.
"""

from __future__ import annotations

import csv
import io
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed delays in seconds: after a passing failure, and after the service refuses for now.
PASSING, REFUSED = (1, 3, 8), (5, 15, 40, 90)
REFUSALS = (403, 429, 503)
#: The time a service is given for each request, however many tasks ask.
BETWEEN = 0.35


class Paced:
    """Opens URLs at one lane's share of the pace: of `lanes` that ask at the same time each waits so many times `BETWEEN`
    between two requests, and its number of times before the first, so that together they keep the pace."""

    def __init__(self, open_=urllib.request.urlopen, pause=time.sleep, clock=time.monotonic, lanes: int = 1, lane: int = 0):
        self.open, self.pause, self.clock, self.between = open_, pause, clock, lanes * BETWEEN
        self.next = clock() + lane * BETWEEN

    def __call__(self, url: str):
        if (wait := self.next - self.clock()) > 0:
            self.pause(wait)
        self.next = max(self.next, self.clock()) + self.between
        return self.open(url)


def fetch(url: str, pause=time.sleep, open_=urllib.request.urlopen) -> str | None:
    """The text at a URL, with some patience; none where it isn't there.  A refusal starts the longer delays once."""
    delays, refused, tries = PASSING, False, 0
    while True:
        try:
            with open_(url) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if e.code in REFUSALS and not refused:
                delays, refused, tries = REFUSED, True, 0
            error = e
        except OSError as e:
            error = e
        if tries == len(delays):
            raise error
        pause(delays[tries])
        tries += 1


def parse(text: str | None, series_id: str, vintage: str | None) -> Iterator[tuple]:
    """Rows of text columns; a vintage without a value column is one that isn't archived, and empty."""
    rows = list(csv.reader(io.StringIO(text or "")))
    if not rows or len(rows[0]) < 2:
        if vintage:
            return
        raise ValueError(f"{series_id}: nothing was delivered")
    for r in rows[1:]:
        if len(r) >= 2:
            yield series_id, vintage, r[0], r[1]


class SeriesService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "series_service"

    def schema(self) -> str:
        return "series_id string, vintage_date string, observation_date string, value string"

    def reader(self, schema) -> DataSourceReader:
        return SeriesReader(self.options)


class Requests(InputPartition):
    """What one task fetches, one after another, and which of the lanes it is."""

    def __init__(self, wanted: list[tuple[str, str | None]], lane: int):
        self.wanted, self.lane = wanted, lane


class SeriesReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.requests = options["url"], options["requests"]
        self.lanes = int(options.get("lanes", 1))  # tasks that may ask at the same time

    def partitions(self) -> list[Requests]:
        wanted = [(s, v or None) for s, _, v in (r.partition(":") for r in self.requests.split(","))]
        return [Requests(lane, k) for k in range(self.lanes) if (lane := wanted[k :: self.lanes])]

    def read(self, partition: Requests) -> Iterator[tuple]:
        open_ = Paced(lanes=self.lanes, lane=partition.lane)
        for series_id, vintage in partition.wanted:
            yield from parse(fetch(self.url.format(series_id=series_id, vintage_date=vintage or ""), open_=open_), series_id, vintage)
