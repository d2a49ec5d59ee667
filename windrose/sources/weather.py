"""Hourly weather as a data source: one partition for each place and month, planned from options and pushed filters.

The answers lie in files, one folder a kind (archive or forecast), place and month, as a service sends them: an object whose
``hourly`` has arrays of equal length, ``time`` and the measures. Files without it, or that are no JSON, give no rows. What
is read elsewhere over HTTP is a matter of who fills the folders.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class PlaceMonth(InputPartition):
    place: str
    month: str


def _months(first: datetime.date, last: datetime.date) -> Iterator[str]:
    year, month = first.year, first.month
    while (year, month) <= (last.year, last.month):
        yield f"{year:04d}-{month:02d}"
        year, month = year + month // 12, month % 12 + 1


class HourlyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.kind = options["path"].rstrip("/"), options["kind"]
        self.places = [x for x in options["places"].split(",") if x]
        self.measures = [x for x in options["measures"].split(",") if x]
        self.first, self.last = (datetime.date.fromisoformat(options[x]) for x in ("start", "end"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Places and bounds of time shorten the plan; bounds still hold row by row, so these go back to Spark as well."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("airport",):
                self.places = [p for p in self.places if p == f.value]
                continue
            if isinstance(f, In) and f.attribute == ("airport",):
                self.places = [p for p in self.places if p in f.value]
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("time",) and isinstance(f.value, datetime.datetime):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.first = max(self.first, f.value.date())
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.last = min(self.last, f.value.date())
            yield f

    def partitions(self) -> Sequence[PlaceMonth]:
        return [PlaceMonth(p, m) for p in self.places for m in _months(self.first, self.last)] or [PlaceMonth("", "")]

    def read(self, partition: PlaceMonth) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        root = self.root.removeprefix("file:") if self.root.startswith("file:/") and not self.root.startswith("file://") else self.root
        store, top = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        folder = fs.FileSelector(f"{top}/{self.kind}/place={partition.place}/month={partition.month}", allow_not_found=True)
        for info in store.get_file_info(folder) if partition.place else ():
            if info.type != fs.FileType.File or info.base_name.startswith(("_", ".")):
                continue
            with store.open_input_stream(info.path) as f:
                for line in f.read().decode("utf-8", "replace").splitlines():
                    yield from self._rows(partition.place, line)

    def _rows(self, place: str, body: str) -> Iterator[pa.RecordBatch]:
        try:
            hourly = json.loads(body)["hourly"]
            times = [datetime.datetime.fromisoformat(t) for t in hourly["time"]]
        except (ValueError, KeyError, TypeError):
            return
        inside = [i for i, t in enumerate(times) if self.first <= t.date() <= self.last]
        columns = [pa.array([place] * len(inside)), pa.array([times[i] for i in inside], pa.timestamp("us"))]
        for m in self.measures:
            given = hourly.get(m) or []
            columns.append(pa.array([given[i] if i < len(given) else None for i in inside], pa.float64()))
        yield pa.RecordBatch.from_arrays(columns, names=["airport", "time", *self.measures])


class HourlyWeather(DataSource):
    """Options: path, kind, places and measures (comma-separated), start and end (days, both included)."""

    @classmethod
    def name(cls) -> str:
        return "hourly_weather"

    def schema(self) -> str:
        return ", ".join(["airport string", "time timestamp_ntz", *(f"{m} double" for m in self.options["measures"].split(",") if m)])

    def reader(self, schema) -> HourlyReader:  # noqa: ANN001
        return HourlyReader(self.options)


def hourly(spark: SparkSession, path: str, kind: str, places: Sequence[str], measures: Sequence[str], start: str, end: str) -> DataFrame:
    """airport, time and the measures of a kind of answers."""
    spark.dataSource.register(HourlyWeather)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("hourly_weather").options(path=path, kind=kind, places=",".join(places), measures=",".join(measures), start=start, end=end).load()


def archive_with_forecast(archive: DataFrame, forecast: DataFrame) -> DataFrame:
    """Hours that both know, with the measures of both."""
    return archive.join(forecast, ["airport", "time"])
