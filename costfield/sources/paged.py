"""Features of a paged web service as a table: a Spark data source whose partitions are pages.

The service is asked once how many features there are; each page is then a partition that its executor fetches, so pages come in parallel and a lost
one is fetched again. A page that fails for a while is tried again, one that is refused as too large is halved, one that comes short is read on from where it ended. Features
that two pages repeat count once, and a table with fewer features than the service announced is an error, not a result.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds to wait before each further try.
WAITS = (2.0, 5.0, 10.0)
HIDDEN = "[REDACTED]"
#: How each kind of service names the first feature, the number of features, the request for their number, and its answer.
KINDS = {
    "arcgis": ("resultOffset", "resultRecordCount", {"returnCountOnly": "true", "f": "json"}, "count"),
    "wfs": ("startIndex", "count", {"resultType": "hits"}, "numberMatched"),
}


def redacted(text: str, secret: str) -> str:
    """``text`` without the secret, plain or as a URL has it."""
    for form in sorted({secret, urllib.parse.quote(secret, safe=""), urllib.parse.quote_plus(secret)} - {""}, key=len, reverse=True):
        text = text.replace(form, HIDDEN)
    return text


@dataclass
class Page(InputPartition):
    start: int
    size: int


class _Client:
    """Requests of one service; its messages and features never hold the key."""

    def __init__(self, options: dict[str, str]):
        self.url, self.kind, self.key = options["url"], options.get("kind", "arcgis"), options.get("key", "")
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of service: {self.kind}")
        self.id, self.size = options.get("id", "id"), int(options.get("pagesize", "2000"))
        self.parameters = json.loads(options.get("parameters", "{}"))
        self.waits = tuple(map(float, json.loads(options.get("waits", json.dumps(WAITS)))))
        self.key_name, self.timeout = options.get("keyname", "token"), float(options.get("timeout", "120"))

    def _get(self, more: dict[str, str]) -> dict:
        query = urllib.parse.urlencode(self.parameters | more | ({self.key_name: self.key} if self.key else {}))
        with urllib.request.urlopen(f"{self.url}?{query}", timeout=self.timeout) as answer:  # the caller names the service
            return json.loads(answer.read())

    def ask(self, more: dict[str, str]) -> dict | None:
        """The service's answer after some tries; None if it keeps on refusing what was asked (status 400)."""
        for wait in (*self.waits, None):
            try:
                answer = self._get(more)
                if "error" in answer:
                    raise ValueError(redacted(f"the service reports an error: {answer['error']}", self.key))
                return answer
            except urllib.error.HTTPError as error:
                known = error.code in (401, 429) or error.code >= 500 or error.code == 400
                if not known or wait is None:
                    if error.code == 400:
                        return None
                    raise ValueError(f"the service answers {error.code} at {more}") from None
            except OSError as error:
                if wait is None:
                    raise ValueError(f"the service doesn't answer at {more}: {type(error).__name__}") from None
            time.sleep(wait)
        return None

    def count(self) -> int:
        _, _, request, name = KINDS[self.kind]
        answer = self.ask(request)
        if answer is None or not str(answer.get(name, "")).isdigit():
            raise ValueError("the service doesn't tell how many features there are")
        return int(answer[name])

    def features(self, start: int, size: int) -> Iterator[tuple[int, dict]]:
        """The features from ``start`` on, ``size`` of them, each with its place."""
        first, most, _, _ = KINDS[self.kind]
        while size > 0:
            answer = self.ask({first: str(start), most: str(size), "outputFormat" if self.kind == "wfs" else "f": "geojson"})
            if answer is None:
                if size == 1:
                    raise ValueError(f"the service refuses the feature at {start}")
                half = size // 2
                yield from self.features(start, half)
                start, size = start + half, size - half
                continue
            found = answer.get("features")
            if not isinstance(found, list):
                raise ValueError(f"the answer at {start} has no features")
            if not found:
                return  # the service has fewer than it said; the check of the whole tells
            yield from zip(range(start, start + len(found)), found[:size], strict=False)
            start, size = start + len(found), size - len(found)

    def identity(self, feature: dict) -> str:
        found = feature.get(self.id, feature.get("properties", {}).get(self.id))
        if found is None:
            raise ValueError(f"a feature has no {self.id}")
        return str(found)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.client = _Client(options)

    def partitions(self) -> list[Page]:
        count, size = self.client.count(), self.client.size
        return [Page(k, min(size, count - k)) for k in range(0, count, size)] or [Page(0, 0)]

    def read(self, page: Page) -> Iterator[tuple]:
        for place, feature in self.client.features(page.start, page.size):
            yield place, self.client.identity(feature), redacted(json.dumps(feature, ensure_ascii=False, sort_keys=True), self.client.key)


class PagedFeatures(DataSource):
    """Options: url, kind (arcgis or wfs), id, pagesize, parameters (JSON), key and keyname, waits (JSON, seconds), timeout."""

    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return "place long, id string, feature string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_features(spark: SparkSession, **options: str) -> DataFrame:
    """(id, feature): the features of a service, each id once, as its first place has it, as JSON; options as ``PagedFeatures`` has them.

    ``check_complete`` tells whether all have come.
    """
    spark.dataSource.register(PagedFeatures)
    rows = spark.read.format("paged_features").options(**options).load()
    first = rows.groupBy("id").agg(F.min(F.struct("place", "feature")).alias("f"))
    return first.select("id", F.col("f.feature").alias("feature"))


def check_complete(found: DataFrame, **options: str) -> DataFrame:
    """``found``, a stored table of ``read_features``, if it has as many ids as the service announces; else an error."""
    wanted, there = _Client({k.lower(): v for k, v in options.items()}).count(), found.count()
    if there != wanted:
        raise ValueError(f"{there} different features of {wanted} have come")
    return found
