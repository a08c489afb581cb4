"""Documents over HTTP as Spark data sources, read in a batch or as a stream of days.

    spark.dataSource.register(HttpDocuments)
    spark.read.format("http_documents").option("template", "https://host/{key}.json").option("keys", "A,B:2019-12-31").load()

Rows: key, last_day, url, status, body, error. A key may name the last day that its document speaks of. With the option
`pushdown` (and spark.sql.python.filterPushdown.enabled, without which Spark refuses it) comparisons of key and last_day with
constants reach the source, which asks for no document that they leave out. A key that stays out of reach gives a row with its error, so one bad key does not stop the others; 404 is an
answer with a null body.

`rate` is how many requests a second all tasks send together, attempts after a failure included: keys are dealt to `tasks`
tasks at most, each of which begins at its own offset and leaves tasks / rate seconds between requests, so whichever of them
run at a time stay under it.

    spark.readStream.format("http_days").option("template", "https://host/{key}?from={from}&to={to}").option("keys", "A,B")

A batch of the stream asks each key for the days after the last one that the checkpoint holds for it, up to `until` (a day,
or a URL that answers with one; else yesterday in UTC). A key that fails ends the batch, whose offset is then not
committed; a restart asks for the same days again. A key that is new to the list begins after `since`.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = "key string, last_day date, url string, status int, body string, error string"
DAYS_SCHEMA = "key string, first_day date, last_day date, url string, status int, body string"


@dataclass
class Keys(InputPartition):
    keys: list[tuple[str, dt.date | None]]
    #: Seconds after the source was planned at which the first request goes out, and between requests.
    wait: float = 0.0
    apart: float = 0.0


@dataclass
class Days(InputPartition):
    spans: list[tuple[str, str, str]]
    wait: float = 0.0
    apart: float = 0.0


class Pace:
    """Leaves `apart` seconds between requests of a task, the first one `wait` seconds from now."""

    def __init__(self, wait: float, apart: float):
        import time

        self.clock, self.sleep, self.apart = time.monotonic, time.sleep, apart
        self.next = self.clock() + wait

    def __call__(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(self.next, now) + self.apart


def fetch(url: str, agent: str, attempts: int, timeout: float, backoff: float, pace: Pace | None = None) -> tuple[int | None, str | None, str | None]:
    """(status, body, error); waits backoff * 2**n seconds before the n-th new attempt."""
    import time
    import urllib.error
    import urllib.request

    error = None
    for n in range(attempts):
        if n:
            time.sleep(backoff * 2 ** (n - 1))
        if pace:
            pace()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
                return answer.status, answer.read().decode("utf-8", "replace"), None
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return 404, None, None
            error = f"HTTP {e.code}"
        except OSError as e:
            error = str(e)[:50]
    return None, None, error


class _Client:
    """What both sources are told: whom to ask, how often, how fast."""

    def __init__(self, options: dict[str, str]):
        self.template = options["template"]
        self.batch, self.tasks = int(options.get("batch", "50")), int(options.get("tasks", "8"))
        self.agent = options.get("agent", "marketlake")
        self.attempts, self.timeout = int(options.get("attempts", "3")), float(options.get("timeout", "15"))
        self.backoff, self.rate = float(options.get("backoff", "1")), float(options.get("rate", "0"))

    def ask(self, url: str, pace: Pace | None = None) -> tuple[int | None, str | None, str | None]:
        return fetch(url, self.agent, self.attempts, self.timeout, self.backoff, pace)

    def deal(self, things: list, kind: type) -> list:
        """Partitions of things; with a rate no more of them than tasks, each with its share of it."""
        if not self.rate:
            return [kind(things[i : i + self.batch]) for i in range(0, len(things), self.batch)]
        n = min(self.tasks, len(things))
        return [kind(things[i::n], i / self.rate, n / self.rate) for i in range(n)]


def _keys(text: str) -> list[tuple[str, dt.date | None]]:
    named = [k.strip().rpartition(":") for k in text.split(",") if k.strip()]
    return [(key, dt.date.fromisoformat(day)) if key and len(day) == 10 and day[4] == day[7] == "-" else (f"{key}{sep}{day}", None) for key, sep, day in named]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.client = _Client(options)
        self.keys = _keys(options.get("keys", ""))

    def partitions(self) -> list[InputPartition]:
        return self.client.deal(self.keys, Keys) or [Keys([])]

    def read(self, partition: Keys) -> Iterator[tuple]:
        from urllib.parse import quote

        pace = Pace(partition.wait, partition.apart)
        for key, day in partition.keys:
            url = self.client.template.replace("{key}", quote(key))
            yield (key, day, url, *self.client.ask(url, pace))


class _PushingReader(_Reader):
    _TESTS = {
        EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
        LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b, IsNotNull: lambda a, b: True,
    }

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keys that a comparison leaves out are never asked for; what is no comparison of key or last_day stays with Spark."""
        for f in filters:
            test, place = self._TESTS.get(type(f)), {("key",): 0, ("last_day",): 1}.get(f.attribute if hasattr(f, "attribute") else None)
            if test is None or place is None:
                yield f
                continue
            value = getattr(f, "value", None)
            self.keys = [k for k in self.keys if k[place] is not None and test(k[place], value)]


class HttpDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (_PushingReader if options.get("pushdown", "false") == "true" else _Reader)(options)


class _DayReader(DataSourceStreamReader):
    """The offset is the last day read of each key."""

    def __init__(self, options: dict[str, str]):
        self.client = _Client(options)
        self.keys, self.since, self.until = [k for k, _ in _keys(options.get("keys", ""))], options["since"], options.get("until")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        day = self.until or (dt.datetime.now(dt.UTC).date() - dt.timedelta(days=1)).isoformat()
        if "://" in day:
            status, day, error = self.client.ask(day)
            if status != 200:
                raise RuntimeError(f"the last day is not known: {error or status}")
        return dict.fromkeys(self.keys, dt.date.fromisoformat(day.strip()).isoformat())

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        spans = []
        for key, last in sorted(end.items()):
            known = start.get(key, self.since)
            if known < last:
                spans.append((key, (dt.date.fromisoformat(known) + dt.timedelta(days=1)).isoformat(), last))
        return self.client.deal(spans, Days)

    def read(self, partition: Days) -> Iterator[tuple]:
        from urllib.parse import quote

        pace = Pace(partition.wait, partition.apart)
        for key, first, last in partition.spans:
            url = self.client.template.replace("{key}", quote(key)).replace("{from}", first).replace("{to}", last)
            status, body, error = self.client.ask(url, pace)
            if status is None:
                raise RuntimeError(f"{key}: {error}")
            yield key, dt.date.fromisoformat(first), dt.date.fromisoformat(last), url, status, body

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the checkpoint holds the offset."""


class HttpDays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_days"

    def schema(self) -> str:
        return DAYS_SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _DayReader(dict(self.options))
