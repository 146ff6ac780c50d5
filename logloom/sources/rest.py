"""Search services as Spark data sources: queries go out with time range and host, LogEvent rows come back.

`register(spark)` makes the formats `log_elastic`, `log_splunk`, `log_loki` and `log_librenms` known; options are url, host,
since_seconds, until, limit, partitions and the credentials token, user and password, cookie. The time range is cut into
`partitions` slices, each fetched by a task of its own, so a pull isn't bound to one machine. An answer holds so many rows at
most; a slice whose answer is full is asked for again in halves, the newer one first, so that no row is lost, and a moment
that can't be halved any more is an error. `limit` is the number of rows wanted of a slice at most, all of them by default.
A filter hostname = x goes to the services that look for it in the same field."""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SCHEMA = "timestamp string, hostname string, appname string, severity_raw string, message string"
#: Rows that one answer holds at most, by service.
MOST = {"elastic": 10_000, "splunk": 50_000, "loki": 5_000, "librenms": 1_000}
#: Fields of a search document that may hold a column, the first that isn't empty counts.
FIELDS = {
    "timestamp": ("@timestamp", "timestamp", "ts", "event.created"),
    "hostname": ("host.name", "host.hostname", "host", "hostname", "agent.name"),
    "appname": ("process.name", "app", "appname", "program", "syslog.appname"),
    "severity_raw": ("log.syslog.severity.name", "severity", "level", "log.level"),
    "message": ("message", "msg", "log.original", "event.original"),
}


class SourceError(Exception):
    """A service that can't be asked: wrong options, no credentials, no answer."""


def credentials(options: dict, header: str = "Authorization", scheme: str = "Bearer") -> dict[str, str]:
    """Headers of the first way to sign in that options have: token, user and password, cookie."""
    if options.get("token"):
        return {header: f"{scheme} {options['token']}".strip()}
    if options.get("user") and options.get("password"):
        return {"Authorization": "Basic " + base64.b64encode(f"{options['user']}:{options['password']}".encode()).decode()}
    if options.get("cookie"):
        return {"Cookie": options["cookie"]}
    raise SourceError("no credentials: give token, user and password, or cookie")


def fetch_json(url: str, headers: dict, body: bytes | None, timeout: float) -> object:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:
            return json.load(answer)
    except (OSError, ValueError) as error:
        raise SourceError(f"{urllib.parse.urlsplit(url).netloc}: {error}") from error


def at(document: object, path: str) -> object:
    for part in path.split("."):
        document = document.get(part) if isinstance(document, dict) else None
    return document


def pick(document: dict, column: str, default: str = "") -> str:
    for path in FIELDS[column]:
        v = at(document, path)
        if v is not None and v != "" and not isinstance(v, (dict, list)):
            return str(v)
    return default


def elastic_request(o: dict, low: int, high: int) -> tuple[str, dict, bytes]:
    must: list[dict] = [{"range": {"@timestamp": {"gte": low, "lt": high, "format": "epoch_millis"}}}]
    if o.get("host"):
        must.append({"bool": {"should": [{"match_phrase": {f: o["host"]}} for f in ("host.name", "hostname", "host")], "minimum_should_match": 1}})
    query = {"size": o["page"], "sort": [{"@timestamp": "desc"}], "query": {"bool": {"must": must}}}
    return f"{o['url']}/{o.get('index', '*')}/_search", credentials(o, scheme=o.get("scheme", "Bearer")) | {"Content-Type": "application/json"}, json.dumps(query).encode()


def elastic_rows(answer: dict) -> Iterator[tuple]:
    for hit in (answer.get("hits") or {}).get("hits") or []:
        d = hit.get("_source") or {}
        if message := pick(d, "message"):
            yield pick(d, "timestamp"), pick(d, "hostname"), pick(d, "appname", "kibana"), pick(d, "severity_raw", "info"), message


def splunk_request(o: dict, low: int, high: int) -> tuple[str, dict, bytes]:
    search = o.get("search", "search *") + (f' host="{o["host"]}"' if o.get("host") else "")
    form = {"search": search, "earliest_time": low / 1000, "latest_time": high / 1000, "count": o["page"], "output_mode": "json", "exec_mode": "oneshot"}
    return f"{o['url']}/services/search/jobs", credentials(o), urllib.parse.urlencode(form).encode()


def splunk_rows(answer: dict) -> Iterator[tuple]:
    for r in answer.get("results") or []:
        if r.get("_raw"):
            yield str(r.get("_time") or ""), str(r.get("host") or ""), str(r.get("sourcetype") or "splunk"), str(r.get("severity") or "info"), str(r["_raw"])


def loki_request(o: dict, low: int, high: int) -> tuple[str, dict, None]:
    query = o.get("query", '{job=~".+"}') + (f' |= "{o["host"]}"' if o.get("host") else "")
    form = {"query": query, "start": low * 10**6, "end": high * 10**6, "limit": o["page"], "direction": "backward"}
    return f"{o['url']}/loki/api/v1/query_range?{urllib.parse.urlencode(form)}", credentials(o) if any(o.get(k) for k in ("token", "user", "cookie")) else {}, None


def loki_rows(answer: dict) -> Iterator[tuple]:
    for stream in (answer.get("data") or {}).get("result") or []:
        labels = stream.get("stream") or {}
        first = lambda *names: next((str(labels[n]) for n in names if labels.get(n)), "")
        for stamp, line in stream.get("values") or []:
            yield str(stamp), first("host", "hostname", "instance"), first("app", "job", "service") or "loki", first("level", "severity") or "info", line


def librenms_request(o: dict, low: int, high: int) -> tuple[str, dict, None]:
    if not o.get("token"):
        raise SourceError("a token is needed")
    stamp = lambda t: time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(t))
    form = urllib.parse.urlencode({"from": stamp(low // 1000), "to": stamp(high // 1000 - 1), "limit": o["page"]})  # both ends count
    host = "/" + urllib.parse.quote(o["host"], safe="") if o.get("host") else ""
    return f"{o['url']}/api/v0/logs/eventlog{host}?{form}", {"X-Auth-Token": o["token"]}, None


def librenms_rows(answer: dict) -> Iterator[tuple]:
    for r in answer.get("logs") or []:
        if r.get("message"):
            yield str(r.get("datetime") or ""), str(r.get("hostname") or ""), str(r.get("type") or "librenms"), str(r.get("severity") or "info"), str(r["message"])


KINDS: dict[str, tuple[Callable, Callable]] = {"elastic": (elastic_request, elastic_rows), "splunk": (splunk_request, splunk_rows), "loki": (loki_request, loki_rows), "librenms": (librenms_request, librenms_rows)}


#: Milliseconds that a service tells apart; services that look for a host in its own field; where a service tells how it is.
FINEST = {"elastic": 1, "splunk": 1, "loki": 1, "librenms": 1000}
BY_FIELD = ("elastic", "splunk", "librenms")
HEALTH = {"elastic": "/_cluster/health", "splunk": "/services/server/info", "loki": "/ready", "librenms": "/api/v0"}


class Slice(InputPartition):
    """A range of time in milliseconds, its end excluded."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        if not options.get("url"):
            raise SourceError("option url is needed")
        self.kind, self.options = kind, {**options, "url": options["url"].rstrip("/")}
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.options["page"] = min(self.limit or MOST[kind], MOST[kind])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Take hostname = x along where the service knows it; Spark tests every row again."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("hostname",) and self.kind in BY_FIELD and not self.options.get("host"):
                self.options["host"] = str(f.value)
            yield f

    def partitions(self) -> list[Slice]:
        end = int(self.options.get("until", time.time()))
        begin = end - int(self.options.get("since_seconds", 3600))
        n = max(1, int(self.options.get("partitions", 1)))
        cuts = [1000 * (begin + (end - begin) * i // n) for i in range(n + 1)]
        return [Slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        left, (ask, rows), page = self.limit, KINDS[self.kind], self.options["page"]
        todo = [(partition.low, partition.high)]
        while todo and (left is None or left > 0):
            low, high = todo.pop()
            if low >= high:
                continue
            url, headers, body = ask(self.options, low, high)
            answer = fetch_json(url, headers, body, float(self.options.get("timeout", 30)))
            if held(self.kind, answer) >= page and (left is None or left > page):
                middle = (low + high) // 2 // FINEST[self.kind] * FINEST[self.kind]
                if not low < middle < high:
                    raise SourceError(f"{self.kind}: more than {page} rows within {high - low} ms")
                todo += [(low, middle), (middle, high)]
                continue
            for row in rows(answer):
                if left is not None:
                    if not left:
                        return
                    left -= 1
                yield row


def held(kind: str, answer: dict) -> int:
    """Rows of an answer, those without a message too."""
    if kind == "loki":
        return sum(len(s.get("values") or []) for s in (answer.get("data") or {}).get("result") or [])
    return len({"elastic": lambda: (answer.get("hits") or {}).get("hits"), "splunk": lambda: answer.get("results"), "librenms": lambda: answer.get("logs")}[kind]() or [])


def health(kind: str, options: dict) -> tuple[bool, str]:
    """Whether a service answers as one that can be asked, and what it said."""
    try:
        url, headers, _ = KINDS[kind][0]({**options, "url": options["url"].rstrip("/"), "page": 1}, 0, 1000)
        request = urllib.request.Request(options["url"].rstrip("/") + HEALTH[kind] + ("?output_mode=json" if kind == "splunk" else ""), None, {k: v for k, v in headers.items() if k != "Content-Type"})
        with urllib.request.urlopen(request, timeout=float(options.get("timeout", 10))) as answer:
            text = answer.read(65_536).decode("utf-8", "replace")
    except urllib.error.HTTPError as error:
        return kind == "loki" and error.code == 503, f"status {error.code}"
    except (OSError, ValueError, KeyError, SourceError) as error:
        return False, str(error)
    if kind == "elastic":
        try:
            status = str(json.loads(text).get("status"))
        except ValueError:
            return False, "no JSON"
        return status in ("green", "yellow"), status
    return True, "ok"


def _source(kind: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"log_{kind}"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(kind, dict(self.options))

    return Source


def register(spark) -> list[str]:
    """Make the formats known to a session; their names."""
    for kind in KINDS:
        spark.dataSource.register(_source(kind))
    return [f"log_{k}" for k in KINDS]
