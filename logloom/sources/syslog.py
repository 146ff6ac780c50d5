"""Syslog lines as a stream: format `log_syslog`, options host, port, batch_lines, and listen (`udp` or `tcp`).

With listen a socket is bound and what devices send is kept in a buffer of batch_lines lines, the oldest dropped and counted;
without it, lines are read from a forwarder's TCP port. What a batch has read stays in the driver's memory until the batch is
committed. For production put a queue that keeps what it is sent between devices and Spark: a socket can't be read again
after the driver is lost."""

from __future__ import annotations

import socket
import threading
import time
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from logloom.operators import cascade

#: Lines that are kept at most.
KEPT = 50_000


class Listener:
    """Lines that come in over a bound socket: datagrams one each, connections one after another, cut at line feeds."""

    def __init__(self, proto: str = "udp", host: str = "127.0.0.1", port: int = 0, most: int = KEPT):
        self.lines: deque[str] = deque()
        self.most, self.dropped, self.lock, self.stop = most, 0, threading.Lock(), threading.Event()
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM if proto == "udp" else socket.SOCK_STREAM)
        self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        self.socket.bind((host, port))
        self.port = self.socket.getsockname()[1]
        if proto != "udp":
            self.socket.listen(8)
        self.socket.settimeout(0.2)
        self.thread = threading.Thread(target=self._datagrams if proto == "udp" else self._connections, daemon=True)
        self.thread.start()

    def keep(self, raw: bytes) -> None:
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        with self.lock:
            if line:
                self.lines.append(line)
            while len(self.lines) > self.most:
                self.lines.popleft()
                self.dropped += 1

    def _datagrams(self) -> None:
        while not self.stop.is_set():
            try:
                self.keep(self.socket.recv(65_535))
            except TimeoutError:
                continue
            except OSError:
                return

    def _connections(self) -> None:
        while not self.stop.is_set():
            try:
                connection, _ = self.socket.accept()
            except TimeoutError:
                continue
            except OSError:
                return
            with connection:
                connection.settimeout(2.0)
                rest = b""
                try:
                    while not self.stop.is_set() and (data := connection.recv(65_536)):
                        *whole, rest = (rest + data).split(b"\n")
                        for line in whole:
                            self.keep(line)
                except OSError:
                    pass
                self.keep(rest)

    def drain(self, most: int | None = None) -> list[str]:
        """What has come, oldest first; with most, the newest of it, the rest is gone."""
        with self.lock:
            out = list(self.lines)
            self.lines.clear()
        return out[-most:] if most else out

    def alive(self) -> bool:
        return self.thread.is_alive()

    def close(self) -> None:
        self.stop.set()
        self.socket.close()
        self.thread.join(2.0)


class LineReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.address = options.get("host", "localhost"), int(options["port"])
        self.most, self.wait = int(options.get("batch_lines", KEPT)), float(options.get("wait_seconds", 0.5))
        self.kept: dict[int, list[tuple]] = {}
        self.listener = Listener(options["listen"], *self.address, self.most) if options.get("listen") else None
        self.socket, self.rest = None, b""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"line": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = start["line"]
        lines = self._heard() if self.listener else self._asked()
        rows = [(at + i, x) for i, x in enumerate(lines)]
        self.kept[at] = rows
        return iter(rows), {"line": at + len(rows)}

    def _heard(self) -> list[str]:
        until = time.time() + self.wait
        while not self.listener.lines and time.time() < until:
            time.sleep(0.02)
        return self.listener.drain()

    def _asked(self) -> list[str]:
        lines, until = [], time.time() + self.wait
        if self.socket is None:
            self.socket = socket.create_connection(self.address, timeout=self.wait)
        while len(lines) < self.most and time.time() < until:
            try:
                data = self.socket.recv(65_536)
            except TimeoutError:
                break
            if not data:
                if self.rest:
                    lines.append(self.rest.decode("utf-8", "replace"))
                    self.rest = b""
                break
            *whole, self.rest = (self.rest + data).split(b"\n")
            lines += [x.decode("utf-8", "replace") for x in whole]
        return lines

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        rows = [r for own in self.kept.values() for r in own]
        return iter([r for r in rows if start["line"] <= r[0] < end["line"]])

    def commit(self, end: dict) -> None:
        self.kept = {a: rows for a, rows in self.kept.items() if rows and rows[-1][0] >= end["line"]}


class SyslogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_syslog"

    def schema(self) -> str:
        return "seq bigint, line string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return LineReader(dict(self.options))


def register(spark) -> str:
    spark.dataSource.register(SyslogSource)
    return "log_syslog"


def events(lines: DataFrame, host: str = "") -> DataFrame:
    """The LogEvents of lines(seq, line), of hosts whose name holds `host`, which lines without one are given too."""
    parsed = cascade.parse(lines.select("seq", "line", F.lit(host or "syslog").alias("default_host")))
    return parsed.where((F.col("hostname") == "") | F.contains("hostname", F.lit(host))) if host else parsed
