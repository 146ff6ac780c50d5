"""Sources: requests and answers of search services, files, bundles, the environment."""

import json

import pytest

from logloom.sources import files, rest, syslog

CANNED = {
    "elastic": {"hits": {"hits": [{"_source": {"@timestamp": "t", "host": {"name": "h"}, "log": {"level": "err"}, "message": "m"}}, {"_source": {"host": "h"}}, {"_source": {"msg": "n", "hostname": "k"}}]}},
    "splunk": {"results": [{"_raw": "m", "_time": "t", "host": "h", "sourcetype": "s", "severity": "x"}, {"host": "h"}]},
    "loki": {"data": {"result": [{"stream": {"host": "h", "job": "j", "level": "warn"}, "values": [["1", "a"], ["2", "b"]]}]}},
    "librenms": {"logs": [{"datetime": "t", "hostname": "h", "type": "y", "severity": 3, "message": "m"}, {"message": ""}]},
}
ROWS = {
    "elastic": [("t", "h", "kibana", "err", "m"), ("", "k", "kibana", "info", "n")],
    "splunk": [("t", "h", "s", "x", "m")],
    "loki": [("1", "h", "j", "warn", "a"), ("2", "h", "j", "warn", "b")],
    "librenms": [("t", "h", "y", "3", "m")],
}


@pytest.mark.parametrize("kind", sorted(CANNED))
def test_services(kind, monkeypatch):
    asked = []
    monkeypatch.setattr(rest, "fetch_json", lambda url, headers, body, timeout: asked.append((url, headers, body)) or CANNED[kind])
    reader = rest.Reader(kind, {"url": "http://x/", "token": "k", "host": "h1", "limit": "10000000", "partitions": "3", "until": "9000", "since_seconds": "900"})
    slices = reader.partitions()
    assert [(s.low, s.high) for s in slices] == [(8_100_000, 8_400_000), (8_400_000, 8_700_000), (8_700_000, 9_000_000)]
    assert list(reader.read(slices[0])) == ROWS[kind]
    url, headers, body = asked[0]
    assert "h1" in url + (body or b"").decode() and "k" in " ".join(headers.values()) and reader.options["page"] == rest.MOST[kind]


@pytest.mark.parametrize("kind", sorted(CANNED))
def test_full_answers_are_asked_for_in_halves(kind, monkeypatch):
    """A service with one row a second that gives ten rows at most; every row arrives once, with a limit the newest ones."""
    shape = {"elastic": lambda ts: {"hits": {"hits": [{"_source": {"msg": str(t)}} for t in ts]}}, "splunk": lambda ts: {"results": [{"_raw": str(t)} for t in ts]}, "loki": lambda ts: {"data": {"result": [{"stream": {}, "values": [["1", str(t)] for t in ts]}]}}, "librenms": lambda ts: {"logs": [{"message": str(t)} for t in ts]}}[kind]
    monkeypatch.setitem(rest.MOST, kind, 10)
    monkeypatch.setitem(rest.KINDS, kind, (lambda o, low, high: (low, high, o["page"]), rest.KINDS[kind][1]))
    per = {"n": 1}
    monkeypatch.setattr(rest, "fetch_json", lambda low, high, page, timeout: shape([t for t in range(high // 1000 - (high % 1000 == 0), low // 1000 - (low % 1000 == 0), -1) for _ in range(per["n"])][:page]))
    options = {"url": "http://x", "token": "k", "until": "1000", "since_seconds": "100"}

    def read(**more):
        reader = rest.Reader(kind, {**options, **more})
        return [r[4] for s in reader.partitions() for r in reader.read(s)]

    assert read() == [str(t) for t in range(999, 899, -1)]
    assert read(limit="35") == [str(t) for t in range(999, 964, -1)] and read(limit="4") == ["999", "998", "997", "996"]
    per["n"] = 11
    with pytest.raises(rest.SourceError, match="more than 10 rows"):
        read()


def test_filters_go_to_the_service():
    host = rest.EqualTo(("hostname",), "h1")
    for kind, want in (("elastic", "h1"), ("splunk", "h1"), ("librenms", "h1"), ("loki", None)):
        reader = rest.Reader(kind, {"url": "http://x"})
        assert list(reader.pushFilters([host])) == [host] and reader.options.get("host") == want


def test_health():
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response({"/ready": 503, "/api/v0": 500}.get(self.path, 200))
            self.end_headers()
            self.wfile.write(b'{"status": "yellow"}')

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    sources = files.Sources()
    for kind in rest.KINDS:
        sources.add(kind, kind, url=f"http://127.0.0.1:{server.server_port}", token="k")
    assert {i: ok for i, (ok, _) in sources.health().items()} == {"elastic": True, "splunk": True, "loki": True, "librenms": False}
    server.shutdown()
    assert not rest.health("splunk", {"url": "http://127.0.0.1:9", "token": "k"})[0] and not rest.health("splunk", {})[0]
    sources.close()
    assert sources.describe() == []


def test_listeners():
    import socket
    import time

    def until(test):
        end = time.time() + 5
        while not test() and time.time() < end:
            time.sleep(0.02)

    udp = syslog.Listener("udp", most=3)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for i in range(5):
            s.sendto(f"line {i}\r\n".encode(), ("127.0.0.1", udp.port))
        s.sendto(b"\n", ("127.0.0.1", udp.port))
    until(lambda: udp.dropped == 2)
    assert udp.drain(2) == ["line 3", "line 4"] and udp.drain() == [] and udp.alive()
    udp.close()
    tcp = syslog.Listener("tcp")
    for text in (b"a\nb\xff\n\nc", b"d\n"):
        with socket.create_connection(("127.0.0.1", tcp.port)) as s:
            s.sendall(text)
    until(lambda: len(tcp.lines) == 4)
    assert tcp.drain() == ["a", "b\ufffd", "c", "d"]
    tcp.close()
    assert not tcp.alive()


def test_stream_reader_of_a_listener_and_a_forwarder():
    import socket
    import threading

    with socket.socket() as probe:
        probe.bind(("127.0.0.1", 0))
        port = probe.getsockname()[1]
    reader = syslog.LineReader({"listen": "udp", "host": "127.0.0.1", "port": str(port)})
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.sendto(b"one", ("127.0.0.1", port))
    rows, end = reader.read(reader.initialOffset())
    assert (list(rows), end) == ([(0, "one")], {"line": 1}) and list(reader.readBetweenOffsets({"line": 0}, end)) == [(0, "one")]
    reader.commit(end)
    assert reader.kept == {}
    reader.listener.close()
    with socket.create_server(("127.0.0.1", 0)) as server:
        threading.Thread(target=lambda: server.accept()[0].sendall(b"x\ny\nrest"), daemon=True).start()
        asked = syslog.LineReader({"host": "127.0.0.1", "port": str(server.getsockname()[1])})
        rows, end = asked.read({"line": 5})
        assert list(rows)[:2] == [(5, "x"), (6, "y")] and end["line"] >= 7


def test_syslog_events_of_a_host(spark):
    lines = spark.createDataFrame([(1, "<11>Jan  1 00:00:00 core-1 app[1]: m"), (2, "Jan  1 00:00:00 edge app: n"), (3, "free")], "seq bigint, line string")
    assert sorted((r["seq"], r["hostname"]) for r in syslog.events(lines, "core").collect()) == [(1, "core-1"), (3, "core")]
    assert syslog.events(lines).count() == 3 and syslog.register(spark) == "log_syslog"


def test_sign_in_and_errors():
    assert rest.credentials({"user": "a", "password": "b"})["Authorization"].startswith("Basic ")
    assert rest.credentials({"cookie": "c=1"}) == {"Cookie": "c=1"}
    for options in ({}, {"user": "a"}):
        with pytest.raises(rest.SourceError):
            rest.credentials(options)
    with pytest.raises(rest.SourceError):
        rest.Reader("loki", {})
    with pytest.raises(rest.SourceError):
        rest.fetch_json("http://127.0.0.1:9/x", {}, None, 1)


def test_formats_are_known(spark):
    assert rest.register(spark) == ["log_elastic", "log_splunk", "log_loki", "log_librenms"]
    assert spark.read.format("log_loki").option("url", "http://127.0.0.1:9").load().columns == ["timestamp", "hostname", "appname", "severity_raw", "message"]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "core-1 (10.0.0.1) -- 2025-01-01.log").write_text("1:02:03.04 § a\nb\n")
    (tmp_path / "sub" / "edge.log").write_text("x\n")
    (tmp_path / "no.txt").write_text("x\n")
    rows = files.read_lines(spark, str(tmp_path)).orderBy("stream", "seq").collect()
    assert [(r["default_host"], r["line"]) for r in rows] == [("core-1", "1:02:03.04 § a"), ("core-1", "b"), ("edge", "x")]
    assert files.read_lines(spark, str(tmp_path), recursive=False, default_host="h").count() == 2
    assert files.count_files(spark, str(tmp_path)) == 2 and files.count_files(spark, str(tmp_path), recursive=False) == 1
    assert {r["default_host"] for r in files.read_lines(spark, str(tmp_path), max_files=1).collect()} == {"core-1"} and files.read_lines(spark, str(tmp_path), "*.none", max_files=1).count() == 0
    with pytest.raises(ValueError, match="not a folder"):
        files.listing(spark, str(tmp_path / "no.txt"))
    assert [(r["seq"], r["line"], r["default_host"]) for r in files.text_lines(spark, "a\r\n\nb", "h").collect()] == [(0, "a", "h"), (1, "", "h"), (2, "b", "h")]


def test_bundle(spark, tmp_path):
    d = tmp_path / "s1"
    d.mkdir()
    (d / "manifest.json").write_text(json.dumps({"site": "s1", "vendor": "Arista EOS", "devices": [{"hostname": "a", "file": "a.txt", "platform": "eos", "function": "sw"}, {"hostname": "b", "file": "b.txt"}, {"hostname": "c", "file": "none.txt"}]}))
    (d / "a.txt").write_text("x\ny\n")
    (d / "b.txt").write_text("z")
    got = sorted((r["hostname"], r["platform"], r["config_text"]) for r in files.site_bundle(spark, str(tmp_path)).collect())
    assert got == [("a", "eos", "x\ny\n"), ("b", "arista", "z")]


def test_sources_from_environment():
    s = files.Sources()
    assert s.from_environment("L_", {"L_A_TYPE": "loki", "L_A_URL": "http://x", "L_A_TOKEN": "k", "L_B_TYPE": "loki", "OTHER": "1"}) == 1
    assert s.describe() == [{"id": "a", "kind": "loki", "url": "http://x"}]
    assert s.remove("a") and not s.remove("a")
