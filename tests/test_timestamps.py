"""Printed timestamps against a plain reading with zoneinfo, and the edge cases."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from logloom.functions.hosts import host_zones
from logloom.operators import timestamps

UTC = timezone.utc
SEEN = datetime(2025, 10, 26, 12, 0, tzinfo=UTC)


@pytest.fixture(scope="module")
def zones(spark):
    inventory = spark.createDataFrame([("fra1-a", "fra1", None), ("nyc1-a", "nyc1", None), ("fra1-u", "fra1", "UTC"), ("bad1-a", "bad1", "No/Zone")], "hostname string, site_id string, tz_name string")
    sites = spark.createDataFrame([("fra1", "Europe/Berlin"), ("nyc1", "America/New_York"), ("bad1", None)], "site_id string, tz_name string")
    return host_zones(inventory, sites)


def us(*args, **kw):
    return int(datetime(*args, tzinfo=UTC, **kw).timestamp()) * 1_000_000


def read(spark, zones, rows, **kw):
    df = spark.createDataFrame([(i, t, h, s or SEEN) for i, (t, h, s) in enumerate(rows)], "row_id bigint, stamp string, hostname string, seen timestamp")
    out = timestamps.normalize(df, zones, timestamps.fit_mixture(df, zones, kw.get("slash_order", "mdy")), **kw)
    return {r["row_id"]: r for r in out.collect()}


CASES = [
    ("2025-10-24T08:17:10.7435119-07:00", "fra1-a", us(2025, 10, 24, 15, 17, 10) + 743511),
    ("2025-10-24 08:17:10,5", "FRA1-A.net.example ", us(2025, 10, 24, 6, 17, 10) + 500000),
    ("2025-10-24 08:17", "fra1-a", us(2025, 10, 24, 6, 17)),
    ("2025-10-24T08:17:10", "fra1-u", us(2025, 10, 24, 8, 17, 10)),
    ("2025-10-24T08:17:10Z", "", us(2025, 10, 24, 8, 17, 10)),
    (" 20251024T081710+0530 ", None, us(2025, 10, 24, 2, 47, 10)),
    ("Oct 24 08:17:10", "nyc1-a", us(2025, 10, 24, 12, 17, 10)),
    ("Nov  4 08:17:10", "nyc1-a", us(2024, 11, 4, 13, 17, 10)),
    ("*Oct 24 08:17:10.250 EDT", "nyc1-a", us(2025, 10, 24, 12, 17, 10) + 250000),
    ("Oct 24 2025 08:17:10 CEST", "fra1-a", us(2025, 10, 24, 6, 17, 10)),
    ("Jan 4 2025 08:17:10 CET", "fra1-a", us(2025, 1, 4, 7, 17, 10)),
    ("Oct 24 2025 08:17:10 EDT", "fra1-a", None),
    ("10/24/2025 12:00:01 AM", "nyc1-a", us(2025, 10, 24, 4, 0, 1)),
    ("10/24/2025 12:00:01 PM", "nyc1-a", us(2025, 10, 24, 16, 0, 1)),
    ("24-Oct-2025 08:17:10.001", "fra1-a", us(2025, 10, 24, 6, 17, 10) + 1000),
    ("24/Oct/2025:08:17:10 -0400", "x", us(2025, 10, 24, 12, 17, 10)),
    ("Fri, 24 Oct 2025 08:17:10 +0200", "x", us(2025, 10, 24, 6, 17, 10)),
    ("11:59:59.50", "fra1-u", us(2025, 10, 26, 11, 59, 59) + 500000),
    ("12:00:00.50", "fra1-u", us(2025, 10, 25, 12, 0, 0) + 500000),
    ("Feb 29 10:00:00", "fra1-u", us(2024, 2, 29, 10)),
    ("Feb 30 10:00:00", "fra1-u", None),
    ("2025-13-41T00:00:00Z", "fra1-u", None),
    ("2025/10/24 25:61:00", "fra1-u", None),
    ("2025-10-24 08:17:10", "bad1-a", None),
    ("2025-10-24 08:17:10", None, None),
    ("n/a", "fra1-a", None),
    ("", "fra1-a", None),
    (None, "fra1-a", None),
    # In the hour that comes twice the latest reading that isn't after arrival is meant.
    ("2025-10-26 02:30:00", "fra1-a", us(2025, 10, 26, 1, 30)),
    # An hour that is skipped is read with the offset before the change.
    ("2025-03-30 02:30:00", "fra1-a", us(2025, 3, 30, 1, 30)),
]


def test_forms(spark, zones):
    got = read(spark, zones, [(t, h, None) for t, h, _ in CASES])
    assert {CASES[i][:2]: r["utc_us"] for i, r in got.items()} == {c[:2]: c[2] for c in CASES}
    assert all((r["status"] == "none") == (r["utc_us"] is None) for r in got.values())


def test_twice_before_arrival(spark, zones):
    seen = datetime(2025, 10, 26, 0, 45, tzinfo=UTC)
    got = read(spark, zones, [("2025-10-26 02:30:00", "fra1-a", seen)])
    assert got[0]["utc_us"] == us(2025, 10, 26, 0, 30)


def test_local_readings_equal_zoneinfo(spark, zones):
    zone, at, rows, want = ZoneInfo("Europe/Berlin"), datetime(2025, 3, 29, 22, 0), [], []
    for k in range(0, 300):
        local = at + timedelta(minutes=11 * k)
        rows.append((local.strftime("%Y/%m/%d %H:%M:%S"), "fra1-a", SEEN))
        want.append(int(local.replace(tzinfo=zone, fold=0).timestamp()) * 1_000_000)
    got = read(spark, zones, rows)
    assert [got[i]["utc_us"] for i in range(len(rows))] == want


def test_units_of_digits(spark, zones):
    t = SEEN.timestamp() - 5
    rows = [(str(int(t * 10**k)), "fra1-a", None) for k in (0, 3, 6, 9)] * 5 + [(f"{int(t)}.25", "nyc1-a", None)]
    got = read(spark, zones, rows)
    assert {r["utc_us"] // 1_000_000 for r in got.values()} == {int(t)} and {r["status"] for r in got.values()} == {"ok"}
    assert got[20]["utc_us"] % 1_000_000 == 250_000


def test_finer_digits_are_cut_off(spark, zones):
    """Nineteen digits are more than a double holds."""
    ns = [1761708937058320025, 1761708937058319999, 1761708937000000999, 1761453595999999999]
    rows = [(str(n), "fra1-a", datetime.fromtimestamp(n // 10**9 + 3, UTC)) for n in ns] + [("1761453595123.4567", "fra1-a", SEEN)]
    got = read(spark, zones, rows)
    assert [got[i]["utc_us"] for i in range(5)] == [n // 1000 for n in ns] + [1761453595123456]


def test_slash_order_by_mixture(spark, zones):
    """A source that prints days first shows it with days over 12; a source with nothing to tell by stays ambiguous."""
    seen = datetime(2025, 10, 11, 12, 0, tzinfo=UTC)
    rows = [("10/10/2025 11:59:00", "fra1-u", seen)] + [(f"11/10/2025 11:{m}:00", "fra1-u", seen) for m in range(40, 60)] + [("05/04/2025 10:00:00", "nyc1-a", seen)]
    got = read(spark, zones, rows, slash_order="em")
    assert got[5]["utc_us"] == us(2025, 10, 11, 11, 44) and got[5]["fmt"] == "dmy_slash"
    assert got[21]["status"] == "ambiguous" and got[21]["utc_us"] is not None


def test_empty_and_extra_columns(spark, zones):
    df = spark.createDataFrame([], "row_id bigint, stamp string, hostname string, seen timestamp, utc_us string, source int")
    assert timestamps.normalize(df, zones, timestamps.fit_mixture(df)).collect() == []
    df = spark.createDataFrame([(1, "2025-10-24T08:17:10Z", "a", SEEN, "x", 3)] * 2, df.schema)
    assert [r["utc_us"] for r in timestamps.normalize(df, zones, timestamps.fit_mixture(df)).collect()] == [us(2025, 10, 24, 8, 17, 10)] * 2
