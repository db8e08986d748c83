from datetime import datetime, timezone

import pytest

from ledgerloom.operators.instants import found_instants, normalise_instants

NY, LA, LON, SYD, KTM = "America/New_York", "America/Los_Angeles", "Europe/London", "Australia/Sydney", "Asia/Kathmandu"
CASES = [
    ("2016-01-09T20:29:00Z", None, False, "2016-01-09T20:29:00"),
    ("2016-01-09t20:29:00z", None, False, "2016-01-09T20:29:00"),
    ("2016-01-07T11:39:47−08:00", NY, False, "2016-01-07T19:39:47"),
    ("2016-03-03T00:35:47.447061436-05", NY, False, "2016-03-03T05:35:47.447061"),
    ("2016-01-04 11:03:19,217", NY, False, "2016-01-04T16:03:19.217000"),
    ("2016-W02-2T14:08:12Z", None, False, "2016-01-12T14:08:12"),
    ("2020-W53-5T00:00:00Z", None, False, "2021-01-01T00:00:00"),
    ("2021-W53-1T00:00:00Z", None, False, "bad_date"),
    ("2016-366T04:00:00+00:00", None, False, "2016-12-31T04:00:00"),
    ("2017-366T04:00:00+00:00", None, False, "bad_date"),
    ("20160112T153325Z", None, False, "2016-01-12T15:33:25"),
    ("20160313032042", LON, True, "2016-03-13T03:20:42"),
    ("1453816475", None, False, "2016-01-26T13:54:35"),
    ("1453816475123", None, False, "2016-01-26T13:54:35.123000"),
    ("1453816475123456", None, False, "2016-01-26T13:54:35.123456"),
    ("1453816475123456789", None, False, "2016-01-26T13:54:35.123456"),
    ("2016-01-18 19:57:56 America/Chicago", NY, False, "2016-01-19T01:57:56"),
    ("2016-01-18 19:57:56 america/chicago", NY, False, "2016-01-19T01:57:56"),
    ("2016-01-18 7:57 America/Chicago", NY, False, "2016-01-18T13:57:00"),
    ("January 6, 2016 6:45 pm America/Chicago", NY, False, "2016-01-07T00:45:00"),
    ("2016-01-18 19:57:56 America/Nowhere", NY, False, "unknown_zone"),
    ("2016-02-25T19:52:48-05:00[America/New_York]", LA, False, "2016-02-26T00:52:48"),
    ("2016-01-20 02:37 GMT-6", NY, False, "2016-01-20T08:37:00"),
    ("2016-01-20 02:37 UTC+5:30", NY, False, "2016-01-19T21:07:00"),
    ("Thu, 28 Jan 2016 21:07:03 EST", NY, False, "2016-01-29T02:07:03"),
    ("Thu, 28 Jan 2016 21:07:03 EST", SYD, True, "2016-01-28T11:07:03"),
    ("Sat, 09 Jan 2016 22:40:57 NZDT", "Pacific/Auckland", True, "2016-01-09T09:40:57"),
    ("2016-07-01 10:00 IST", "Asia/Kolkata", True, "2016-07-01T04:30:00"),
    ("2016-07-01 10:00 IST", "Europe/Dublin", True, "2016-07-01T09:00:00"),
    ("March 12, 2017 at 2:08 a.m. ET", NY, False, "skipped"),
    ("November 6, 2016 1:30 AM ET", NY, False, "ambiguous"),
    ("November 6, 2016 1:30 AM EST", NY, False, "2016-11-06T06:30:00"),
    ("FOR IMMEDIATE RELEASE — January 6, 2016 - 6:45 PM", NY, False, "2016-01-06T23:45:00"),
    ("Posted on 26 January 2016 at 9:43 a.m.", LON, True, "2016-01-26T09:43:00"),
    ("January 11, 2016, 12 noon", NY, False, "2016-01-11T17:00:00"),
    ("6 February 2016, noon", LON, True, "2016-02-06T12:00:00"),
    ("30. Oktober 2017, 04:06 Uhr", "Europe/Berlin", True, "2017-10-30T03:06:00"),
    ("Updated 1er août 2017 à 17 h 42", "Europe/Paris", True, "2017-08-01T15:42:00"),
    ("14 de marzo de 2016, 18:41", "Europe/Madrid", True, "2016-03-14T17:41:00"),
    ("03/04/2016 02:11", LON, True, "2016-04-03T01:11:00"),
    ("03/04/2016 02:11", NY, False, "2016-03-04T07:11:00"),
    ("3-4-16  2:11:09 PM", NY, False, "2016-03-04T19:11:09"),
    ("13/04/2016 02:11", NY, False, "bad_date"),
    ("03/04/2016 02:11", NY, None, "day_order"),
    ("13/04/2016 02:11", NY, None, "2016-04-13T06:11:00"),
    (" 2016-04-02T14:03:11Z\n", None, False, "2016-04-02T14:03:11"),
    ("2016-01-19T24:00:00", LON, True, "2016-01-20T00:00:00"),
    ("2016-01-19T24:00:01", LON, True, "bad_time"),
    ("2016-02-30 12:59:24", NY, False, "bad_date"),
    ("1900-02-29 12:00:00Z", NY, False, "bad_date"),
    ("2000-02-29 12:00:00Z", NY, False, "2000-02-29T12:00:00"),
    ("0000-00-00 00:00:00", NY, False, "bad_date"),
    ("2016-01-20 13:05 PM", NY, False, "bad_time"),
    ("2016-01-20 1:05 PM", NY, False, "2016-01-20T18:05:00"),
    ("January 6, 2016 13:45 PM", NY, False, "bad_time"),
    ("2016-01-20 02:37", None, False, "no_zone"),
    ("2016-01-20 02:37", "Not/AZone", False, "no_zone"),
    ("2016-01-20", NY, False, "unparsed"), ("20160120", NY, False, "unparsed"), ("January 2016", NY, False, "unparsed"), ("2016", NY, False, "unparsed"),
    ("TBD", NY, False, "unparsed"), ("", NY, False, "unparsed"), (None, NY, False, "unparsed"), ("9" * 50_000, NY, False, "unparsed"),
    ("2016-05-06 10:00", KTM, True, "2016-05-06T04:15:00"),
]


@pytest.fixture(scope="module")
def outcome(spark):
    rows = [(i, s, z, d) for i, (s, z, d, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "row int, pub_date string, zone_name string, day_first boolean")
    return {r["row"]: r for r in normalise_instants(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_formats(outcome, i):
    want, got = CASES[i][3], outcome[i]
    if want[0].isdigit():
        assert got["instant_status"] == "ok"
        assert got["utc_micros"] == round(datetime.fromisoformat(want).replace(tzinfo=timezone.utc).timestamp() * 1e6)
    else:
        assert (got["instant_status"], got["utc_micros"]) == (want, None)


def test_against_the_standard_library(spark):
    """Every hour of three years round trips, or is refused, as Python's zone rules have it."""
    from datetime import timedelta
    from zoneinfo import ZoneInfo

    rows, want = [], {}
    for zone in (NY, LON, SYD, "America/St_Johns", "America/Phoenix"):
        z, t = ZoneInfo(zone), datetime(2021, 1, 1, 0, 30)
        while t < datetime(2023, 1, 1):
            a, b = (t.replace(tzinfo=z, fold=f).astimezone(timezone.utc) for f in (0, 1))
            fits = {u for u in (a, b) if u.astimezone(z).replace(tzinfo=None) == t}
            key = f"{zone}|{t}"
            want[key] = round(fits.pop().timestamp() * 1e6) if len(fits) == 1 else None
            rows.append((key, t.strftime("%Y-%m-%d %H:%M"), zone, False))
            t += timedelta(hours=1)
    df = spark.createDataFrame(rows, "key string, pub_date string, zone_name string, day_first boolean")
    assert {r["key"]: r["utc_micros"] for r in normalise_instants(df).collect()} == want
    assert sum(v is None for v in want.values()) >= 16


def test_found_handles_repeats_disagreement_and_unknown_feeds(spark):
    feeds = spark.createDataFrame([(1, "f", NY, False, "en")], "feed_id int, feed_name string, zone_name string, day_first boolean, lang string")
    rows = [(1, 1, "2016-01-20 02:37"), (1, 1, "2016-01-20 02:37"), (2, 1, "2016-01-20T02:37:00Z"), (2, 1, "2016-01-20T02:38:00Z"), (3, 9, "2016-01-20 02:37"), (4, 9, "2016-01-20T02:37:00Z"), (None, 1, "2016-01-20T02:37:00Z"), (5, None, None)]
    releases = spark.createDataFrame(rows, "release_id long, feed_id int, pub_date string")
    assert {r["release_id"] for r in found_instants(releases, feeds).collect()} == {1, 4}
    assert found_instants(releases.limit(0), feeds).count() == 0
    assert {r["release_id"] for r in found_instants(releases, feeds.limit(0)).collect()} == {4}


def test_clashing_column_names_pass_through(spark):
    df = spark.createDataFrame([("2016-01-20T02:37:00Z", None, None, 7, "x", 3)], "pub_date string, zone_name string, day_first boolean, z int, zone string, day int")
    row = normalise_instants(df).first()
    assert (row["z"], row["zone"], row["day"], row["instant_status"]) == (7, "x", 3, "ok")
