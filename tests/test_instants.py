from datetime import UTC, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from factloom.operators import instants

S = "vid bigint, key string, client_tz string, client_locale string, ts_text string"


def at(*a, tz="UTC"):
    return int(datetime(*a, tzinfo=ZoneInfo(tz)).timestamp())


CASES = [
    ("2023/04/10 (Mon) 17:50", None, None, at(2023, 4, 10, 17, 50)),
    (" 2021-06-19T12:44:09\n", "Asia/Tokyo", None, at(2021, 6, 19, 12, 44, 9, tz="Asia/Tokyo")),
    ("2021-06-19 12:44:09.999", "UTC", None, at(2021, 6, 19, 12, 44, 9)),
    ("2021-06-19T12:44:09+05:30", "Asia/Tokyo", None, at(2021, 6, 19, 7, 14, 9)),
    ("20200623T152850Z", None, None, at(2020, 6, 23, 15, 28, 50)),
    ("1588920524756466", None, None, 1588920524), ("1604483597.632", None, None, 1604483597), ("1595409799178", None, None, 1595409799),
    ("06/07/2020 10:00", "UTC", "en-US", at(2020, 6, 7, 10)), ("06/07/2020 10:00", "UTC", "en-GB", at(2020, 7, 6, 10)), ("06/07/2020 10:00", "UTC", None, at(2020, 7, 6, 10)),
    ("7/29/2019 12:05 AM", "UTC", "en-US", at(2019, 7, 29, 0, 5)), ("7/29/2019 12:05 PM", "UTC", "en-US", at(2019, 7, 29, 12, 5)),
    ("22.03.2020 21:47", "Europe/Berlin", "de-DE", at(2020, 3, 22, 20, 47)), ("18. Dezember 2019, 04:17 Uhr", "Europe/Berlin", "de-DE", at(2019, 12, 18, 3, 17)),
    ("2020年3月14日 19時32分", "Asia/Tokyo", "ja-JP", at(2020, 3, 14, 10, 32)), ("Sat, 07 Sep 2019 09:05:28 +0900", None, None, at(2019, 9, 7, 0, 5, 28)),
    ("2020-08-25 04:22 AEST", "Australia/Sydney", None, at(2020, 8, 24, 18, 22)), ("June 19, 2020 at 8:38 pm", None, None, at(2020, 6, 19, 20, 38)),
    # Clock changes: twice (the earlier instant), never (moved on by the gap).
    ("2023-11-05T01:30:00", "America/New_York", None, at(2023, 11, 5, 5, 30)), ("2023-03-12T02:30:00", "America/New_York", None, at(2023, 3, 12, 7, 30)), ("2021-10-03 02:30:00", "Australia/Sydney", None, at(2021, 10, 2, 16, 30)),
    ("2021-06-19T12:44:09", "No/Where", None, at(2021, 6, 19, 12, 44, 9)),
    # Far years: the last rules go on, every 400 years alike; before standard time there is local mean time.
    ("2160-07-01T12:00:00", "America/New_York", None, at(2160, 7, 1, 16)), ("2160-01-01T12:00:00", "America/New_York", None, at(2160, 1, 1, 17)), ("2101-12-31T23:59:59", "Europe/Berlin", None, at(2101, 12, 31, 22, 59, 59)),
    ("9998-07-01T12:00:00", "Europe/Berlin", None, at(9998, 7, 1, 10)), ("2499-12-31T23:00:00", "America/New_York", None, at(2500, 1, 1, 4)), ("2500-01-01T00:00:00", "America/New_York", None, at(2500, 1, 1, 5)),
    ("1700-05-05T12:00:00", "Europe/Berlin", None, at(1700, 5, 5, 12, tz="Europe/Berlin")), ("1847-11-30T12:00:00", "Europe/London", None, at(1847, 11, 30, 12, tz="Europe/London")),
    ("2023/02/30 (Thu) 10:00", None, None, None), ("2022-13-45", None, None, None), ("25:61", None, None, None), ("unknown", None, None, None), ("", None, None, None), (None, None, None, None), ("0000-00-00 00:00:00", None, None, None), ("2021-06-19 24:10", None, None, None), ("x" * 100_000, None, None, None),
]


def test_sessions(spark):
    df = spark.createDataFrame([(i, f"s{i}", tz, loc, t) for i, (t, tz, loc, _) in enumerate(CASES)], S).withColumns({"local": F.lit("clash"), "zone": F.lit("clash")})
    got = {r.vid: r.epoch_s for r in instants.session_instants(df).collect()}
    assert got == {i: c[3] for i, c in enumerate(CASES)}


def test_matches_tell_ambiguous_and_skipped(spark):
    df = spark.createDataFrame([(1, "a", "America/New_York", None, "2023-11-05T01:30:00"), (2, "b", "America/New_York", None, "2023-03-12T02:30:00"), (3, "c", "America/New_York", None, "2023-06-01T00:00:00")], S)
    assert {r.vid: r.matches for r in instants.session_instants(df).collect()} == {1: 2, 2: 0, 3: 1}


def test_any_year_against_the_zone_rules(spark):
    import random

    r = random.Random(2)
    zones = ["America/New_York", "Europe/London", "Australia/Lord_Howe", "Pacific/Apia", "Africa/Casablanca", "Asia/Kathmandu", "America/St_Johns"]
    rows = [(i, f"s{i}", r.choice(zones), None, f"{r.choice([r.randint(1801, 2120), r.randint(2120, 9000)]):04d}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.randint(0, 23):02d}:{r.randint(0, 59):02d}:00") for i in range(600)]
    got = {x.vid: (x.epoch_s, x.matches) for x in instants.session_instants(spark.createDataFrame(rows, S)).collect()}
    for i, _, z, _, t in rows:
        when = datetime.fromisoformat(t)
        assert got[i][0] == at(*when.timetuple()[:6], tz=z), (t, z)


def test_hints(spark):
    sessions = spark.createDataFrame([(1, "s", "Asia/Tokyo", None, "2023-04-10 00:00:00"), (1, "s", "Asia/Tokyo", None, "2023-04-10 00:00:00"), (2, "bad", None, None, "soon")], S)
    said = at(2023, 4, 9, 15)
    hints = {"2023-04-15": at(2023, 4, 15), "2023/04": at(2023, 4, 1), "3/22/2021": at(2021, 3, 22), "3/22": at(2023, 3, 22), "12/25": at(2022, 12, 25), "4/10": at(2023, 4, 10), "14.05.2016": at(2016, 5, 14), "2019": at(2019, 1, 1), "May 2023": at(2023, 5, 1), "27-Jan-2017": at(2017, 1, 27), "2021-11-04 12:23": at(2021, 11, 4, 3, 23), "1683168058": 1683168058}
    bad = ["", None, "last summer", "13/45", "2023-99-99", "20-20", "0/0/2020", "2021-02-30", "TBD"]
    rows = [(i, "s", h) for i, h in enumerate([*hints, *bad])] + [(900, "bad", "3/22"), (901, None, "3/22"), (902, "bad", "2021-02-03")]
    facts = spark.createDataFrame(rows, "extract_id bigint, session_id string, valid_from_hint string")
    got = {r.record_id: r.epoch_s for r in instants.instants(sessions, facts).where("origin = 'hint'").collect()}
    want = {i: v for i, v in enumerate(hints.values())} | {902: at(2021, 2, 3)}
    assert got == want and said


def test_empty_tables(spark):
    assert instants.instants(spark.createDataFrame([], S), spark.createDataFrame([], "extract_id bigint, session_id string, valid_from_hint string")).count() == 0
