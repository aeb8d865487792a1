"""The rules on small literal tables."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import business_days, scalars, schedules
from tidewatch.operators import (
    calls,
    catalogue,
    costs,
    dependencies,
    files,
    maintenance,
    reliability,
    runs,
    state,
    tables,
)
from tidewatch.sources import polled, reports, table_logs

START = dt.datetime(2026, 9, 1)


def hour(n):
    return START + dt.timedelta(hours=n)


def ts(moment):
    return F.lit(moment).cast("timestamp")


def one(frame):
    return frame.collect()[0]


def value(spark, column):
    return spark.range(1).select(column).first()[0]


# scalars


@pytest.mark.parametrize(
    ("number", "text"),
    [(1204331.0, "1,204,331"), (-4200.0, "-4,200"), (2.5, "2.50"), (1e15, "1000000000000000.00")],
)
def test_readable(spark, number, text):
    assert value(spark, scalars.readable(F.lit(number))) == text


@pytest.mark.parametrize(
    ("name", "slug"),
    [
        ("Nightly ERP Load (v2)", "nightly-erp-load-v2"),
        ("  pgdelta // day  ", "pgdelta-day"),
        ("Ölspår Päivittäinen", "olspar-paivittainen"),
        ("***", ""),
    ],
)
def test_slug(spark, name, slug):
    assert value(spark, scalars.plain_slug(F.lit(name))) == slug


@pytest.mark.parametrize(
    ("pattern", "name", "hit"),
    [
        ("*.xml", "a.xml", True),
        ("*.xml", "aXxml", False),
        ("bank-*", "bank-", True),
        ("a?c", "abc", True),
        ("a?c", "ac", False),
        ("[!a]b", "bb", True),
        ("[!a]b", "ab", False),
        ("a_c%", "abcd", False),
        ("a(b)|c", "a(b)|c", True),
        ("[*]x", "*x", True),
        ("[*]x", "ax", False),
        ("[?]", "?", True),
        ("[?]", "a", False),
        ("[abc", "[abc", False),
        ("[]", "[]", False),
        ("[]]", "]", True),
        ("[!]]x", "ax", True),
        ("a[d-b]e", "ace", False),
        ("[!d-b]", "c", True),
        ("[^a]", "^", True),
        ("[a-]", "-", True),
        ("[a&&b]", "&", True),
        ("**/x", "a/b/x", True),
        ("**/x", "x", True),
        ("**/x", "bx", False),
        ("a/**/c", "a/c", True),
        ("a**b", "axb", False),
        ("***", "x", False),
        ("å[åä]?", "åä😀", True),
        ("a\\b*", "a\\b\nc", True),
    ],
)
def test_glob(spark, pattern, name, hit):
    assert value(spark, scalars.glob_match(F.lit(name), F.lit(pattern))) is hit


@pytest.mark.parametrize(
    ("text", "seconds"),
    [("90s", 90), ("15m", 900), ("1h 30m", 5400), ("2days", 172800), ("5", None), ("3 apples", None),
     ("1h30m", 5400), ("1M", 2630016), ("2 years", 63115200), ("1500ms", 1), ("600ms 400 ms 5us", 1), ("2wk", 1209600),
     ("1m 1M", 2630076), ("99999999999999999999s", None), ("9000000000000000000y", None), ("", None)],
)
def test_durations(spark, text, seconds):
    assert value(spark, scalars.duration_seconds(F.lit(text))) == seconds


def test_upper_median(spark):
    middle = lambda *v: value(spark, scalars.upper_median(F.array(*map(F.lit, v))))
    assert middle(1.0, 2.0, 3.0, 4.0) == 3.0
    assert middle(5.0, 1.0, 3.0) == 3.0


def test_summer_label(spark):
    label = scalars.local_label(ts("2026-09-25 05:30:00"), "Europe/Stockholm")
    assert value(spark, label) == "fri 25 sep 07:30 cest"


# holidays and schedules


def test_easter(spark):
    years = spark.createDataFrame([(2025,), (2026,), (2027,)], "year long")
    found = [str(r.easter) for r in business_days.with_easter(years).orderBy("year").collect()]
    assert found == ["2025-04-20", "2026-04-05", "2027-03-28"]


def test_easter_for_four_centuries(spark):
    dateutil = pytest.importorskip("dateutil.easter")
    years = spark.range(1700, 2200).select(F.col("id").alias("year"))
    for row in business_days.with_easter(years).collect():
        assert row.easter == dateutil.easter(row.year)


def test_holidays_of_two_countries(spark):
    days = {(r.country, r.date.month, r.date.day) for r in business_days.holidays(spark, 2026, 2026).collect()}
    both = [(1, 6), (4, 3), (4, 6), (5, 1), (5, 14), (6, 19), (6, 20), (10, 31), (12, 24), (12, 26)]
    for country in ("se", "fi"):
        assert all((country, *d) in days for d in both)
    assert ("se", 6, 6) in days and ("fi", 6, 6) not in days
    assert ("fi", 12, 6) in days and ("se", 12, 6) not in days
    assert ("se", 12, 31) in days and ("fi", 12, 31) not in days


def due(spark, cron, style, zone, calendar, as_of, grace=1800):
    plan = spark.createDataFrame(
        [("s", cron, style, zone, calendar, grace)],
        "schedule_id string, cron string, cron_style string, timezone string, "
        "calendar array<string>, grace_seconds long",
    )
    return one(schedules.around(plan, as_of))


def missed(row, last_ok, grace=1800):
    return last_ok <= row.previous_at + dt.timedelta(seconds=grace)


def test_business_day_schedule(spark):
    check = lambda now: due(spark, "0 7 * * 1-5", "unix", "Europe/Stockholm", ["se"], now)
    friday = check("2026-09-25 07:00:00")
    assert friday.due_at == dt.datetime(2026, 9, 25, 5, 0)
    assert not missed(friday, dt.datetime(2026, 9, 25, 4, 40))
    assert missed(friday, dt.datetime(2026, 9, 24, 4, 40))
    # a weekend is not late
    assert not missed(check("2026-09-27 10:00:00"), dt.datetime(2026, 9, 25, 4, 40))
    # midsummer's eve 2026 is Friday 19 June
    thursday = dt.datetime(2026, 6, 18, 4, 50)
    assert not missed(check("2026-06-19 10:00:00"), thursday)
    monday = check("2026-06-22 06:00:00")
    assert missed(monday, thursday) and monday.next_at == dt.datetime(2026, 6, 23, 5, 0)


def test_quartz_schedules(spark):
    nightly = lambda now: due(spark, "0 0 2 * * ?", "quartz", "Europe/Stockholm", [], now)
    ran = dt.datetime(2026, 9, 25, 0, 20)
    assert not missed(nightly("2026-09-25 10:00:00"), ran)
    assert missed(nightly("2026-09-26 01:00:00"), ran)
    # Sunday is 1, so 2-6 is Monday to Friday
    weekdays = due(spark, "0 30 6 ? * 2-6", "quartz", "Europe/Helsinki", [], "2026-09-26 09:00:00")
    assert not missed(weekdays, dt.datetime(2026, 9, 25, 3, 45))
    named = due(spark, "0 30 6 ? * MON-FRI", "quartz", "Europe/Helsinki", [], "2026-09-26 09:00:00")
    assert named == weekdays


def test_every_minute_and_month_end(spark):
    often = due(spark, "*/5 * * * *", "unix", "UTC", [], "2026-03-01 00:02:00", grace=0)
    assert (often.due_at, often.previous_at, often.next_at) == (
        dt.datetime(2026, 3, 1, 0, 0),
        dt.datetime(2026, 2, 28, 23, 55),
        dt.datetime(2026, 3, 1, 0, 5),
    )
    rare = due(spark, "0 0 29 2 *", "unix", "UTC", [], "2028-03-10 00:00:00", grace=0)
    assert rare.due_at == dt.datetime(2028, 2, 29)


def test_schedules_rarer_than_a_year(spark):
    at = lambda cron, now, style="unix", calendar=(): due(spark, cron, style, "UTC", list(calendar), now)
    yearly = at("0 7 4 2 *", "2026-02-01 00:00:00")
    assert (yearly.due_at.year, yearly.previous_at.year, yearly.next_at.year) == (2025, 2024, 2026)
    leap = at("0 7 29 2 *", "2026-02-01 00:00:00")
    assert (leap.due_at.year, leap.previous_at.year, leap.next_at.year) == (2024, 2020, 2028)
    workday = at("0 7 29 2 *", "2026-02-01 00:00:00", calendar=["se"])
    assert (workday.due_at.year, workday.previous_at.year, workday.next_at.year) == (2024, 2016, 2028)
    assert at("0 7 25 12 *", "2026-02-01 00:00:00", calendar=["se"]).error == schedules.NO_BUSINESS_DAY
    once = at("0 0 7 1 1 ? 2030", "2026-02-01 00:00:00", "quartz")
    assert (once.due_at, once.next_at, once.error) == (None, dt.datetime(2030, 1, 1, 7), None)


def test_days_named_by_rule(spark):
    day = lambda cron, style="quartz": due(spark, cron, style, "UTC", [], "2026-06-30 23:00:00").due_at.date()
    assert day("0 0 7 L * ?") == dt.date(2026, 6, 30)
    assert day("0 0 7 LW 5 ?") == dt.date(2026, 5, 29)
    assert day("0 0 7 1W 8 ?") == dt.date(2025, 8, 1)
    assert day("0 0 7 1W 2 ?") == dt.date(2026, 2, 2)
    assert day("0 0 7 31W 5 ?") == dt.date(2026, 5, 29)
    assert day("0 0 7 ? 6 6#1") == day("0 7 * 6 fri#1", "unix") == dt.date(2026, 6, 5)
    assert day("0 0 7 ? 6 1L") == day("0 7 * 6 0L", "unix") == day("0 7 * 6 7L", "unix") == dt.date(2026, 6, 28)
    assert day("5 0 7 * 6 *", "unix") == dt.date(2026, 6, 30)


def test_what_a_cron_may_not_say(spark):
    for cron in ("61 * * * *", "0 7 * *", "0 7 32W * *", "0 7 1,x * *", "0 7 L,x * *", "0 7 * * 5-1", "0 7 30 2 *", "0 0 7 1 1 ? 1960", "a * * * *", "*/0 * * * *"):
        assert due(spark, cron, "unix", "UTC", [], "2026-03-01 00:00:00").error is not None


def test_either_day_field_matches(spark):
    plan = spark.createDataFrame(
        [("s", "0 0 13 * fri", "unix", "UTC", [])],
        "schedule_id string, cron string, cron_style string, timezone string, calendar array<string>",
    )
    days = {r.due_at.day for r in schedules.deadlines(plan, "2026-09-01", "2026-09-30").collect()}
    assert days == {4, 11, 13, 18, 25}


def test_maintenance_window(spark):
    windows = spark.createDataFrame(
        [("patching", "0 2 * * 0", "unix", "Europe/Stockholm", 7200, ["bank-*"])],
        "name string, cron string, cron_style string, timezone string, lasts_seconds long, patterns array<string>",
    )
    at = lambda now: one(schedules.open_windows(windows, now))
    assert not at("2026-09-26 23:59:00").is_open
    inside = at("2026-09-27 01:30:00")
    assert inside.is_open and inside.closes_at == dt.datetime(2026, 9, 27, 2, 0)
    after = at("2026-09-27 02:00:00")
    assert not after.is_open and after.next_opening == dt.datetime(2026, 10, 4, 0, 0)
    statuses = spark.createDataFrame(
        [("bank-1", "failed", "x"), ("bank-2", "ok", "y"), ("other", "late", "z")],
        "flow string, state string, detail string",
    )
    done = maintenance.overlaid(
        statuses, schedules.open_windows(windows, "2026-09-27 01:30:00"), "Europe/Stockholm"
    )
    assert {tuple(r) for r in done.collect()} == {
        ("bank-1", "maintenance", "maintenance patching until sun 04:00; x"),
        ("bank-2", "ok", "y"),
        ("other", "late", "z"),
    }


# reliability


def changes(spark, *rows):
    made = [("f", hour(h), i, s) for i, (h, s) in enumerate(rows)]
    return spark.createDataFrame(made, "flow string, at timestamp, id long, state string")


def summary(spark, until, *rows):
    end = ts(hour(until))
    return one(reliability.summaries(reliability.intervals(changes(spark, *rows), end), end))


def test_uptime_outages_and_recovery(spark):
    got = summary(spark, 24, (0, "pending"), (2, "ok"), (12, "late"), (14, "ok"), (20, "failed"))
    assert got.uptime == 16 / 22
    assert (got.incidents, got.longest_outage_seconds, got.mean_recovery_seconds) == (2, 14400, 7200)


def test_maintenance_is_not_held_against_uptime(spark):
    assert summary(spark, 24, (0, "ok"), (20, "maintenance")).uptime == 1.0


def test_nothing_measured_before_the_first_report(spark):
    got = summary(spark, 5, (0, "pending"))
    assert (got.uptime, got.incidents) == (None, 0)


def test_an_outage_spans_maintenance(spark):
    got = summary(spark, 10, (0, "failed"), (2, "maintenance"), (4, "late"), (6, "ok"))
    assert (got.incidents, got.longest_outage_seconds) == (1, 6 * 3600)
    assert got.uptime == 4 / 8


def test_days_of_a_period(spark):
    until = ts(hour(72))
    rows = reliability.intervals(changes(spark, (0, "ok"), (30, "late"), (42, "ok")), until)
    daily = reliability.daily_uptime(rows, "UTC")
    got = one(reliability.daily_array(daily, ts(hour(0)), ts(hour(96)), "UTC"))
    assert got.days == [1.0, 0.5, 1.0, None]


def test_a_day_of_23_hours(spark):
    start = dt.datetime(2026, 3, 28, 23)
    made = spark.createDataFrame(
        [("f", start, 1, "ok"), ("f", start + dt.timedelta(hours=11, minutes=30), 2, "late")],
        "flow string, at timestamp, id long, state string",
    )
    rows = reliability.intervals(made, ts(dt.datetime(2026, 3, 30, 22)))
    got = {str(r.day): r.uptime for r in reliability.daily_uptime(rows, "Europe/Stockholm").collect()}
    assert got == {"2026-03-29": 0.5, "2026-03-30": 0.0}


# anomalies and spikes

USUAL = [1000.0, 1100.0, 950.0, 1020.0, 990.0, 1050.0]


@pytest.mark.parametrize(
    ("history", "last", "text"),
    [
        (USUAL, 400.0, "rows 400 is unusual, usually about 1,020"),
        (USUAL, 2500.0, "rows 2,500 is unusual, usually about 1,020"),
        (USUAL, 700.0, None),
        (USUAL, 1900.0, None),
        (USUAL[:4], 1.0, None),
    ],
)
def test_unusual_runs(spark, history, last, text):
    made = [(i, "f", hour(i), "ok", {"rows": v}) for i, v in enumerate([*history, last])]
    events = spark.createDataFrame(
        made, "id long, flow string, at timestamp, outcome string, metrics map<string,double>"
    )
    tolerance = spark.createDataFrame([("f", 0.5)], "flow string, tolerance double")
    assert one(runs.latest_anomaly(events, tolerance)).anomaly == text
    found = runs.run_anomalies(events, tolerance).where(F.col("id") == len(history)).collect()
    assert [r.anomaly for r in found] == ([text] if text else [])


@pytest.mark.parametrize(
    ("days", "yesterday", "usual"),
    [
        ([10.0, 12.0, 11.0, 9.0, 10.5, 11.5], 40.0, 11.0),
        ([10.0, 12.0, 11.0, 9.0, 10.5, 11.5], 20.0, None),
        ([10.0, 12.0, 11.0, 9.0, 10.5, 11.5], 2.0, None),
        ([10.0, 10.0], 100.0, None),
        ([0.2] * 5, 0.9, None),
    ],
)
def test_cost_spikes(spark, days, yesterday, usual):
    first = dt.date(2026, 9, 1)
    made = [(1, first + dt.timedelta(days=i), c, "USD") for i, c in enumerate([*days, yesterday])]
    frame = spark.createDataFrame(made, "job_id long, day date, cost double, currency string")
    last = first + dt.timedelta(days=len(days))
    got = costs.cost_spikes(frame).where(F.col("day") == F.lit(last)).collect()
    assert [r.usual for r in got] == ([usual] if usual else [])


# runs


def test_pairs_of_runs(spark):
    made = [
        (1, "f", hour(0), "start", "started", None),
        (2, "f", hour(1), "start", "started", None),
        (3, "f", hour(2), "ok", "exit 0", {"rows": 1.0, "seconds": 5.0}),
        (4, "f", hour(3), "fail", "exited with code 1", None),
        (5, "f", hour(4), "start", "started", None),
    ]
    events = spark.createDataFrame(
        made,
        "id long, flow string, at timestamp, outcome string, detail string, metrics map<string,double>",
    )
    marks = {r.start: (r.end, r.outcome, r.millis) for r in runs.run_marks(events).collect()}
    assert marks == {
        hour(0): (None, "unfinished", None),
        hour(1): (hour(2), "ok", 3600000),
        hour(3): (hour(3), "fail", 0),
        hour(4): (None, "running", None),
    }
    timed = {r.id: r.metrics for r in runs.with_seconds(events).collect()}
    assert timed[3] == {"rows": 1.0, "seconds": 3600.0} and timed[4] is None


# state


def judged(spark, **given):
    base = {
        "flow": "f", "kind": "heartbeat", "cron": None, "every_seconds": 3600,
        "grace_seconds": 600, "max_runtime_s": 7200, "max_error_rate": 0.05, "timezone": None,
        "last_ok": hour(9), "running_since": None, "problem": None, "check_warning": None,
        "anomaly": None, "cost_warning": None, "ok": 0, "client_errors": 0, "server_errors": 0,
        "due_at": None, "previous_at": None, "next_at": None, "error": None,
    }
    base.update(given)
    schema = (
        "flow string, kind string, cron string, every_seconds long, grace_seconds long, "
        "max_runtime_s long, max_error_rate double, timezone string, last_ok timestamp, "
        "running_since timestamp, problem string, check_warning string, anomaly string, "
        "cost_warning string, ok long, client_errors long, server_errors long, due_at timestamp, "
        "previous_at timestamp, next_at timestamp, error string"
    )
    rows = spark.createDataFrame([tuple(base.values())], schema)
    got = one(state.judged(rows, str(hour(10)), "Europe/Stockholm"))
    return got.state, got.detail


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ({}, ("ok", "last ok 1h ago")),
        ({"problem": "boom", "last_ok": None}, ("failed", "boom")),
        ({"running_since": hour(7)}, ("failed", "still running after 3h")),
        ({"running_since": hour(8)}, ("ok", "last ok 1h ago")),
        (
            {"kind": "inbound", "ok": 8, "server_errors": 2},
            ("failed", "20% server errors in the last hour"),
        ),
        ({"kind": "inbound", "ok": 7, "server_errors": 2}, ("ok", "last ok 1h ago")),
        ({"last_ok": None}, ("pending", "no data yet")),
        ({"last_ok": hour(8)}, ("late", "nothing for 2h, expected every 1h")),
        (
            {"check_warning": "a", "cost_warning": "c"},
            ("warning", "a; c"),
        ),
        (
            {"cron": "x", "due_at": hour(9), "previous_at": hour(8), "next_at": hour(11), "last_ok": hour(8)},
            ("late", "was due by tue 01 sep 11:10 cest"),
        ),
        (
            {"cron": "x", "due_at": hour(9), "previous_at": hour(8), "next_at": hour(11)},
            ("ok", "last ok 1h ago, next due tue 01 sep 13:10 cest"),
        ),
        ({"cron": "x", "error": "cron \"x\""}, ("late", 'schedule: cron "x"')),
    ],
)
def test_first_rule_wins(spark, given, wanted):
    assert judged(spark, **given) == wanted


def test_blocking(spark):
    flows = spark.createDataFrame(
        [
            ("gcs", "failed", "", []),
            ("adls", "late", "", ["gcs"]),
            ("load", "pending", "", ["adls"]),
            ("report", "failed", "own", ["adls"]),
            ("last", "pending", "", ["nobody", "load"]),
            ("free", "pending", "none", ["nobody"]),
        ],
        "flow string, state string, detail string, after array<string>",
    )
    got = {r.flow: (r.state, r.detail) for r in dependencies.blocked(flows).collect()}
    assert got == {
        "gcs": ("failed", ""),
        "adls": ("blocked", "waiting on gcs (failed)"),
        "load": ("blocked", "waiting on adls (blocked)"),
        "report": ("failed", "own"),
        "last": ("blocked", "waiting on load (blocked)"),
        "free": ("pending", "none"),
    }


def test_circles(spark):
    graph = lambda *rows: spark.createDataFrame(list(rows), "flow string, after array<string>")
    chain = graph(("a", []), ("b", ["a"]), ("c", ["b"]))
    ring = graph(("a", ["c"]), ("b", ["a"]), ("c", ["b"]), ("d", []))
    assert one(dependencies.cycle_report(chain)).flow is None
    assert one(dependencies.cycle_report(ring)).flow == "a"
    wanted = graph(("a", ["c"]), ("d", ["c"]))
    assert [r.flow for r in dependencies.circling(wanted, chain).collect()] == ["a"]
    got = {(r.component, r.step, r.flow) for r in dependencies.layout(chain).collect()}
    assert got == {("a", 0, "a"), ("a", 1, "b"), ("a", 2, "c")}


# files


def polls(spark, baseline, pickup, *listings):
    rows, seen = [], []
    for minute, found in listings:
        at = START + dt.timedelta(minutes=minute)
        seen.append(("f", at))
        rows += [("f", at, n, n, s, START + dt.timedelta(minutes=m)) for n, s, m in found]
    listing = spark.createDataFrame(
        rows, "flow string, poll_at timestamp, key string, name string, size long, modified timestamp"
    )
    times = spark.createDataFrame(seen, "flow string, poll_at timestamp")
    rules = spark.createDataFrame(
        [("f", "*.xml", pickup, baseline)],
        "flow string, pattern string, pickup_seconds long, baseline boolean",
    )
    got = files.observations(listing, times, rules)
    minute = lambda at: (at - START).total_seconds() / 60
    arrived = sorted(
        (minute(r.poll_at), minute(r.at), r.detail, r.bytes) for r in files.arrivals(got).collect()
    )
    problems = sorted((minute(r.poll_at), r.problem) for r in files.poll_problems(got).collect())
    return arrived, problems


A = "a.xml"


@pytest.mark.parametrize(
    ("baseline", "pickup", "listings", "arrived", "problems"),
    [
        (False, None, [(0, [(A, 100, 0)]), (5, [(A, 100, 0)]), (10, [(A, 100, 0)])], [(5, 0, A, 100.0)], []),
        (
            False, None,
            [(0, [(A, 0, 0)]), (5, [(A, 4000, 4)]), (10, [(A, 9000, 9)]), (15, [(A, 9000, 9)])],
            [(15, 0, A, 9000.0)], [],
        ),
        (False, None, [(0, [(A, 100, -43200)]), (5, [(A, 100, -43200)])], [(5, 0, A, 100.0)], []),
        (
            False, None,
            [(0, [(A, 100, 0)]), (5, [(A, 100, 0)]), (10, [(A, 250, 9)]), (15, [(A, 250, 9)])],
            [(5, 0, A, 100.0), (15, 0, A, 250.0)], [],
        ),
        (False, None, [(0, [(A, 0, 0)]), (5, [(A, 0, 0)])], [], [(5, "empty file: a.xml")]),
        (
            False, 3600,
            [(0, [(A, 100, -1440)]), (30, [(A, 100, -1440)]), (61, [(A, 100, -1440)])],
            [(30, 0, A, 100.0)], [(61, "not collected after 1h: a.xml")],
        ),
        (
            True, None,
            [
                (0, [("old.xml", 100, -100)]),
                (5, [("old.xml", 100, -100), ("new.xml", 50, 4)]),
                (10, [("old.xml", 100, -100), ("new.xml", 50, 4)]),
            ],
            [(10, 5, "new.xml", 50.0)], [],
        ),
        (True, None, [(0, [("broken.xml", 0, -100)])], [], [(0, "empty file: broken.xml")]),
        (False, None, [(0, [("a.csv", 100, 0), (A, 100, 0)]), (5, [("a.csv", 100, 0), (A, 100, 0)])], [(5, 0, A, 100.0)], []),
        # a poll that saw nothing forgets the file
        (False, None, [(0, [(A, 9, 0)]), (5, [(A, 9, 0)]), (10, []), (15, [(A, 9, 0)]), (20, [(A, 9, 0)])],
         [(5, 0, A, 9.0), (20, 15, A, 9.0)], []),
    ],
)
def test_file_arrivals(spark, baseline, pickup, listings, arrived, problems):
    assert polls(spark, baseline, pickup, *listings) == (arrived, problems)


# tables


def test_schema_change(spark):
    before = ["id:long", "amount:decimal(10,2)", "legacy:string"]
    after = ["id:long", "amount:decimal(12,2)", "email_verified:boolean"]
    text = lambda a, b: value(
        spark, tables.schema_change(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))
    )
    assert text(before, after) == "+email_verified, -legacy, amount decimal(10,2) to decimal(12,2)"
    assert text(before, before[::-1]) is None


def test_left_out_tables(spark):
    now = hour(100)
    made = [
        ("f", "public/orders", 3, now - dt.timedelta(hours=1), 10, 2, 5),
        ("f", "public/users", 4, now - dt.timedelta(hours=1), 5, 2, 5),
        ("f", "public/old", 9, now - dt.timedelta(hours=30), 1, 2, 5),
        ("g", "", 7, now, None, 1, 5),
    ]
    frame = spark.createDataFrame(
        made,
        "flow string, table_name string, version long, committed_at timestamp, rows long, files long, bytes long",
    )
    assert {tuple(r) for r in tables.left_out(frame).collect()} == {
        ("f", "not in the latest load: public/old")
    }
    loads = tables.load_summary(frame).withColumn("metrics", tables.load_metrics())
    got = {r.flow: (r.detail, r.metrics) for r in loads.collect()}
    assert got["f"] == (
        "3 tables, newest public/users at version 4",
        {"files": 6.0, "bytes": 15.0, "rows": 16.0, "tables": 3.0},
    )
    assert got["g"] == ("version 7", {"files": 1.0, "bytes": 5.0})


def write_log(folder, *commits):
    log = folder / "_delta_log"
    log.mkdir(parents=True)
    for version, lines in enumerate(commits):
        (log / f"{version:020d}.json").write_text("\n".join(lines))


def test_table_logs_on_disk(spark, tmp_path):
    schema = (
        '{"metaData":{"schemaString":"{\\"type\\":\\"struct\\",\\"fields\\":['
        '{\\"name\\":\\"id\\",\\"type\\":\\"long\\"},{\\"name\\":\\"name\\",\\"type\\":\\"string\\"}]}"}}'
    )
    add = lambda path, rows: (
        f'{{"add":{{"path":"{path}","size":10,"stats":"{{\\"numRecords\\":{rows}}}"}}}}'
    )
    root = tmp_path / "pg"
    write_log(root / "public" / "users", [schema, add("a", 3)])
    write_log(
        root / "public" / "orders",
        [schema, add("a", 1), add("b", 1)],
        ['{"remove":{"path":"a"}}', add("c", 1)],
    )
    # not a table of its own
    write_log(root / "public" / "orders" / "inner", [schema, add("x", 1)])
    found = table_logs.read_inventory(spark, str(root))
    got = {r.table_name: r for r in found.collect()}
    assert sorted(got) == ["public/orders", "public/users"]
    orders = got["public/orders"]
    assert (orders.version, orders.rows, orders.files, orders.bytes) == (1, 2, 2, 20)
    assert got["public/users"].fields == ["id:long", "name:string"]
    assert table_logs.problems(found, "x").collect() == []
    (tmp_path / "empty").mkdir()
    none = table_logs.read_inventory(spark, str(tmp_path / "empty"))
    assert one(table_logs.problems(none, "x")).problem == "no delta tables under x"


def test_logs_are_read_from_the_newest_whole_checkpoint_on(spark, tmp_path):
    add = lambda path: f'{{"add":{{"path":"{path}","size":10,"stats":"{{\\"numRecords\\":1}}"}}}}'
    schema = '{"metaData":{"schemaString":"{\\"fields\\":[{\\"name\\":\\"id\\",\\"type\\":\\"long\\"}]}"}}'
    old, deep = tmp_path / "an old one", tmp_path / "a" / "b" / "c" / "d" / "deep"
    # the file of every commit but the last replaces the one before
    commits = [[schema, add("f0")]] + [[f'{{"remove":{{"path":"f{i - 1}"}}}}', add(f"f{i}")] for i in range(1, 40)]
    write_log(old, *commits, [add("extra")])
    write_log(deep, [schema, add("x")])
    log = old / "_delta_log"

    def checkpoint(version: int, name: str) -> None:
        rows = spark.createDataFrame([(schema,), (add(f"f{version}"),), (f'{{"remove":{{"path":"f{version - 1}"}}}}',)], "v string")
        parts = rows.select(F.from_json("v", table_logs._ACTION).alias("a")).select("a.*").coalesce(1)
        folder = tmp_path / f"made-{name}"
        parts.write.parquet(str(folder))
        [file] = folder.glob("*.parquet")
        (log / name).write_bytes(file.read_bytes())

    checkpoint(20, f"{20:020d}.checkpoint.parquet")
    checkpoint(30, f"{30:020d}.checkpoint.parquet")
    # one part of two says nothing
    checkpoint(35, f"{35:020d}.checkpoint.{1:010d}.{2:010d}.parquet")
    # what a checkpoint covers is not read: it may be gone or broken
    for version in range(10):
        (log / f"{version:020d}.json").write_text("no json")
    read = table_logs.live_files(spark, str(tmp_path)).collect()
    assert sorted((r.version, r.saved) for r in read) == [(30, False), (30, True)] + [(v, False) for v in range(31, 41)]
    found = one(table_logs.read_inventory(spark, str(tmp_path)))
    assert (found.table_name, found.version, found.rows, found.files, found.fields) == ("an old one", 40, 2, 2, ["id:long"])
    # a checkpoint's own time is not that of its version
    os.utime(log / f"{40:020d}.json", (1_700_000_000, 1_700_000_000))
    checkpoint(40, f"{40:020d}.checkpoint.parquet")
    found = one(table_logs.inventory(table_logs.read_logs(spark, str(tmp_path))).selectExpr("unix_seconds(committed_at) AS at"))
    assert found.at == 1_700_000_000
    everything = table_logs.read_inventory(spark, str(tmp_path), depth=None)
    assert {r.table_name for r in everything.collect()} == {"an old one", "a/b/c/d/deep"}
    assert one(table_logs.problems(everything, "x", most=1)).problem == "more than 1 delta tables under x"
    assert table_logs.problems(everything, "x", most=None).collect() == []


def test_folder_listing(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.xml").write_text("12345")
    (tmp_path / "in" / "deep" / "b.xml").write_text("1")
    got = polled.folder_listing(spark, str(tmp_path / "in"), "f", "2026-09-01 00:00:00")
    assert {(r.name, r.size) for r in got.collect()} == {("a.xml", 5), ("b.xml", 1)}


# reports


def test_what_a_report_may_say(spark):
    raw = spark.createDataFrame(
        [
            (1, "f", "start", ""), (2, "f", "0", None), (3, "f", "+0", '{"rows": 3}'),
            (4, "f", "-3", "{}"), (5, "f", "done", ""), (6, "f", "0", "[1]"),
            (7, "f", "0", '{"rows": "x"}'), (8, "f", "0", '{"Bad Name": 1}'), (9, "F!", "0", ""),
            (10, "f", "0", "{" + ", ".join(f'"m{i}": 1' for i in range(21)) + "}"),
        ],
        "id long, flow string, result string, body string",
    ).withColumn("at", ts(START))
    got = {r.id: (r.outcome, r.detail, r.metrics) for r in reports.run_reports(raw).collect()}
    assert got == {
        1: ("start", "started", None),
        2: ("ok", "exit 0", None),
        3: ("ok", "exit 0", {"rows": 3.0}),
        4: ("fail", "exited with code -3", {}),
    }
    assert {r.id for r in reports.refused_reports(raw).collect()} == {5, 6, 7, 8, 9, 10}


def test_bodies_are_strict(spark):
    good = ['{}', ' { } ', '{"a": -0.5e-3, "b":1}\n', '{"q": 1, "r": 0}']
    bad = ['{"a": NaN}', '{"a": "NaN"}', '{"a": Infinity}', '{"a": 1e999}', "{'a': 1}", '{"a": 1} tail', '{"a": 1}{"b": 2}',
           '{"a": 01}', '{"a": 1,}', '{"a": null}', '{"a": true}', '{"a": "1"}', '{"' + "a" * 200_000]
    raw = spark.createDataFrame([(i, "f", "0", b) for i, b in enumerate(good + bad)], "id long, flow string, result string, body string")
    raw = raw.withColumn("at", ts(START))
    assert {r.id for r in reports.run_reports(raw).collect()} == set(range(len(good)))
    assert {r.id for r in reports.refused_reports(raw).collect()} == set(range(len(good), len(good + bad)))
    calls_sent = ['{"status": 0}', '{"status": 65535}', '{"status": 65536}', '[{"status": 200}, {"status": -1}]']
    sent = spark.createDataFrame([("f", b) for b in calls_sent], "flow string, body string").withColumn("at", ts(START))
    assert sorted(r.status for r in reports.call_reports(sent).collect()) == [0, 65535]
    assert reports.refused_calls(sent).count() == 2


def test_calls_are_counted_and_clamped(spark):
    raw = spark.createDataFrame(
        [("f", '[{"status": 200, "millis": 9223372036854775807}, {"status": 200, "millis": 9223372036854775807}]'),
         ("f", '{"status": 503, "millis": -5}')],
        "flow string, body string",
    ).withColumn("at", ts(START))
    got = one(calls.per_minute(reports.call_reports(raw)))
    assert (got.ok, got.server_errors, got.total_millis) == (2, 1, 2 * 86_400_000)


def test_certificates(spark):
    rows = spark.createDataFrame(
        [("f", START, 200, 10, hour(24 * 90)), ("g", START, 200, 10, hour(24 * 5))],
        "flow string, at timestamp, status int, elapsed_ms long, cert_not_after timestamp",
    )
    limits = spark.createDataFrame([("f", None)], "flow string, max_latency_ms long")
    got = {r.flow: r.warning for r in polled.probe_checks(rows, limits).collect()}
    assert got == {"f": None, "g": "tls certificate expires in 5d (2026-09-06)"}


def test_announced_upsert_keeps_what_was_not_sent(spark):
    schema = (
        "id string, kind string, every_seconds long, after array<string>, owner string, cron string, "
        "calendar array<string>, timezone string, grace_seconds long"
    )
    current = spark.createDataFrame([("a", "heartbeat", 60, ["x"], "o", None, [], None, 5)], schema)
    sent = spark.createDataFrame(
        [("a", "heartbeat", 120, None, None, "0 1 * * *", None, None, None),
         ("b", "inbound", None, None, None, None, None, None, None)],
        schema,
    )
    got = {r.id: r for r in catalogue.coalesced(current, sent).collect()}
    assert (got["a"].every_seconds, got["a"].after, got["a"].owner, got["a"].grace_seconds) == (120, ["x"], "o", 5)
    assert (got["b"].every_seconds, got["b"].after, got["b"].kind) == (86400, [], "inbound")
