"""Cron schedules as tables of deadlines.

A schedule row has ``schedule_id, cron, cron_style, timezone, calendar`` and, for due checks,
``grace_seconds``. Fields support lists, ranges, steps, names and ``?``, days also ``L``,
``15W``, ``LW``, ``5L`` and ``5#2``. Unix style has five fields, or six with seconds first, with
Sunday 0 or 7; Quartz style starts with seconds, counts Sunday as 1 and may end with a year.
When both day fields are restricted, either may match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.business_days import holidays
from tidewatch.functions.scalars import known_zone, plus_seconds

# fixed values: month and weekday names
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WEEKDAYS = "sun mon tue wed thu fri sat".split()
# a schedule with so many days a year at least has several in each 400 days; a rarer one is looked
# for among the days of its own months in 40 years each way, which holds ten 29ths of February
OFTEN, NEAR_DAYS, FAR_YEARS = 24, 400, 40
# fixed value: the message when no day counts
NO_BUSINESS_DAY = "no business day found within 400 occurrences"
NO_OCCURRENCE = "never occurs"


# parts of the two day fields that depend on the month; no part of another field does
SPECIAL = {i: "^$" for i in range(7)} | {3: "^(l|lw|[0-9]+w)$", 5: "^([0-9]|[a-z]{3})(l|#[1-5])$"}


def _numbers(index: int, low: int, high: int, names: list[str], base: int) -> str:
    """SQL for the parts of one cron field, each as an array; empty where it makes no sense.

    The text is one expression per field, so a plan is built in a few calls.
    """

    def number(token: str) -> str:
        plain = f"try_cast({token} AS int)"
        if not names:
            return plain
        known = ", ".join(f"'{n}', {i + base}" for i, n in enumerate(names))
        return f"coalesce({plain}, try_element_at(map({known}), {token}))"

    # a part is span/step; ends are found once and then checked
    return f"""
        transform(filter(split(lower(get(_fields, {index})), ','), part -> NOT part RLIKE '{SPECIAL[index]}'), part -> flatten(transform(filter(
            transform(array(struct(
                split_part(part, '/', 1) AS span,
                if(contains(part, '/'), try_cast(split_part(part, '/', 2) AS int), 1) AS step,
                contains(part, '/') AS stepped)),
            p -> struct(
                CASE WHEN p.span IN ('*', '?') THEN {low}
                     ELSE {number("split_part(p.span, '-', 1)")} END AS a,
                CASE WHEN contains(p.span, '-') THEN {number("split_part(p.span, '-', 2)")}
                     WHEN p.span IN ('*', '?') OR p.stepped THEN {high}
                     ELSE {number("p.span")} END AS b,
                p.step AS c)),
            r -> r.a >= {low} AND r.b <= {high} AND r.a <= r.b AND r.c >= 1),
            r -> sequence(r.a, r.b, r.c))))"""


def parsed(schedules: DataFrame) -> DataFrame:
    """Adds the field values, ``valid``, and the seconds of the day it fires at.

    A time zone that there is not goes to ``bad_zone`` and UTC stands in its place.
    """
    there = known_zone(F.col("timezone"))
    schedules = schedules.withColumns(
        {
            "bad_zone": F.when(there.isNull(), F.col("timezone")),
            "timezone": F.coalesce(there, F.lit("UTC")),
        }
    )
    sets = ["_second", "_minute", "_hour", "_dom", "_month", "_dow", "_year"]
    rules = {"_dom": "_dom_rules", "_dow": "_dow_rules"}
    fields = "split(trim(cron), '\\\\s+')"
    out = schedules.withColumn(
        "_fields",
        F.expr(f"if(cron_style = 'quartz' OR size({fields}) = 6, {fields}, concat(array('0'), {fields}))"),
    )
    unix_days, quartz_days = _numbers(5, 0, 7, WEEKDAYS, 0), _numbers(5, 1, 7, WEEKDAYS, 1)
    parts = {
        "_second": _numbers(0, 0, 59, [], 0),
        "_minute": _numbers(1, 0, 59, [], 0),
        "_hour": _numbers(2, 0, 23, [], 0),
        "_dom": _numbers(3, 1, 31, [], 0),
        "_month": _numbers(4, 1, 12, MONTHS, 1),
        "_dow": f"if(cron_style = 'quartz', {quartz_days}, {unix_days})",
        "_year": "if(size(_fields) < 7, array(array(0)), " + _numbers(6, 1970, 2199, [], 0) + ")",
        "_any_year": "size(_fields) < 7 OR get(_fields, 6) IN ('*', '?')",
        "_dom_rules": f"filter(split(lower(get(_fields, 3)), ','), p -> p RLIKE '{SPECIAL[3]}')",
        "_dow_rules": f"""transform(filter(split(lower(get(_fields, 5)), ','), p -> p RLIKE '{SPECIAL[5]}'), p -> struct(
            if(cron_style = 'quartz', 6, 7) + coalesce(try_cast(left(p, 1) AS int),
                array_position(array({", ".join(f"'{d}'" for d in WEEKDAYS)}), left(p, 3)) - if(cron_style = 'quartz', 0, 1)) AS dow,
            try_cast(right(p, 1) AS int) AS nth))""",
        "_any_dom": "get(_fields, 3) IN ('*', '?')",
        "_any_dow": "get(_fields, 5) IN ('*', '?')",
    }
    out = out.withColumns({n: F.expr(e) for n, e in parts.items()})
    # a day field may have rules only; a plain part that makes no sense still spoils it
    spoilt = [f"exists({n}, p -> size(p) = 0) OR size({n}) + size({r}) = 0" for n, r in rules.items()]
    out = out.withColumn("_spoilt", F.expr(" OR ".join(f"coalesce({x}, true)" for x in spoilt)))
    # one part that makes no sense spoils the field
    whole = "if(exists({0}, p -> size(p) = 0), cast(array() AS array<int>), array_distinct(flatten({0})))"
    out = out.withColumns({n: F.expr(whole.format(n)) for n in sets})
    filled = "NOT _spoilt AND " + " AND ".join(f"coalesce(size({n}), 0) > 0" for n in sets if n not in rules)
    return out.withColumns(
        {
            # Sunday is 0 in what follows
            "_dow": F.expr(
                "array_distinct(transform(_dow, d -> if(cron_style = 'quartz', d - 1, d % 7)))"
            ),
            "valid": F.expr(
                f"""bad_zone IS NULL AND size(_fields) IN (6, if(cron_style = 'quartz', 7, 6)) AND {filled}
                    AND forall(calendar, c -> c IN ('se', 'fi'))"""
            ),
            "_times": F.expr(
                """flatten(transform(_hour, h -> flatten(transform(_minute, m ->
                   transform(_second, s -> h * 3600 + m * 60 + s)))))"""
            ),
        }
    ).drop("_fields", "_second", "_minute", "_hour", "_spoilt")


# the days of a month that a rule of the day of the month names, and one of the day of the week; 1 is Sunday
_WEEKEND = "CASE dayofweek({0}) WHEN 7 THEN {1} WHEN 1 THEN {2} ELSE 0 END"
_NAMED = "make_date(year(m), month(m), least(cast(replace(x, 'w', '') AS int), day(last_day(m))))"
_DOM_RULE = f"""CASE x WHEN 'l' THEN d = last_day(m)
    WHEN 'lw' THEN d = date_add(last_day(m), {_WEEKEND.format("last_day(m)", -1, -2)})
    ELSE try_cast(replace(x, 'w', '') AS int) BETWEEN 1 AND day(last_day(m)) AND d = date_add({_NAMED},
        {_WEEKEND.format(_NAMED, f"if(day({_NAMED}) = 1, 2, -1)", f"if({_NAMED} = last_day(m), -2, 1)")}) END"""
_DOW_RULE = """(dayofweek(d) - 1) = x.dow % 7 AND if(x.nth IS NULL, day(d) > day(last_day(m)) - 7, ceil(day(d) / 7) = x.nth)"""
_MATCH = f"""CASE WHEN s.any_dom AND s.any_dow THEN true
    ELSE NOT s.any_dom AND (array_contains(s.dom, day(d)) OR exists(s.dom_rules, x -> {_DOM_RULE}))
      OR NOT s.any_dow AND (array_contains(s.dow, dayofweek(d) - 1) OR exists(s.dow_rules, x -> {_DOW_RULE})) END"""
# what a lambda binds is computed once a row; months first, then the days of those that can match
_DAYS = f"""get(transform(array(struct(_month AS month, _year AS year, _dom AS dom, _dow AS dow, _dom_rules AS dom_rules,
    _dow_rules AS dow_rules, _any_dom AS any_dom, _any_dow AS any_dow, _any_year AS any_year, _from AS a, _until AS b)),
    s -> flatten(transform(
        filter(sequence(trunc(s.a, 'MM'), trunc(s.b, 'MM'), INTERVAL 1 MONTH),
            m -> array_contains(s.month, month(m)) AND (s.any_year OR array_contains(s.year, year(m)))),
        m -> filter(sequence(greatest(m, s.a), least(last_day(m), s.b)), d -> {_MATCH})))), 0)"""
#: Days a year that a schedule has at least, if all its years are meant.
_YEARLY = """if(_any_year, size(_month), 0) * CASE WHEN _any_dom AND _any_dow THEN 28
    ELSE if(_any_dom, 0, size(filter(_dom, x -> x <= 28))) + if(_any_dow, 0, 4 * size(_dow)) END"""


def matching_days(plans: DataFrame, first: Column, last: Column, years: tuple[int, int]) -> DataFrame:
    """(…, day, counts): the days the cron fields allow; ``counts`` on business days only.

    A schedule that is not valid, or has no day, keeps one row without one.
    """
    bounds = plans.withColumns({"_from": first, "_until": last})
    days = bounds.withColumn("day", F.explode_outer(F.when(F.col("valid"), F.expr(_DAYS))))
    # two countries and a few dozen days a year: bounded by the horizon
    off = holidays(plans.sparkSession, *years).groupBy("date").agg(
        F.collect_set("country").alias("_off")
    )
    counts = """day IS NOT NULL AND (size(calendar) = 0 OR NOT (dayofweek(day) IN (1, 7)
        OR arrays_overlap(calendar, coalesce(_off, cast(array() AS array<string>)))))"""
    return (
        days.join(F.broadcast(off), days["day"] == off["date"], "left")
        .withColumn("counts", F.expr(counts))
        .drop("date", "_off", "_from", "_until", "_dom", "_month", "_dow", "_year", "_any_dom", "_any_dow", "_any_year")
        .drop("_dom_rules", "_dow_rules")
    )


def _instants(days: DataFrame) -> DataFrame:
    fired = days.withColumn("_time", F.explode_outer(F.when(F.col("counts"), F.col("_times"))))
    local = plus_seconds(F.col("day").cast("timestamp"), F.col("_time"))
    return fired.withColumn("at", F.to_utc_timestamp(local, F.col("timezone"))).drop(
        "_time", "_times"
    )


def deadlines(schedules: DataFrame, start: str, end: str) -> DataFrame:
    """(schedule_id, due_at, previous_at, next_at) for local days from start to end."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    years = (int(start[:4]), int(end[:4]))
    days = matching_days(parsed(schedules), first, last, years).where("counts")
    # one schedule's occurrences are bounded by the horizon
    order = Window.partitionBy("schedule_id").orderBy("at")
    return _instants(days).select(
        "schedule_id",
        F.col("at").alias("due_at"),
        F.lag("at").over(order).alias("previous_at"),
        F.lead("at").over(order).alias("next_at"),
    )


def around(schedules: DataFrame, as_of: str) -> DataFrame:
    """Per schedule the last due occurrence at ``as_of``, the one before it and the next one.

    Due means at or before ``as_of`` less the grace. However rare its days are, a schedule keeps
    its row; one that never occurs has an error. Only the few days around ``as_of`` are
    opened up into times of day, so an every-minute cron costs no more than a daily one.
    """
    now = F.lit(as_of).cast("timestamp")
    cutoff = plus_seconds(now, -F.col("grace_seconds"))
    plans = parsed(schedules).withColumns(
        {
            "_cutoff": cutoff,
            "_last_day": F.to_date(F.from_utc_timestamp(cutoff, F.col("timezone"))),
            "_today": F.to_date(F.from_utc_timestamp(now, F.col("timezone"))),
        }
    )
    year = int(as_of[:4])
    reach = F.expr(f"if({_YEARLY} >= {OFTEN}, {NEAR_DAYS}, {366 * FAR_YEARS})")
    days = matching_days(
        plans.withColumn("_reach", reach),
        F.expr("date_sub(_last_day, _reach)"),
        F.expr("date_add(_today, _reach)"),
        (year - FAR_YEARS - 2, year + FAR_YEARS + 2),
    )
    past, coming = F.col("day") <= F.col("_last_day"), F.col("day") >= F.col("_today")
    # a few hundred days of a schedule at most
    back = Window.partitionBy("schedule_id", "counts", past).orderBy(F.desc("day"))
    ahead = Window.partitionBy("schedule_id", "counts", coming).orderBy("day")
    ranked = days.withColumns(
        {"_back": F.row_number().over(back), "_ahead": F.row_number().over(ahead)}
    )
    # the last day may only fire after the cutoff, so three days hold two due occurrences;
    # of days that do not count one is enough to know that there are any
    near = ranked.where(
        F.col("day").isNull()
        | (past & (F.col("_back") <= F.when(F.col("counts"), 3).otherwise(1)))
        | (coming & F.col("counts") & (F.col("_ahead") <= 2))
    )
    fired = _instants(near).withColumn("_due", F.col("at") <= F.col("_cutoff"))
    latest = Window.partitionBy("schedule_id", "_due").orderBy(F.desc("at"))
    fired = fired.withColumn("_n", F.row_number().over(latest))
    nth = lambda n: F.max(F.when(F.col("_due") & (F.col("_n") == n), F.col("at")))
    counted = F.max(F.when(past, F.col("counts")))
    error = F.when(
        F.max("bad_zone").isNotNull(), F.concat(F.lit("no such time zone: "), F.max("bad_zone"))
    ).when(
        ~F.min("valid"), F.concat(F.lit('cron "'), F.max("cron"), F.lit('"'))
    ).when(F.count("day") == 0, F.lit(NO_OCCURRENCE)).when(~counted, F.lit(NO_BUSINESS_DAY))
    return fired.groupBy("schedule_id").agg(
        nth(1).alias("due_at"),
        nth(2).alias("previous_at"),
        F.min(F.when(F.col("at") > now, F.col("at"))).alias("next_at"),
        error.alias("error"),
    )


def open_windows(windows: DataFrame, as_of: str) -> DataFrame:
    """(name, opened_at, closes_at, is_open, next_opening) of maintenance windows."""
    plans = windows.select(
        F.col("name").alias("schedule_id"),
        "cron",
        "cron_style",
        "timezone",
        F.array().cast("array<string>").alias("calendar"),
        F.lit(0).cast("long").alias("grace_seconds"),
    )
    times = around(plans, as_of).withColumnRenamed("schedule_id", "name")
    closes = plus_seconds(F.col("due_at"), F.col("lasts_seconds"))
    now = F.lit(as_of).cast("timestamp")
    return windows.join(times, "name").select(
        "name",
        "patterns",
        "timezone",
        F.col("due_at").alias("opened_at"),
        closes.alias("closes_at"),
        F.coalesce(now < closes, F.lit(False)).alias("is_open"),
        F.col("next_at").alias("next_opening"),
    )
