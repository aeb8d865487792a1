"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the states a flow can be in
STATES = ["ok", "warning", "late", "failed", "pending", "blocked", "maintenance"]
ATTENTION = ["warning", "late", "failed"]
BROKEN = ["late", "failed", "blocked", "maintenance"]
UP = ["ok", "warning"]
UNMEASURED = ["pending", "maintenance"]
# fixed values: triage order, most urgent first
SEVERITY = ["failed", "late", "warning", "blocked", "maintenance", "pending", "ok"]
# fixed values: roles, weakest first
ROLES = ["viewer", "operator", "editor", "admin"]

MICROS = 1_000_000


def human_duration(seconds: Column) -> Column:
    """The largest whole unit of a duration: ``45s``, ``12m``, ``7h``, ``3d``."""
    s = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))

    def whole(unit: int, letter: str) -> Column:
        return F.concat(F.floor(s / F.lit(unit)).cast("string"), F.lit(letter))

    return (
        F.when(s < 60, whole(1, "s"))
        .when(s < 3600, whole(60, "m"))
        .when(s < 86400, whole(3600, "h"))
        .otherwise(whole(86400, "d"))
    )


def duration_sql(seconds: str) -> str:
    """The same as :func:`human_duration` as SQL text, for expressions written in one piece."""
    s = f"greatest(cast({seconds} AS bigint), 0L)"
    return (
        f"CASE WHEN {s} < 60 THEN concat({s}, 's') WHEN {s} < 3600 THEN concat({s} div 60, 'm') "
        f"WHEN {s} < 86400 THEN concat({s} div 3600, 'h') ELSE concat({s} div 86400, 'd') END"
    )


def readable(x: Column) -> Column:
    """Whole numbers with thousands separators, anything else with two decimals."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, F.format_number(x, 0)).otherwise(F.format_string("%.2f", x))


def micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end) - F.unix_micros(start)


def seconds_since(then: Column, as_of: Column) -> Column:
    """Whole seconds from ``then`` to ``as_of``, truncated towards zero."""
    return int_div(micros_between(then, as_of), F.lit(MICROS))


def int_div(a: Column, b: Column) -> Column:
    """Whole division of integers, truncated towards zero, null for a zero divisor."""
    divisor = F.nullif(b, F.lit(0).cast("long"))
    return ((a - a % divisor) / divisor).cast("long")


def plus_seconds(at: Column, seconds: Column) -> Column:
    return F.timestamp_micros(
        F.unix_micros(at) + seconds.cast("long") * F.lit(MICROS)
    )


def plain_slug(name: Column) -> Column:
    """``Nightly ERP Load (v2)`` → ``nightly-erp-load-v2``."""
    # fixed values: letters that keep their meaning, and what they become
    folded = F.translate(F.lower(name), "åäæáàöøóòéèüú", "aaaaaooooeeuu")
    dashed = F.regexp_replace(folded, "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 64)


def unique_slug(slug: Column, taken: Column, job_id: Column) -> Column:
    """The slug, or one with the job id where it is empty or already taken."""
    stem = F.when(slug == "", F.lit("databricks")).otherwise(slug)
    suffixed = F.substring(F.concat(stem, F.lit("-"), job_id.cast("string")), 1, 64)
    return F.when((slug == "") | taken, suffixed).otherwise(slug)


def valid_id(name: Column) -> Column:
    # fixed value: the form of an id
    return F.coalesce(name.rlike(r"\A[a-z0-9._-]{1,64}\z"), F.lit(False))


#: One part of a glob: whole path components, stars, one character, a class, or a letter.
GLOB_PART = r"(?s)(?<![^/])\*\*(?:/|\z)|\*+|\?|\[!.[^\]]*\]|\[[^!][^\]]*\]|."


def _glob_class(part: Column) -> Column:
    """A class such as ``[a-z_]`` or ``[!0-9]``, every letter of it by its number.

    A range that runs backwards holds nothing.
    """
    negated = part.startswith("[!")
    first = F.when(negated, 3).otherwise(2)
    inside = F.substring(part, first, F.length(part) - first)
    spans = F.regexp_extract_all(inside, F.lit("(?s).-.|."), F.lit(0))
    low = lambda x: F.ascii(x)
    high = lambda x: F.ascii(F.right(x, F.lit(1)))
    number = lambda n: F.concat(F.lit(r"\x{"), F.hex(n), F.lit("}"))
    kept = F.filter(spans, lambda x: low(x) <= high(x))
    text = F.array_join(
        F.transform(kept, lambda x: F.concat(number(low(x)), F.lit("-"), number(high(x)))), ""
    )
    some = F.concat(F.when(negated, "[^").otherwise("["), text, F.lit("]"))
    none = F.when(negated, r"[\s\S]").otherwise("(?!)")
    return F.when(text == "", none).otherwise(some)


def _glob_piece(part: Column) -> Column:
    return (
        F.when(part == "**/", r"(?:[\s\S]*/)?")
        .when(part.startswith("*"), r"[\s\S]*")
        .when(part == "?", r"[\s\S]")
        .when(F.length(part) > 1, _glob_class(part))
        .otherwise(F.concat(F.lit(r"\x{"), F.hex(F.ascii(part)), F.lit("}")))
    )


def glob_error(pattern: Column) -> Column:
    """Why a pattern is none: an open ``[``, or stars in a row that are no path component."""
    parts = F.regexp_extract_all(pattern, F.lit(GLOB_PART), F.lit(0))
    last = F.try_element_at(parts, F.lit(-1))
    # what is no class leaves its bracket behind as a single letter
    open_class = F.exists(parts, lambda x: x == "[")
    inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    stars = F.exists(inner, lambda x: x.rlike(r"\A\*\*+\z")) | F.coalesce(
        last.rlike(r"\A\*\*+\z") & ~pattern.rlike(r"(?s)(?:\A|/)\*\*\z"), F.lit(False)
    )
    return F.when(open_class, "a bracket is not closed").when(
        stars, "stars in a row must be a path component of their own"
    )


def glob_regex(pattern: Column) -> Column:
    """An anchored regular expression for a glob; null for what is none.

    ``*`` and ``?`` stand for any text and any character, ``[…]`` and ``[!…]`` for one of a
    class, in which ``*``, ``?`` and ``[`` mean themselves; ``**/`` for any folders or none.
    """
    parts = F.regexp_extract_all(pattern, F.lit(GLOB_PART), F.lit(0))
    made = F.concat(
        F.lit("\\A"), F.array_join(F.transform(parts, _glob_piece), ""), F.lit("\\z")
    )
    return F.when(glob_error(pattern).isNull(), made)


def glob_match(name: Column, pattern: Column) -> Column:
    """Whether a glob matches a whole name; a pattern that is none matches nothing."""
    hit = F.regexp_like(name, glob_regex(pattern))
    return F.when(name.isNotNull() & pattern.isNotNull(), F.coalesce(hit, F.lit(False)))


def glob_stem(pattern: Column) -> Column:
    """The literal text before the first wildcard."""
    return F.regexp_extract(pattern, r"\A([^*?\[]*)", 1)


def status_class(status: Column) -> Column:
    return (
        F.when(status >= 500, "server_error")
        .when(status >= 400, "client_error")
        .otherwise("ok")
    )


def error_rate(server_errors: Column, total: Column) -> Column:
    return server_errors.cast("double") / F.greatest(total, F.lit(1).cast("long"))


def upper_median(values: Column) -> Column:
    """The middle value of a short array, the upper one of two; null for an empty array."""
    ordered = F.sort_array(values)
    return F.try_element_at(
        ordered, (F.floor(F.size(ordered) / F.lit(2)) + F.lit(1)).cast("int")
    )


def rank_in(value: Column, order: list[str]) -> Column:
    """The position of a value in a fixed order, from 0."""
    rank = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(value == name, F.lit(i)).otherwise(rank)
    return rank


def duration_seconds(text: Column) -> Column:
    """Whole seconds of ``90s``, ``15m``, ``1h30m``, ``2days`` or ``1M``; null when it is none.

    Parts below a second are added up before they are cut off. What no long holds is null too.
    """
    # fixed values: unit names and their nanoseconds or seconds; a month is 30.44 days, a year 365.25
    small = {
        1: ("nanos", "nsec", "ns"),
        1_000: ("micros", "usec", "us"),
        1_000_000: ("millis", "msec", "ms"),
    }
    whole = {
        1: ("seconds", "second", "secs", "sec", "s"),
        60: ("minutes", "minute", "mins", "min", "m"),
        3_600: ("hours", "hour", "hrs", "hr", "h"),
        86_400: ("days", "day", "d"),
        604_800: ("weeks", "week", "wks", "wk", "w"),
        2_630_016: ("months", "month", "M"),
        31_557_600: ("years", "year", "yrs", "yr", "y"),
    }
    names = "|".join(n for units in (small, whole) for group in units.values() for n in group)
    token = rf"([0-9]+)\s*({names})(?![a-zA-Z])"
    parts = F.regexp_extract_all(text, F.lit(token), F.lit(0))

    def total(units: dict[int, tuple[str, ...]]) -> Column:
        def size(part: Column) -> Column:
            unit = F.regexp_extract(part, "([a-zA-Z]+)", 1)
            amount = F.regexp_extract(part, "([0-9]+)", 1).try_cast("long")
            worth = F.lit(0).cast("long")
            for each, group in units.items():
                worth = F.when(unit.isin(*group), F.lit(each).cast("long")).otherwise(worth)
            return F.try_multiply(amount, worth)

        return F.aggregate(F.transform(parts, size), F.lit(0).cast("long"), F.try_add)

    seconds = F.try_add(total(whole), int_div(total(small), F.lit(1_000_000_000)))
    return F.when(F.rlike(text, F.lit(rf"\A\s*({token}\s*)+\z")), seconds)


def trimmed_list(text: Column) -> Column:
    """A comma list as an array, trimmed, without empty entries."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def known_zone(zone: Column) -> Column:
    """The zone, or null where there is none of that name; no bad name ends a job."""
    parts = [F.lit(n) for n in (2000, 1, 1, 0, 0, 0)]
    return F.when(F.try_make_timestamp(*parts, zone).isNotNull(), zone)


def local_label(at: Column, zone: Column | str) -> Column:
    """``fri 25 sep 07:30 cest``: an instant in a zone, lower-cased; UTC for a zone that there is not."""
    zone = F.lit(zone) if isinstance(zone, str) else F.coalesce(known_zone(zone), F.lit("UTC"))
    local = F.from_utc_timestamp(at, zone)
    # fixed values: winter and summer abbreviations of the zones in use
    names = {
        "Europe/Stockholm": ("cet", "cest"),
        "Europe/Helsinki": ("eet", "eest"),
        "Europe/London": ("gmt", "bst"),
        "UTC": ("utc", "utc"),
    }
    offset = (F.unix_seconds(local) - F.unix_seconds(at)) / F.lit(3600)
    winter = {"Europe/Stockholm": 1, "Europe/Helsinki": 2, "Europe/London": 0, "UTC": 0}
    hours = F.format_string("%+03d", F.floor(offset).cast("int"))
    short = hours
    for name, (standard, summer) in names.items():
        label = F.when(offset == winter[name], standard).otherwise(summer)
        short = F.when(zone == name, label).otherwise(short)
    return F.concat_ws(" ", F.lower(F.date_format(local, "EEE dd MMM HH:mm")), short)


def local_clock(at: Column, zone: Column | str) -> Column:
    """``sun 04:00``."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.lower(F.date_format(F.from_utc_timestamp(at, zone), "EEE HH:mm"))
