"""Dates, times, instants and durations.

Dates are Spark dates; local date-times are timestamps without zone; date-times are
instants shown in UTC; times and durations are structs of their parts.  Spark keeps
microseconds, so smaller fractions are cut in date-times (durations keep nanoseconds).
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import CypherError, CypherTypeError
from .values import DURATION, LOCAL_TIME, OFFSET_TIME, Val, let, make

#: The type of each kind of value.
TYPES = {"date": T.DateType(), "localtime": LOCAL_TIME, "time": OFFSET_TIME, "localdatetime": T.TimestampNTZType(), "datetime": T.TimestampType(), "duration": DURATION}

KINDS = ("date", "localtime", "time", "localdatetime", "datetime", "duration")
INSTANT = ("date", "localdatetime", "datetime")
DAY, NANO = 86_400, 1_000_000_000
#: Average lengths that the language fixes: days of a month by the 400-year cycle.
MONTH_DAYS = (146_097, 4_800)


@dataclass
class Clock:
    """One instant for a statement."""

    at: dt.datetime

    @classmethod
    def now(cls) -> Clock:
        return cls(dt.datetime.now(dt.UTC))


def is_temporal(kind: str) -> bool:
    return kind in KINDS


def ntz(v: Val) -> Val:
    """A date or date-time as a local date-time."""
    return v if v.kind == "localdatetime" else make(lambda x: F.to_utc_timestamp(x, "UTC").cast("timestamp_ntz") if v.kind == "datetime" else x.cast("timestamp_ntz"), v)


def duration_struct(months: Column, days: Column, seconds: Column, nanos: Column) -> Column:
    """Parts as a duration, nanoseconds carried into seconds."""
    total = nanos.cast("decimal(38,0)")
    carry = F.floor(total / NANO).cast("long")
    return F.struct(months.cast("long").alias("months"), days.cast("long").alias("days"), (seconds.cast("long") + carry).alias("seconds"), (total - carry.cast("decimal(38,0)") * NANO).cast("long").alias("nanos"))


_DURATION = re.compile(r"^([-+]?)P(?:(?P<y>[-+]?\d+(?:\.\d+)?)Y)?(?:(?P<q>[-+]?\d+(?:\.\d+)?)Q)?(?:(?P<mo>[-+]?\d+(?:\.\d+)?)M)?(?:(?P<w>[-+]?\d+(?:\.\d+)?)W)?(?:(?P<d>[-+]?\d+(?:\.\d+)?)D)?(?:T(?:(?P<h>[-+]?\d+(?:\.\d+)?)H)?(?:(?P<mi>[-+]?\d+(?:\.\d+)?)M)?(?:(?P<s>[-+]?\d+(?:\.\d+)?)S)?)?$")

#: The form of a date-time, in which every part but the fraction is written.
_DURATION_DATED = re.compile(r"^P([-+]?\d{4,})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:[.,](\d{1,9}))?$", re.ASCII)


def dated_parts(m: re.Match) -> tuple[int, int, int, int]:
    """Parts of a duration that is written like a date-time, and must be one."""
    y, mo, d, h, mi, s = (int(m[k]) for k in range(1, 7))
    try:
        dt.datetime(2000 + y % 400, mo, d, h, mi, s)  # leap years come again after 400 years
    except ValueError:
        raise CypherError(f"{m[0]!r} is no duration") from None
    return spread(y * 12 + mo, d, h * 3600 + mi * 60 + s, int((m[7] or "").ljust(9, "0")))


def duration_parts(text: str) -> tuple[int, int, int, int]:
    """months, days, seconds, nanos of an ISO duration; fractions flow into smaller units."""
    if dated := _DURATION_DATED.match(text.strip()):
        return dated_parts(dated)
    m = _DURATION.match(text.strip())
    if not m or text.strip().endswith(("P", "T")):
        raise CypherError(f"{text!r} is no duration")
    sign = -1 if m[1] == "-" else 1
    n = {k: sign * float(v) if "." in v else sign * int(v) for k, v in m.groupdict().items() if v}
    return spread(n.get("y", 0) * 12 + n.get("q", 0) * 3 + n.get("mo", 0), n.get("w", 0) * 7 + n.get("d", 0), n.get("h", 0) * 3600 + n.get("mi", 0) * 60 + n.get("s", 0), 0)


def spread(months: float, days: float, seconds: float, nanos: float) -> tuple[int, int, int, int]:
    whole = int(months)
    days = days + (months - whole) * MONTH_DAYS[0] / MONTH_DAYS[1]
    d = int(days)
    rest = round((days - d) * DAY * NANO) + (int(seconds) * NANO + round((seconds - int(seconds)) * NANO)) + int(nanos)
    s, n = divmod(rest, NANO)
    return whole, d, s, n


def call(name: str, args: list[Val], clock: Clock, literal) -> Val | None:
    if name == "timestamp":
        return literal(int(clock.at.timestamp() * 1000))
    if name == "datetime.fromepoch":
        return make(lambda s, n: F.timestamp_micros(s * 1_000_000 + F.floor(n / 1000)), *args)
    if name == "datetime.fromepochmillis":
        return make(lambda x: F.timestamp_millis(x), *args)
    base, _, method = name.partition(".")
    if base not in KINDS:
        return None
    if method in ("transaction", "statement", "realtime"):
        return current(base, clock, literal)
    if method == "truncate":
        return truncate(base, *args)
    if base == "duration" and method:
        return between(method, *args)
    if method:
        return None
    if not args:
        return current(base, clock, literal)
    return construct(base, args[0], literal)


def current(kind: str, clock: Clock, literal) -> Val:
    at = clock.at.replace(tzinfo=None)
    unit = literal(at)
    stamp = make(lambda x: F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz"), unit)
    return convert(kind, stamp)


def convert(kind: str, v: Val) -> Val:
    """A date or date-time as another kind."""
    if v.kind == kind:
        return v
    if v.kind == "null":
        return make(lambda x: F.lit(None), v)
    if kind == "date":
        return make(lambda x: x.cast("date"), v)
    if kind == "localdatetime":
        return ntz(v)
    if kind == "datetime":
        return make(lambda x: x.cast("timestamp"), v)
    nanos = lambda x: ((F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)).cast("long") * NANO + (F.date_format(x, "SSSSSS").cast("long") * 1000))
    if v.kind in ("localtime", "time"):
        base = lambda x: x["nanos_of_day"]
    elif v.kind in INSTANT:
        v, base = ntz(v), nanos
    else:
        raise CypherTypeError(f"{kind} doesn't take {v.kind}")
    if kind == "localtime":
        return make(lambda x: F.when(x.isNotNull(), F.struct(base(x).alias("nanos_of_day"))), v, known=LOCAL_TIME)
    return make(lambda x: F.when(x.isNotNull(), F.struct(base(x).alias("nanos_of_day"), F.lit(0).alias("offset"))), v, known=OFFSET_TIME)


def construct(kind: str, v: Val, literal) -> Val:
    if v.kind == "null":
        return v
    if kind == "duration":
        if v.kind == "duration":
            return v
        if v.kind == "string":
            if v.is_constant:
                parts = duration_parts(v.constant)
                return make(lambda x: duration_struct(*[F.lit(p).cast("long") for p in parts]), v, known=DURATION)
            return make(parse_duration, v, known=DURATION)
        return from_map_duration(v)
    if v.kind == "string":
        return parse(kind, v)
    if v.kind == "map":
        return from_map(kind, v)
    return convert(kind, v)


def parse_duration(x: Column) -> Column:
    """An ISO duration in a column: whole units, and a fraction of seconds."""

    def part(pattern: str) -> Column:
        found = F.regexp_extract(x, pattern, 1)
        return F.when(found != "", found.cast("double")).otherwise(F.lit(0.0))

    day, time = r"^P(?:[^T]*?[A-Z])??", r"T(?:[^T]*?[A-Z])??"
    months = part(day + r"([-+]?\d+)Y") * 12 + part(day + r"([-+]?\d+)M")
    days = part(day + r"([-+]?\d+)W") * 7 + part(day + r"([-+]?\d+)D")
    seconds = part(time + r"([-+]?\d+)H") * 3600 + part(time + r"([-+]?\d+)M") * 60 + part(time + r"([-+]?\d+(?:\.\d+)?)S")
    value = duration_struct(months, days, F.floor(seconds), F.round((seconds - F.floor(seconds)) * NANO))
    return F.when(x.rlike(r"^P(?=.)"), value)


def parse(kind: str, v: Val) -> Val:
    """ISO texts: calendar, ordinal, week and quarter dates, extended or basic; times with fractions and offsets."""

    def date(x: Column) -> Column:
        plain = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x.try_cast("date")).when(x.rlike(r"^\d{8}$"), F.try_to_timestamp(x, F.lit("yyyyMMdd")).cast("date"))
        plain = plain.when(x.rlike(r"^\d{4}-?\d{2}$"), F.concat(F.substring(x, 1, 4), F.lit("-"), F.right(x, F.lit(2)), F.lit("-01")).try_cast("date")).when(x.rlike(r"^\d{4}$"), F.concat(x, F.lit("-01-01")).try_cast("date"))
        year = F.regexp_extract(x, r"^(\d{4})", 1).try_cast("int")
        ordinal = F.regexp_extract(x, r"^\d{4}-?(\d{3})$", 1).try_cast("int")
        week, day = F.regexp_extract(x, r"W(\d{2})", 1).try_cast("int"), F.coalesce(F.regexp_extract(x, r"W\d{2}-?(\d)", 1).try_cast("int"), F.lit(1))
        quarter, of = F.regexp_extract(x, r"Q(\d)", 1).try_cast("int"), F.coalesce(F.regexp_extract(x, r"Q\d-?(\d{2})", 1).try_cast("int"), F.lit(1))
        plain = plain.when(x.rlike(r"^\d{4}-?\d{3}$"), F.date_add(F.make_date(year, F.lit(1), F.lit(1)), ordinal - 1))
        plain = plain.when(x.rlike(r"^\d{4}-?W"), week_date(year, week, day))
        return plain.when(x.rlike(r"^\d{4}-?Q"), F.date_add(F.make_date(year, quarter * 3 - 2, F.lit(1)), of - 1))

    clock = r"(\d{2}):?(\d{2})?:?(\d{2})?(\.\d+)?"

    def nanos(x: Column) -> Column:
        bit = lambda k: F.coalesce(F.regexp_extract(x, f"^{clock}", k).try_cast("long"), F.lit(0))
        fraction = F.coalesce(F.rpad(F.regexp_extract(x, r"\.(\d+)", 1), 9, "0").try_cast("long"), F.lit(0))
        return (bit(1) * 3600 + bit(2) * 60 + bit(3)) * NANO + fraction

    def offset(x: Column) -> Column:
        sign = F.when(x.rlike(r"-\d{2}:?(\d{2})?$"), -1).otherwise(1)
        h, m = F.regexp_extract(x, r"[-+](\d{2}):?(\d{2})?$", 1), F.regexp_extract(x, r"[-+](\d{2}):?(\d{2})?$", 2)
        return (sign * (F.coalesce(h.try_cast("int"), F.lit(0)) * 3600 + F.coalesce(m.try_cast("int"), F.lit(0)) * 60)).cast("int")

    def fn(x: Column) -> Column:
        if kind == "date":
            return date(x)
        if kind == "localtime":
            return F.when(x.isNotNull(), F.struct(nanos(x).alias("nanos_of_day")))
        if kind == "time":
            return F.when(x.isNotNull(), F.struct(nanos(x).alias("nanos_of_day"), offset(x).alias("offset")))
        day, time = F.split_part(x, F.lit("T"), F.lit(1)), F.split_part(x, F.lit("T"), F.lit(2))
        micros = F.unix_date(date(day)).cast("long") * DAY * 1_000_000 + F.floor(nanos(time) / 1000).cast("long")
        zone = F.regexp_extract(x, r"\[([^\]]+)\]", 1)
        if kind == "localdatetime":
            return utc_ntz(micros)
        bare = F.regexp_replace(time, r"\[.*\]$", "")
        instant = F.timestamp_micros(micros - offset(bare).cast("long") * 1_000_000)
        return F.when((zone != "") & ~bare.rlike(r"(Z|[-+]\d{2}:?\d{0,2})$"), F.to_utc_timestamp(F.timestamp_micros(micros), zone)).otherwise(instant)

    return make(lambda x: let(x, fn), v, known=TYPES[kind])


def utc_ntz(micros: Column) -> Column:
    """Local date-time of a count of microseconds, whatever the session's zone."""
    days = F.floor(micros / (DAY * 1_000_000)).cast("int")
    rest = micros - days.cast("long") * DAY * 1_000_000
    seconds = (rest.cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)")
    return F.date_from_unix_date(days).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def week_date(year: Column, week: Column, day: Column) -> Column:
    """Day of an ISO week: the week of 4 January is the first."""
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_sub(fourth, F.weekday(fourth))
    return F.date_add(monday, (week - 1) * 7 + day - 1)


def pick(v: Val, *names: str) -> dict[str, Val]:
    known = {n.lower(): n for n in v.type.fieldNames()}
    return {n: make(lambda x, real=known[n.lower()]: x[real], v) for n in names if n.lower() in known}


def from_map_duration(v: Val) -> Val:
    units = ("years", "quarters", "months", "weeks", "days", "hours", "minutes", "seconds", "milliseconds", "microseconds", "nanoseconds")
    if unknown := {n.lower() for n in v.type.fieldNames()} - set(units):
        raise CypherError(f"a duration has no {', '.join(unknown)}")
    parts = pick(v, *units)

    def fn(*cols: Column) -> Column:
        n = dict(zip(parts, cols, strict=True))
        get = lambda k: n[k].cast("double") if k in n else F.lit(0.0)
        exact = lambda k: n[k].cast("decimal(30,9)") if k in n else F.lit(0).cast("decimal(30,9)")
        months = get("years") * 12 + get("quarters") * 3 + get("months")
        whole = months.cast("long")
        days = get("weeks") * 7 + get("days") + (months - whole) * MONTH_DAYS[0] / MONTH_DAYS[1]
        d = days.cast("long")
        seconds = exact("hours") * 3600 + exact("minutes") * 60 + exact("seconds")
        s = F.floor(seconds).cast("long")
        nanos = ((seconds - s.cast("decimal(30,0)")) * NANO).cast("decimal(30,0)") + exact("milliseconds") * 1_000_000 + exact("microseconds") * 1000 + exact("nanoseconds") + F.round((days - d) * DAY * NANO).cast("decimal(30,0)")
        return duration_struct(whole, d, s, F.floor(nanos))

    return make(fn, *parts.values(), known=DURATION)


def from_map(kind: str, v: Val) -> Val:
    names = ("date", "time", "datetime", "year", "month", "day", "week", "dayOfWeek", "ordinalDay", "quarter", "dayOfQuarter", "hour", "minute", "second", "millisecond", "microsecond", "nanosecond", "timezone")
    given = {x.name.lower(): x for x in v.type.fields}
    given = {n: given[n.lower()] for n in names if n.lower() in given}

    def part(m: Column, kind: str, *names: str) -> Column | None:
        """The first of the named fields that is given, as another kind."""
        for x in (given[n] for n in names if n in given):
            return convert(kind, Val(m[x.name], v.shadow[x.name], v.env, v.typer, x.dataType)).col
        return None

    def fn(m: Column) -> Column:
        n = {k: m[x.name] for k, x in given.items()}
        day0, time0 = part(m, "date", "datetime", "date"), part(m, "localtime", "datetime", "time")
        whole = lambda k, other: n[k].cast("int") if k in n else other
        start = lambda get, k: get(day0) if day0 is not None else F.lit(k)
        year = whole("year", start(F.year, 1970))
        if "week" in n:
            day = week_date(year, n["week"].cast("int"), whole("dayOfWeek", start(lambda x: F.weekday(x) + 1, 1)))
        elif "ordinalDay" in n:
            day = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), n["ordinalDay"].cast("int") - 1)
        elif "quarter" in n:
            day = F.date_add(F.make_date(year, n["quarter"].cast("int") * 3 - 2, F.lit(1)), whole("dayOfQuarter", F.lit(1)) - 1)
        else:
            day = F.make_date(year, whole("month", start(F.month, 1)), whole("day", start(F.dayofmonth, 1)))
        if kind == "date":
            return day
        nano0 = time0["nanos_of_day"] if time0 is not None else None
        unit = lambda k, size, wrap: n[k].cast("long") if k in n else (F.floor(nano0 / size) % wrap if nano0 is not None else F.lit(0).cast("long"))
        sub = lambda k, size: n[k].cast("long") * size if k in n else F.lit(0).cast("long")
        small = sub("millisecond", 1_000_000) + sub("microsecond", 1000) + sub("nanosecond", 1)
        if nano0 is not None and not {"millisecond", "microsecond", "nanosecond"} & n.keys():
            small = nano0 % NANO
        nanos = (unit("hour", 3600 * NANO, 24) * 3600 + unit("minute", 60 * NANO, 60) * 60 + unit("second", NANO, 60)).cast("long") * NANO + small
        zone = n.get("timezone")
        if kind == "localtime":
            return F.struct(nanos.alias("nanos_of_day"))
        if kind == "time":
            return F.struct(nanos.alias("nanos_of_day"), (zone_offset(zone) if zone is not None else F.lit(0)).alias("offset"))
        micros = F.unix_date(day).cast("long") * DAY * 1_000_000 + F.floor(nanos / 1000).cast("long")
        if kind == "localdatetime":
            return utc_ntz(micros)
        return F.to_utc_timestamp(F.timestamp_micros(micros), zone) if zone is not None else F.timestamp_micros(micros)

    return make(lambda x: let(x, fn), v, known=TYPES[kind])


def zone_offset(zone: Column) -> Column:
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    h, m = F.regexp_extract(zone, r"(\d{2}):?(\d{2})?$", 1).try_cast("int"), F.regexp_extract(zone, r"(\d{2}):?(\d{2})?$", 2).try_cast("int")
    return (sign * (F.coalesce(h, F.lit(0)) * 3600 + F.coalesce(m, F.lit(0)) * 60)).cast("int")


def truncate(kind: str, unit: Val, v: Val, extra: Val | None = None) -> Val:
    if not unit.is_constant:
        raise CypherError("truncate takes a constant unit")
    name = str(unit.constant).lower()
    if extra is not None and extra.kind != "null":
        return _overridden(kind, name, truncate(kind, unit, v), extra)
    if v.kind in ("localtime", "time"):
        sizes = {"day": DAY * NANO, "hour": 3600 * NANO, "minute": 60 * NANO, "second": NANO, "millisecond": 1_000_000, "microsecond": 1000}
        cut = make(lambda x: x.withField("nanos_of_day", x["nanos_of_day"] - x["nanos_of_day"] % sizes[name]), v)
        return convert(kind, cut)
    base = ntz(v)
    years = {"decade": 10, "century": 100, "millennium": 1000}

    def fn(x: Column) -> Column:
        if name in years:
            y = F.year(x)
            return F.make_date(y - F.pmod(y, F.lit(years[name])), F.lit(1), F.lit(1)).cast("timestamp_ntz")
        if name == "weekyear":
            return week_date(F.extract(F.lit("yearofweek"), x), F.lit(1), F.lit(1)).cast("timestamp_ntz")
        return F.date_trunc(name, x).cast("timestamp_ntz")

    cut = make(fn, base)
    return convert(kind, cut)


def _overridden(kind: str, unit: str, cut: Val, extra: Val) -> Val:
    """A truncated value with components of its own from a map."""
    if not isinstance(extra.type, T.StructType):
        raise CypherTypeError("truncate takes a map of components")
    names = {n.lower(): n for n in extra.type.fieldNames()}
    role = {"date": "date", "localtime": "time", "time": "time"}.get(kind, "datetime")

    def merged(x: Column, m: Column) -> Column:
        fields = [x.alias(role), *[m[n].alias(n) for n in extra.type.fieldNames()]]
        if "dayofweek" in names and "week" not in names:
            fields += [F.weekofyear(x).alias("week"), *([] if "year" in names else [F.extract(F.lit("yearofweek"), x).alias("year")])]
        if "dayofquarter" in names and "quarter" not in names:
            fields.append(F.quarter(x).alias("quarter"))
        return F.struct(*fields)

    return from_map(kind, make(merged, cut, extra))


def component(v: Val, key: str) -> Val:
    name = key.lower()
    if v.kind == "duration":
        return duration_component(v, name)
    if v.kind in INSTANT:
        x = ntz(v)
        fns = {
            "year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "weekyear": lambda d: F.extract(F.lit("yearofweek"), d), "day": F.dayofmonth, "ordinalday": F.dayofyear,
            "weekday": lambda d: F.weekday(d) + 1, "dayofweek": lambda d: F.weekday(d) + 1, "dayofquarter": lambda d: F.datediff(d, F.date_trunc("quarter", d)) + 1,
        }
        if name in fns:
            return make(lambda d: fns[name](d).cast("long"), x)
        if v.kind == "datetime":
            zone = {"timezone": F.lit("Z"), "offset": F.lit("Z"), "offsetminutes": F.lit(0).cast("long"), "offsetseconds": F.lit(0).cast("long")}
            if name in zone:
                return make(lambda d: F.when(d.isNotNull(), zone[name]), v)
            if name == "epochseconds":
                return make(lambda d: F.unix_seconds(d), v)
            if name == "epochmillis":
                return make(lambda d: F.unix_millis(d), v)
        if v.kind == "date":
            raise CypherTypeError(f"a date has no {key}")
        v = convert("localtime", v)
    if v.kind == "time":
        if name in ("timezone", "offset"):
            return make(lambda x: offset_text(x["offset"]), v)
        if name in ("offsetminutes", "offsetseconds"):
            return make(lambda x: F.floor(x["offset"] / (60 if name == "offsetminutes" else 1)).cast("long"), v)
    sizes = {"hour": (3600 * NANO, 24), "minute": (60 * NANO, 60), "second": (NANO, 60), "millisecond": (1_000_000, 1000), "microsecond": (1000, 1_000_000), "nanosecond": (1, NANO)}
    if name not in sizes:
        raise CypherTypeError(f"{v.kind} has no {key}")
    size, wrap = sizes[name]
    return make(lambda x: (F.floor(x["nanos_of_day"] / size) % wrap).cast("long"), v)


def duration_component(v: Val, name: str) -> Val:
    cut = lambda a, n: (a / n).cast("long")
    fns = {
        "years": lambda d: cut(d["months"], 12), "quarters": lambda d: cut(d["months"], 3), "months": lambda d: d["months"], "weeks": lambda d: cut(d["days"], 7), "days": lambda d: d["days"],
        "hours": lambda d: cut(d["seconds"], 3600), "minutes": lambda d: cut(d["seconds"], 60), "seconds": lambda d: d["seconds"], "milliseconds": lambda d: d["seconds"] * 1000 + cut(d["nanos"], 1_000_000),
        "microseconds": lambda d: d["seconds"] * 1_000_000 + cut(d["nanos"], 1000), "nanoseconds": lambda d: d["seconds"] * NANO + d["nanos"], "quartersofyear": lambda d: cut(d["months"] % 12, 3), "monthsofyear": lambda d: d["months"] % 12,
        "monthsofquarter": lambda d: d["months"] % 3, "daysofweek": lambda d: d["days"] % 7, "minutesofhour": lambda d: cut(d["seconds"], 60) % 60, "secondsofminute": lambda d: d["seconds"] % 60,
        "millisecondsofsecond": lambda d: cut(d["nanos"], 1_000_000), "microsecondsofsecond": lambda d: cut(d["nanos"], 1000), "nanosecondsofsecond": lambda d: d["nanos"],
    }
    if name not in fns:
        raise CypherTypeError(f"a duration has no {name}")
    return make(lambda d: fns[name](d).cast("long"), v)


def plus(a: Val, b: Val, sign: int) -> Val:
    if b.kind == "duration" and a.kind == "duration":
        return make(lambda x, y: F.when(x.isNotNull() & y.isNotNull(), duration_struct(x["months"] + sign * y["months"], x["days"] + sign * y["days"], x["seconds"] + sign * y["seconds"], x["nanos"] + sign * y["nanos"])), a, b, known=DURATION)
    if a.kind == "duration" and sign > 0:
        return plus(b, a, 1)
    if b.kind == "null" or a.kind == "null":
        return make(lambda x, y: F.lit(None), a, b)
    if b.kind != "duration" or not is_temporal(a.kind):
        raise CypherTypeError(f"{a.kind} and {b.kind} cannot be added")
    if a.kind == "date":
        # Months are clamped to the month's end; the seconds count as whole days.
        return make(lambda x, d: F.date_add(F.add_months(x, (sign * d["months"]).cast("int")), (sign * d["days"] + (sign * d["seconds"] / DAY).cast("long")).cast("int")), a, b)
    if a.kind in ("localtime", "time"):
        return make(lambda x, d: x.withField("nanos_of_day", F.pmod(x["nanos_of_day"] + sign * ((d["seconds"] % DAY) * NANO + d["nanos"]), F.lit(DAY * NANO))), a, b)
    kind = a.kind

    def fn(x: Column, d: Column) -> Column:
        moved = x + F.make_ym_interval(F.lit(0), (sign * d["months"]).cast("int"))
        seconds = (sign * d["seconds"]).cast("decimal(18,6)") + (sign * d["nanos"] / 1000).cast("long").cast("decimal(18,6)") / 1_000_000
        return moved + F.make_dt_interval((sign * d["days"]).cast("int"), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))

    return convert(kind, make(fn, ntz(a), b))


def scale(op: str, a: Val, b: Val) -> Val:
    if b.kind == "duration":
        a, b = b, a
        if op == "/":
            raise CypherTypeError("a number cannot be divided by a duration")

    def fn(d: Column, n: Column) -> Column:
        f = n.cast("double") if op == "*" else F.lit(1.0) / n.cast("double")
        months = d["months"] * f
        days = d["days"] * f + (months - months.cast("long")) * MONTH_DAYS[0] / MONTH_DAYS[1]
        seconds = d["seconds"] * f + (days - days.cast("long")) * DAY
        s = F.floor(seconds)
        return duration_struct(months.cast("long"), days.cast("long"), s, F.round((seconds - s) * NANO + d["nanos"] * f))

    return make(fn, a, b, known=DURATION)


def between(method: str, a: Val, b: Val) -> Val:
    """From a to b: months by the calendar, then days, then seconds; or all in one unit."""
    if "null" in (a.kind, b.kind):
        return make(lambda x, y: F.lit(None), a, b)
    if a.kind in ("localtime", "time") or b.kind in ("localtime", "time"):
        a, b = convert("localtime", a), convert("localtime", b)
        return make(lambda x, y: duration_struct(F.lit(0), F.lit(0), F.lit(0), y["nanos_of_day"] - x["nanos_of_day"]), a, b, known=DURATION)
    micros = lambda x: F.unix_micros(x.cast("timestamp"))

    zero = F.lit(0)

    def months(p: Column) -> Column:
        """The whole months, and the microseconds that are left then."""
        x, y, gap = p["x"], p["y"], p["end"] - p["start"]
        rough = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)
        there = x + F.make_ym_interval(zero, rough.cast("int"))
        over = F.when((gap >= 0) & (there > y), -1).when((gap < 0) & (there < y), 1).otherwise(0)
        return F.struct(x.alias("x"), p["end"].alias("end"), (rough + over).alias("months"))

    def days(p: Column) -> Column:
        rest = p["end"] - micros(p["x"] + F.make_ym_interval(zero, p["months"].cast("int")))
        return F.struct(p["months"].alias("months"), rest.alias("rest"), (rest / (DAY * 1_000_000)).cast("long").alias("days"))

    def whole(p: Column) -> Column:
        left = p["rest"] - p["days"] * DAY * 1_000_000
        return duration_struct(p["months"], p["days"], F.floor(left / 1_000_000), F.pmod(left, F.lit(1_000_000)) * 1000)

    def fn(p: Column) -> Column:
        gap = p["end"] - p["start"]
        if method == "inseconds":
            return duration_struct(zero, zero, F.floor(gap / 1_000_000), F.pmod(gap, F.lit(1_000_000)) * 1000)
        if method == "indays":
            return duration_struct(zero, (gap / (DAY * 1_000_000)).cast("long"), zero, zero)
        if method == "inmonths":
            return let(months(p), lambda q: duration_struct(q["months"], zero, zero, zero))
        return let(let(months(p), days), whole)

    def pair(x: Column, y: Column) -> Column:
        ends = let(F.struct(x.alias("x"), y.alias("y")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), micros(p["x"]).alias("start"), micros(p["y"]).alias("end")))
        return let(ends, lambda p: F.when(p["x"].isNotNull() & p["y"].isNotNull(), fn(p)))

    if method not in ("between", "inmonths", "indays", "inseconds"):
        raise CypherError(f"unknown function duration.{method}")
    return make(pair, ntz(a), ntz(b), known=DURATION)


def offset_text(x: Column) -> Column:
    h, m = F.floor(F.abs(x) / 3600), F.floor(F.abs(x) / 60) % 60
    return F.when(x == 0, "Z").otherwise(F.concat(F.when(x < 0, "-").otherwise("+"), F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("string"), 2, "0")))


def clock_text(nanos: Column) -> Column:
    two = lambda n: F.lpad(n.cast("long").cast("string"), 2, "0")
    hm = F.concat(two(F.floor(nanos / (3600 * NANO))), F.lit(":"), two(F.floor(nanos / (60 * NANO)) % 60))
    s, f = F.floor(nanos / NANO) % 60, nanos % NANO
    fraction = F.when(f == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(f.cast("string"), 9, "0"), "0+$", "")))
    return F.when((s == 0) & (f == 0), hm).otherwise(F.concat(hm, F.lit(":"), two(s), fraction))


def text(v: Val) -> Val:
    """Canonical text."""
    if v.kind == "date":
        return make(lambda x: x.cast("string"), v)
    if v.kind == "localtime":
        return make(lambda x: let(x["nanos_of_day"], clock_text), v, known=T.StringType())
    if v.kind == "time":
        return make(lambda x: let(x, lambda t: F.concat(clock_text(t["nanos_of_day"]), offset_text(t["offset"]))), v, known=T.StringType())
    if v.kind in ("localdatetime", "datetime"):
        tail = "Z" if v.kind == "datetime" else ""

        def stamp(x: Column) -> Column:
            own = Val(x, v.shadow, v.env, v.typer, v.type)
            clock = let(convert("localtime", own).col["nanos_of_day"], clock_text)
            return F.concat(ntz(own).col.cast("date").cast("string"), F.lit("T"), clock, F.lit(tail))

        return make(lambda x: let(x, stamp), v, known=T.StringType())

    def fn(d: Column) -> Column:
        bit = lambda n, unit: F.when(n != 0, F.concat(n.cast("long").cast("string"), F.lit(unit))).otherwise("")
        date = F.concat(bit((d["months"] / 12).cast("long"), "Y"), bit(d["months"] % 12, "M"), bit(d["days"], "D"))
        # Seconds and nanoseconds have one sign in the text.
        total = d["seconds"].cast("decimal(30,0)") * NANO + d["nanos"].cast("decimal(30,0)")
        size = F.abs(total)
        sign = F.when(total < 0, "-").otherwise("")
        h, m = F.floor(size / (3600 * NANO)), F.floor(size / (60 * NANO)) % 60
        s, f = (F.floor(size / NANO) % 60), (size % NANO)
        part = lambda n, unit: F.when(n != 0, F.concat(sign, n.cast("long").cast("string"), F.lit(unit))).otherwise("")
        fraction = F.when(f == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(f.cast("long").cast("string"), 9, "0"), "0+$", "")))
        sec = F.when((s == 0) & (f == 0), "").otherwise(F.concat(sign, s.cast("long").cast("string"), fraction, F.lit("S")))
        time = F.concat(part(h, "H"), part(m, "M"), sec)
        return F.when((date == "") & (time == ""), "PT0S").otherwise(F.concat(F.lit("P"), date, F.when(time == "", "").otherwise(F.concat(F.lit("T"), time))))

    return make(lambda x: let(x, fn), v, known=T.StringType())
