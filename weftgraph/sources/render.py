"""Results as text: tables, JSON and JSON lines, with tags for values that JSON lacks."""

from __future__ import annotations

import base64
import datetime as dt
import json
import math
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row

from .graph import NODE, REL


def _clock(nanos: int) -> str:
    s, f = divmod(nanos, 1_000_000_000)
    text = f"{s // 3600:02}:{s // 60 % 60:02}"
    if s % 60 or f:
        text += f":{s % 60:02}" + (f".{f:09}".rstrip("0") if f else "")
    return text


def _offset(seconds: int) -> str:
    if not seconds:
        return "Z"
    return f"{'-' if seconds < 0 else '+'}{abs(seconds) // 3600:02}:{abs(seconds) // 60 % 60:02}"


def duration_text(months: int, days: int, seconds: int, nanos: int) -> str:
    date = "".join(f"{n}{u}" for n, u in ((int(months / 12), "Y"), (int(math.fmod(months, 12)), "M"), (days, "D")) if n)
    total = seconds * 1_000_000_000 + nanos
    sign, size = ("-" if total < 0 else ""), abs(total)
    s, f = divmod(size, 1_000_000_000)
    time = "".join(f"{sign}{n}{u}" for n, u in ((s // 3600, "H"), (s // 60 % 60, "M")) if n)
    if s % 60 or f:
        time += f"{sign}{s % 60}" + (f".{f:09}".rstrip("0") if f else "") + "S"
    return f"P{date}{'T' + time if time else ''}" if date or time else "PT0S"


def plain(value):
    """A value as JSON data; what JSON has no form for becomes an object with one tag."""
    if isinstance(value, Row):
        d = value.asDict()
        names = list(d)
        if names[:1] == [NODE]:
            props = {k: plain(v) for k, v in (d["props"].asDict() if d["props"] else {}).items() if v is not None}
            return {"id": d[NODE], "labels": d["labels"], "properties": props, "body": d["body"]}
        if names[:1] == [REL]:
            props = {k: plain(v) for k, v in (d["props"].asDict() if d["props"] else {}).items() if v is not None}
            return {"id": d[REL], "from": d["from_id"], "type": d["type"], "to": d["to_id"], "position": d["position"], "properties": props}
        if names == ["months", "days", "seconds", "nanos"]:
            return {"$cypher_duration": duration_text(*value)}
        if names == ["nanos_of_day"]:
            return {"$local_time": _clock(value[0])}
        if names == ["nanos_of_day", "offset"]:
            return {"$offset_time": _clock(value[0]) + _offset(value[1])}
        return {k: plain(v) for k, v in d.items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else {"$float": "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"}
    if isinstance(value, dt.datetime):
        text = value.replace(tzinfo=None).isoformat()
        return {"$zoned_datetime": text + "Z"} if value.tzinfo else {"$local_datetime": text}
    if isinstance(value, dt.date):
        return {"$date": value.isoformat()}
    if isinstance(value, (bytes, bytearray)):
        return {"$bytes": base64.b64encode(bytes(value)).decode()}
    return float(value)


def parse_json(text: str):
    """JSON parameters: no duplicate keys at any level, and tags for dates, bytes and special floats."""

    def build(pairs: list[tuple[str, object]]):
        d = {}
        for k, v in pairs:
            if k in d:
                raise ValueError(f"duplicate key {k!r}")
            d[k] = v
        if len(d) == 1:
            tag, v = next(iter(d.items()))
            if tag == "$date":
                return dt.date.fromisoformat(v)
            if tag == "$local_datetime":
                return dt.datetime.fromisoformat(v)
            if tag == "$zoned_datetime":
                return dt.datetime.fromisoformat(v)
            if tag == "$bytes":
                return base64.b64decode(v)
            if tag == "$float":
                return float(v)
        return d

    return json.loads(text, object_pairs_hook=build)


def json_lines(df: DataFrame) -> Iterator[str]:
    """The header, a line per row and the end, one partition at a time."""
    yield json.dumps({"columns": df.columns})
    n = 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        n += 1
        yield json.dumps({"row": [plain(v) for v in row]}, ensure_ascii=False)
    yield json.dumps({"rows": n})


def as_json(df: DataFrame) -> str:
    return json.dumps({"columns": df.columns, "rows": [[plain(v) for v in r] for r in df.collect()]}, ensure_ascii=False)


def as_table(columns: list[str], rows: Iterable) -> str:
    """A table of aligned cells."""
    cells = [[v if isinstance(v, str) else json.dumps(plain(v), ensure_ascii=False) for v in r] for r in rows]
    width = [max([len(n), *(len(r[k]) for r in cells)]) for k, n in enumerate(columns)]
    line = lambda r: " | ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip()
    return "\n".join([line(columns), "-+-".join("-" * w for w in width), *map(line, cells)])
