"""Scalar, list, string, numeric and conversion functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import CypherError, CypherTypeError
from . import temporal
from .values import Val, let, make, numeric

#: Code points of Unicode white space, for trim.
SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
RANGE_LIMIT = 1 << 20


def want(v: Val, name: str, *kinds: str) -> None:
    if v.kind not in (*kinds, "null"):
        raise CypherTypeError(f"{name} takes {' or '.join(kinds)}, not {v.kind}")


def null(v: Val) -> Val:
    return make(lambda x: F.lit(None), v)


def add(a: Val, b: Val) -> Val:
    if a.kind == "list" or b.kind == "list":
        if a.kind == b.kind:
            return make(lambda x, y: F.concat(x, y), a, b)
        if a.kind == "list":
            return make(lambda x, y: F.concat(x, F.array(y)), a, b)
        return make(lambda x, y: F.concat(F.array(x), y), a, b)
    if "null" in (a.kind, b.kind):
        return make(lambda x, y: F.lit(None), a, b)
    if a.kind == b.kind == "string":
        return make(lambda x, y: F.concat(x, y), a, b)
    if temporal.is_temporal(a.kind) or temporal.is_temporal(b.kind):
        return temporal.plus(a, b, 1)
    return arithmetic("+", a, b)


def arithmetic(op: str, a: Val, b: Val) -> Val:
    if op == "-" and (temporal.is_temporal(a.kind) or temporal.is_temporal(b.kind)):
        return temporal.plus(a, b, -1)
    if op in "*/" and "duration" in (a.kind, b.kind):
        return temporal.scale(op, a, b)
    if not (numeric(a.kind) and numeric(b.kind)):
        raise CypherTypeError(f"{op} doesn't take {a.kind} and {b.kind}")
    if "null" in (a.kind, b.kind):
        return make(lambda x, y: F.lit(None), a, b)
    whole = a.kind == b.kind == "integer"
    to = "long" if whole else "double"
    if op == "+":
        return make(lambda x, y: x.cast(to) + y.cast(to), a, b)
    if op == "-":
        return make(lambda x, y: x.cast(to) - y.cast(to), a, b)
    if op == "*":
        return make(lambda x, y: x.cast(to) * y.cast(to), a, b)
    if op == "^":
        return make(lambda x, y: F.pow(x.cast("double"), y.cast("double")), a, b)
    if op == "%":
        return make(lambda x, y: x.cast(to) % y.cast(to), a, b)
    if whole:
        return make(lambda x, y: _div(x.cast(to), y.cast(to)), a, b)

    def quotient(x, y):
        x, y = x.cast("double"), y.cast("double")
        inf = F.lit(float("inf"))
        # The sign of a zero divisor counts: 1 / -0.0 is -Infinity.
        negative = (x < 0) != (F.call_function("string", y) == "-0.0")
        by_zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(negative, -inf).otherwise(inf)
        return F.when(y == 0, F.when(x.isNotNull(), by_zero)).otherwise(x / F.when(y != 0, y))

    return make(quotient, a, b)


def _div(x, y):
    """Truncating division; zero is an error and so is the one overflow, as the session is ANSI.

    x - x % y is a multiple of y, so decimal division is exact.
    """
    return ((x - x % y).cast("decimal(20,0)") / y.cast("decimal(20,0)")).cast("long")


def slice_bounds(v: Val, start: Val | None, stop: Val | None) -> Val:
    """Half-open slice with negative and clamped bounds; a null bound gives null."""

    def fn(x, *bounds):
        n = F.size(x)
        it = iter(bounds)
        lo = next(it) if start is not None else F.lit(0)
        hi = next(it) if stop is not None else n
        lo = F.when(lo < 0, F.greatest(lo + n, F.lit(0))).otherwise(F.least(lo, n)).cast("int")
        hi = F.when(hi < 0, F.greatest(hi + n, F.lit(0))).otherwise(F.least(hi, n)).cast("int")
        out = F.slice(x, lo + 1, F.greatest(hi - lo, F.lit(0)))
        for b in bounds:
            out = F.when(b.isNotNull(), out)
        return F.when(x.isNotNull(), out)

    return make(fn, v, *[b for b in (start, stop) if b is not None])


def float_text(x):
    """Shortest digits; an exponent below 1e-4 and from 1e6 on, with a sign and two digits."""

    def shape(parts):
        digits, exp = parts["digits"], parts["exp"]
        head, tail = F.substring(digits, 1, 1), F.substring(digits, F.lit(2), F.char_length(digits))
        power = F.concat(F.when(exp < 0, "e-").otherwise("e+"), F.lpad(F.abs(exp).cast("string"), F.greatest(F.char_length(F.abs(exp).cast("string")), F.lit(2)), F.lit("0")))
        sci = F.concat(head, F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)), power)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
        whole = F.rpad(F.substring(digits, F.lit(1), exp + 1), exp + 1, F.lit("0"))
        rest = F.substring(digits, exp + 2, F.char_length(digits))
        plain = F.when(exp < 0, small).otherwise(F.concat(whole, F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest))))
        return F.concat(parts["sign"], F.when((exp < -4) | (exp >= 6), sci).otherwise(plain))

    def parts(text):
        size = F.regexp_replace(text, "^-", "")
        front, power = F.split_part(size, F.lit("E"), F.lit(1)), F.coalesce(F.split_part(size, F.lit("E"), F.lit(2)).try_cast("int"), F.lit(0))
        whole = F.split_part(front, F.lit("."), F.lit(1))
        raw = F.concat(whole, F.split_part(front, F.lit("."), F.lit(2)))
        led = F.regexp_replace(raw, "^0+", "")
        return F.struct(
            F.when(text.startswith("-"), "-").otherwise("").alias("sign"),
            F.regexp_replace(led, "0+$", "").alias("digits"),
            (F.char_length(whole) - 1 - F.char_length(raw) + F.char_length(led) + power).alias("exp"),
        )

    def text(y):
        special = F.when(F.isnan(y), "NaN").when(y == float("inf"), "+Inf").when(y == float("-inf"), "-Inf")
        zero = F.when(y == 0, F.when(y.cast("string").startswith("-"), "-0").otherwise("0"))
        finite = F.when((y != 0) & ~F.isnan(y) & (F.abs(y) != float("inf")), y)
        return F.coalesce(special, zero, let(let(finite.cast("string"), parts), shape))

    return let(x.cast("double"), text)


#: Number texts: a sign, digits with single underscores nowhere, an exponent; no spaces and no type letters.
INTEGER_TEXT = r"^[+-]?[0-9]+$"
FLOAT_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NAMED_FLOAT = r"^[+-]?(inf|infinity)$"


def parsed_float(x):
    """A float from text, null where it is none or beyond the range of floats."""

    def read(t):
        value = F.when(t.rlike(FLOAT_TEXT), t).try_cast("double")
        named = F.when(F.lower(t) == "nan", F.lit(float("nan"))).when(F.lower(t).rlike(NAMED_FLOAT), F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        return F.coalesce(let(value, lambda y: F.when(F.abs(y) < float("inf"), y)), named)

    return let(x, read)


def to_string(v: Val) -> Val:
    if v.kind in ("string", "null"):
        return make(lambda x: x.cast("string"), v)
    if v.kind in ("integer", "boolean"):
        return make(lambda x: x.cast("string"), v)
    if v.kind == "float":
        return make(float_text, v)
    if temporal.is_temporal(v.kind):
        return temporal.text(v)
    raise CypherTypeError(f"toString doesn't take {v.kind}")


def to_integer(v: Val) -> Val:
    if v.kind == "boolean":
        return make(lambda x: x.cast("long"), v)
    if v.kind in ("integer", "null"):
        return make(lambda x: x.cast("long"), v)
    if v.kind == "float":
        return make(lambda x: x.cast("double").try_cast("long"), v)
    want(v, "toInteger", "string")
    return make(lambda x: F.coalesce(F.when(x.rlike(INTEGER_TEXT), x).try_cast("long"), parsed_float(x).try_cast("long")), v)


def to_float(v: Val) -> Val:
    if v.kind in ("integer", "float", "null"):
        return make(lambda x: x.cast("double"), v)
    want(v, "toFloat", "string")
    return make(parsed_float, v)


def to_boolean(v: Val) -> Val:
    if v.kind in ("boolean", "null"):
        return make(lambda x: x.cast("boolean"), v)
    want(v, "toBoolean", "string")
    return make(lambda x: F.when(F.lower(x).isin("1", "t", "true"), True).when(F.lower(x).isin("0", "f", "false"), False), v)


def span(a: Val, b: Val, step: Val | None) -> Val:
    """Inclusive range; a step that leads away gives an empty list."""

    def fn(x, y, *s):
        s = s[0].cast("long") if s else F.lit(1).cast("long")

        def checked(r):
            x, y, s = r["x"], r["y"], r["s"]
            wide = "decimal(20,0)"
            many = F.floor(F.abs(y.cast(wide) - x.cast(wide)) / F.abs(F.when(s != 0, s)).cast(wide))
            away = ((s > 0) & (x > y)) | ((s < 0) & (x < y))
            wrong = F.when(s == 0, "range: step is zero").when(~away & (many >= RANGE_LIMIT), "range: the result is too large")
            nothing = F.array().cast("array<bigint>")
            full = F.sequence(x, F.when(away, x).otherwise(y), F.when(away | (s == 0), F.lit(1).cast("long")).otherwise(s))
            return F.when(wrong.isNotNull(), F.raise_error(wrong).cast("array<bigint>")).when(away, nothing).otherwise(full)

        return let(F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), s.alias("s")), checked)

    return make(fn, a, b, *([step] if step is not None else []))


def substring(s: Val, start: Val, length: Val | None) -> Val:
    def fn(x, i, *n):
        bad = i < 0
        if n:
            bad = bad | (n[0] < 0)
        checked = F.when(bad, F.raise_error(F.lit("substring: negative position")).cast("int")).otherwise(i.cast("int"))
        size = n[0].cast("int") if n else F.char_length(x)
        return F.substring(x, checked + 1, size)

    return make(fn, s, start, *([length] if length is not None else []))


def replace(s: Val, a: Val, b: Val) -> Val:
    def fn(x, y, z):
        letters = F.filter(F.split(x, ""), lambda c: c != "")
        spread = F.concat(z, F.array_join(F.transform(letters, lambda c: F.concat(c, z)), ""))
        return F.when(y == "", spread).otherwise(F.replace(x, y, z))

    return make(fn, s, a, b)


def split(x, y):
    """Parts between occurrences of y, any signs in which stand for themselves."""
    return F.split(x, F.concat(F.lit("\\Q"), F.replace(y, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))


def size(v: Val) -> Val:
    if v.kind == "string":
        return make(lambda x: F.char_length(x).cast("long"), v)
    if v.kind == "path":
        return make(lambda x: F.size(x["relationships"]).cast("long"), v)
    want(v, "size", "list", "string", "path")
    if v.kind == "null":
        return null(v)
    return make(lambda x: F.when(x.isNotNull(), F.size(x)).cast("long"), v)


def call(name: str, args: list[Val]) -> Val | None:
    """A function by its lower-case name; None if there is none of that name."""
    n = len(args)

    def arity(*allowed: int) -> None:
        if n not in allowed:
            raise CypherError(f"{name} takes {' or '.join(map(str, allowed))} arguments, not {n}")

    a = args[0] if args else None
    if name == "coalesce":
        from .values import unify

        return make(lambda *x: F.coalesce(*x), *unify(args))
    if name in ("size", "length"):
        arity(1)
        return size(a)
    if name == "head":
        arity(1)
        want(a, name, "list")
        return make(lambda x: F.get(x, F.lit(0)), a)
    if name == "last":
        arity(1)
        want(a, name, "list")
        return make(lambda x: F.try_element_at(x, F.lit(-1)), a)
    if name == "tail":
        arity(1)
        want(a, name, "list")
        return make(lambda x: F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), a)
    if name == "reverse":
        arity(1)
        want(a, name, "list", "string")
        return make(lambda x: F.reverse(x), a)
    if name == "range":
        arity(2, 3)
        for x in args:
            want(x, name, "integer")
        return span(args[0], args[1], args[2] if n == 3 else None)
    strings = {"tolower": F.lower, "lower": F.lower, "toupper": F.upper, "upper": F.upper}
    if name in strings:
        arity(1)
        want(a, name, "string")
        return make(strings[name], a)
    if name == "trim":
        arity(1)
        want(a, name, "string")
        return make(lambda x: F.regexp_replace(x, f"^{SPACE}|{SPACE}$", ""), a)
    if name in ("ltrim", "rtrim"):
        arity(1)
        want(a, name, "string")
        fn = F.ltrim if name == "ltrim" else F.rtrim
        return make(lambda x: fn(x, F.lit(" \t\r\n")), a)
    if name == "replace":
        arity(3)
        for x in args:
            want(x, name, "string")
        return replace(*args)
    if name == "split":
        arity(2)
        for x in args:
            want(x, name, "string")
        return make(lambda x, y: F.when(y == "", F.filter(F.split(x, ""), lambda z: z != "")).otherwise(split(x, y)), *args)
    if name == "substring":
        arity(2, 3)
        want(a, name, "string")
        return substring(args[0], args[1], args[2] if n == 3 else None)
    if name == "abs":
        arity(1)
        want(a, name, "integer", "float")
        return make(lambda x: F.abs(x), a)
    if name == "ceil":
        arity(1)
        want(a, name, "integer", "float")
        return make(lambda x: F.ceil(x).cast("double") if a.kind == "integer" else F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), x.cast("double")).otherwise(F.ceil(F.when(F.abs(x) < 2.0**53, x)).cast("double")), a)
    if name == "sqrt":
        arity(1)
        want(a, name, "integer", "float")
        return make(lambda x: F.sqrt(x.cast("double")), a)
    if name == "sign":
        arity(1)
        want(a, name, "integer", "float")
        return make(lambda x: F.when(F.isnan(x.cast("double")), F.lit(0)).otherwise(F.signum(x.cast("double"))).cast("long"), a)
    if name == "tostring":
        arity(1)
        return to_string(a)
    if name == "tointeger":
        arity(1)
        return to_integer(a)
    if name == "tofloat":
        arity(1)
        return to_float(a)
    if name == "toboolean":
        arity(1)
        return to_boolean(a)
    if name == "id" or name == "elementid":
        arity(1)
        want(a, name, "node", "relationship")
        return make(lambda x: x[a.type.fieldNames()[0]], a)
    if name == "labels":
        want(a, name, "node")
        return make(lambda x: x["labels"], a)
    if name == "body":
        want(a, name, "node")
        return make(lambda x: x["body"], a)
    if name == "type":
        want(a, name, "relationship")
        return make(lambda x: x["type"], a)
    if name == "properties":
        if a.kind == "map":
            return a
        want(a, name, "node", "relationship")
        found = make(lambda x: x["props"], a)
        found.sparse = True
        return found
    if name == "keys":
        return keys(a)
    if name in ("nodes", "relationships"):
        want(a, name, "path")
        return make(lambda x: x[name], a)
    return None


def keys(v: Val) -> Val:
    """Sorted names: all of a map's, and of an entity's properties, as itself or as a map, those that are not null."""
    if v.kind in ("node", "relationship"):
        names, base = [f.name for f in v.type["props"].dataType.fields], lambda x: x["props"]
    elif v.kind == "map" and isinstance(v.type, T.StructType):
        names, base = v.type.fieldNames(), lambda x: x
        if not v.sparse:
            return make(lambda x: F.when(x.isNotNull(), F.array(*[F.lit(n) for n in sorted(names)]).cast("array<string>")), v)
    else:
        raise CypherTypeError(f"keys doesn't take {v.kind}")
    return make(lambda x: F.when(x.isNotNull(), F.filter(F.array(*[F.when(base(x)[n].isNotNull(), F.lit(n)) for n in sorted(names)]).cast("array<string>"), lambda k: k.isNotNull())), v)
