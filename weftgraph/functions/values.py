"""Typed values of the compiler, their kinds and comparisons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import CypherTypeError
from ..sources.graph import NODE, REL

DURATION = T.StructType([T.StructField("months", T.LongType()), T.StructField("days", T.LongType()), T.StructField("seconds", T.LongType()), T.StructField("nanos", T.LongType())])
LOCAL_TIME = T.StructType([T.StructField("nanos_of_day", T.LongType())])
OFFSET_TIME = T.StructType([T.StructField("nanos_of_day", T.LongType()), T.StructField("offset", T.IntegerType())])
EXACT = 1 << 53


def kind_of(t: T.DataType) -> str:
    """Cypher kind of a Spark type."""
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, T.TimestampNTZType):
        return "localdatetime"
    if isinstance(t, T.TimestampType):
        return "datetime"
    if isinstance(t, T.ArrayType):
        return "list"
    if isinstance(t, T.StructType):
        names = t.fieldNames()
        if names[:1] == [NODE]:
            return "node"
        if names[:1] == [REL]:
            return "relationship"
        if names == ["nodes", "relationships"]:
            return "path"
        if names == ["months", "days", "seconds", "nanos"]:
            return "duration"
        if names == ["nanos_of_day"]:
            return "localtime"
        if names == ["nanos_of_day", "offset"]:
            return "time"
        return "map"
    if isinstance(t, T.MapType):
        return "map"
    if isinstance(t, T.BinaryType):
        return "bytes"
    return "any"


class Typer:
    """Finds the type of a column over a schema by analysing it on no rows."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.frames: dict[str, object] = {}

    def type_of(self, column: Column, env: T.StructType) -> T.DataType:
        key = env.json()
        if key not in self.frames:
            if len(self.frames) > 500:
                self.frames.clear()
            self.frames[key] = self.spark.createDataFrame([], env)
        return self.frames[key].select(column.alias("x")).schema[0].dataType


@dataclass
class Val:
    """A column, and the same over plain columns, where its type can be asked.

    Inside a lambda the two differ: the lambda's variable has no type of its own.
    """

    col: Column
    shadow: Column
    env: T.StructType
    typer: Typer
    known: T.DataType | None = None
    constant: object = None
    is_constant: bool = False
    #: Whether fields that are null are absent, as in the map of an entity's properties.
    sparse: bool = False

    @cached_property
    def type(self) -> T.DataType:
        return self.known or self.typer.type_of(self.shadow, self.env)

    @property
    def kind(self) -> str:
        return kind_of(self.type)


def make(fn: Callable[..., Column], *vals: Val, known: T.DataType | None = None) -> Val:
    """fn over the columns of vals."""
    col = fn(*[v.col for v in vals])
    shadow = col if all(v.col is v.shadow for v in vals) else fn(*[v.shadow for v in vals])
    wide = max(vals, key=lambda v: len(v.env.fields))
    return Val(col, shadow, wide.env, wide.typer, known)


def let(x: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, and stands once in the plan, however often fn reads it."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def numeric(kind: str) -> bool:
    return kind in ("integer", "float", "null")


def exact_pair(a: Val, b: Val) -> Callable[[Column, Column, Callable], Column] | None:
    """How an integer and a float are compared without losing digits, or None if no care is needed."""
    kinds = (a.kind, b.kind)
    if set(kinds) != {"integer", "float"}:
        return None

    def compare(x: Column, y: Column, op: Callable[[Column, Column], Column]) -> Column:
        whole, real = (x, y) if kinds[0] == "integer" else (y, x)
        big = F.abs(real) >= EXACT
        inside = big & (F.abs(real) < 9.2233720368547e18)
        as_long = F.when(inside, real).otherwise(F.lit(0.0)).cast("long")
        exact = op(whole, as_long) if kinds[0] == "integer" else op(as_long, whole)
        plain = op(x.cast("double"), y.cast("double"))
        return F.when(inside, exact).otherwise(plain)

    return compare


def equal(a: Val, b: Val) -> Val:
    """Three-valued structural equality."""
    ka, kb = a.kind, b.kind
    if "null" in (ka, kb):
        return make(lambda x, y: F.lit(None).cast("boolean"), a, b)
    if numeric(ka) and numeric(kb):
        if care := exact_pair(a, b):
            fn = lambda x, y: care(x, y, lambda p, q: p == q)
        elif ka == "float":
            fn = lambda x, y: (x == y) & ~F.isnan(x)
        else:
            fn = lambda x, y: x == y
        return make(fn, a, b)
    if ka != kb:
        return make(lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.lit(False)), a, b)
    if ka in ("node", "relationship"):
        name = NODE if ka == "node" else REL
        return make(lambda x, y: x[name] == y[name], a, b)
    if ka == "list":
        return list_equal(a, b)
    if ka == "map" and isinstance(a.type, T.StructType) and isinstance(b.type, T.StructType):
        if sorted(a.type.fieldNames()) != sorted(b.type.fieldNames()):
            return make(lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.lit(False)), a, b)
        parts = [equal(field(a, n), field(b, n)) for n in a.type.fieldNames()]
        if not parts:
            return make(lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.lit(True)), a, b)
        out = parts[0]
        for p in parts[1:]:
            out = make(lambda x, y: x & y, out, p)
        return make(lambda x, y, z: F.when(x.isNotNull() & y.isNotNull(), z), a, b, out)
    return make(lambda x, y: x == y, a, b)


def field(v: Val, name: str) -> Val:
    return make(lambda x: x.getField(name), v)


def element(v: Val, name: str) -> tuple[Val, Callable[[Column], Val]]:
    """A stand-in for an element of a list value, and how to put a lambda's column in its place."""
    t = v.type.elementType
    env = T.StructType([*v.env.fields, T.StructField(name, t)])
    shadow = F.col(f"`{name}`")
    return Val(shadow, shadow, env, v.typer, t), lambda col: Val(col, shadow, env, v.typer, t)


def list_equal(a: Val, b: Val) -> Val:
    """False on different lengths or a pair that differs; else null if a pair is null."""
    ea, eb = a.type.elementType, b.type.elementType
    if isinstance(ea, T.NullType) or isinstance(eb, T.NullType):
        return make(lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.when(F.size(x) != F.size(y), False).when(F.size(x) == 0, True)), a, b)
    pair_name = f"__pair{len(a.env.fields)}"
    zipped = make(lambda x, y: F.arrays_zip(x.alias("p"), y.alias("q")), a, b)
    one, put = element(zipped, pair_name)

    def fn(x: Column, y: Column, z: Column) -> Column:
        def test(w: Column) -> Column:
            v = put(w)
            names = v.type.fieldNames()
            return equal(field(v, names[0]), field(v, names[1])).col

        return F.when(F.size(x) != F.size(y), F.lit(False)).otherwise(F.forall(z, test))

    return make(fn, a, b, zipped, known=T.BooleanType())


def less(op: str, a: Val, b: Val) -> Val:
    """Ordering predicates: null where values are not comparable, false with NaN."""
    signs = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    fn = signs[op]
    ka, kb = a.kind, b.kind
    nothing = lambda *_: F.lit(None).cast("boolean")
    if "null" in (ka, kb) or (ka != kb and not (numeric(ka) and numeric(kb))):
        return make(nothing, a, b)
    if numeric(ka):
        real = [k == "float" for k in (ka, kb)]
        care = exact_pair(a, b)

        def number(x: Column, y: Column) -> Column:
            out = care(x, y, fn) if care else fn(x, y)
            if any(real):
                bad = F.lit(False)
                for v, r in zip((x, y), real, strict=True):
                    bad = bad | (F.isnan(v) if r else F.lit(False))
                out = F.when(bad, F.lit(False)).otherwise(out)
            return F.when(x.isNotNull() & y.isNotNull(), out)

        return make(number, a, b)
    if ka in ("duration", "map", "node", "relationship", "path"):
        return make(nothing, a, b)
    return make(fn, a, b)


def sort_key(v: Val) -> Val:
    """A column whose Spark order is the total order of the values."""
    if v.kind == "duration":
        average = 2_629_746
        return make(lambda d: F.when(d.isNotNull(), F.struct((d["months"] * average + d["days"] * 86_400 + d["seconds"]).alias("s"), d["nanos"].alias("n"))), v)
    if v.kind in ("node", "relationship"):
        return make(lambda x: x.getField(NODE if v.kind == "node" else REL), v)
    if v.kind == "list" and not isinstance(v.type.elementType, T.NullType):
        # A null element sorts after all others.
        return make(lambda x: F.transform(x, lambda y: F.struct(y.isNull().alias("none"), y.alias("value"))), v)
    return v


def unify(vals: list[Val]) -> list[Val]:
    """The values with one common type; mixed integers and floats become floats."""
    kinds = {v.kind for v in vals} - {"null"}
    if kinds == {"integer", "float"}:
        return [make(lambda x: x.cast("double"), v) for v in vals]
    if kinds == {"integer"}:
        return [make(lambda x: x.cast("long"), v) for v in vals]
    if len(kinds) > 1:
        raise CypherTypeError(f"values of kinds {', '.join(sorted(kinds))} cannot share a column")
    typed = next((v.type for v in vals if v.kind != "null"), None)
    return [make(lambda x: x.cast(typed), v) if typed is not None and v.kind == "null" else v for v in vals]
