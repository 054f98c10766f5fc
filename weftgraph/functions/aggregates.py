"""Aggregates with the language's own rules for nulls, empty groups and overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.errors import CypherError, CypherTypeError
from .values import Val, sort_key


def build(call, args: list[Val], compiler, order: list[tuple[Column, bool]] = ()) -> Column:
    """An aggregate's column; ``order`` has the keys, and whether they fall, by which the rows came in."""
    name = call.name
    if call.star:
        return F.count(F.lit(1))
    v = args[0]
    if name == "count":
        return F.count_distinct(v.col) if call.distinct else F.count(v.col)
    if name == "collect":
        if order:
            values = collected_in_order(v.col, order)
            return F.array_distinct(values) if call.distinct else values
        return F.collect_set(v.col) if call.distinct else F.collect_list(v.col)
    if name in ("sum", "avg", "stdev", "stdevp", "percentilecont", "percentiledisc"):
        if v.kind not in ("integer", "float", "null"):
            raise CypherTypeError(f"{name} takes numbers, not {v.kind}")
        col = v.col.cast("double") if v.kind != "integer" else v.col
    if name == "sum":
        if v.kind == "integer":
            # Exact in decimals; a sum beyond 64 bits is an error here, as a column has one type.
            total = (F.sum_distinct if call.distinct else F.sum)(col.cast("decimal(20,0)"))
            return F.coalesce(total.cast("long"), F.lit(0).cast("long"))
        return F.coalesce((F.sum_distinct if call.distinct else F.sum)(col), F.lit(0.0))
    if name == "avg":
        if call.distinct:
            # Sum and count of the distinct values: Spark has no distinct average in the function API.
            return F.sum_distinct(col.cast("double")) / F.nullif(F.count_distinct(col), F.lit(0))
        return F.avg(col.cast("double"))
    if name in ("stdev", "stdevp"):
        x = col.cast("double")
        if call.distinct:
            return distinct_deviation(distinct_doubles(v), name == "stdevp")
        if name == "stdevp":
            return F.stddev_pop(x)
        return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))
    if name in ("min", "max"):
        fn, by = (F.min, F.min_by) if name == "min" else (F.max, F.max_by)
        return by(v.col, sort_key(v).col) if v.kind in ("duration", "node", "relationship") else fn(v.col)
    p = compiler.constant(call.args[1])
    if not 0 <= p <= 1:
        raise CypherError(f"{name} takes a share from 0 to 1")
    x = col.cast("double")
    if call.distinct:
        return distinct_percentile(F.array_sort(distinct_doubles(v)), float(p), name == "percentilecont")
    if name == "percentilecont":
        return F.percentile(x, F.lit(float(p)))
    ordered = F.array_sort(F.collect_list(x))
    return F.try_element_at(ordered, (F.ceil(F.lit(float(p)) * (F.count(x) - 1)) + 1).cast("int"))


def collected_in_order(value: Column, order: list[tuple[Column, bool]]) -> Column:
    """The values of a group, not null, by their keys: nulls last, or first where a key falls."""
    row = F.struct(value.alias("v"), *[k.alias(f"k{n}") for n, (k, _) in enumerate(order)])

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for n, (_, falls) in reversed(list(enumerate(order))):
            x, y, up = a[f"k{n}"], b[f"k{n}"], F.lit(-1 if falls else 1)
            later = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), up).when(y.isNull(), -up)
            out = later.when(x > y, up).when(x < y, -up).otherwise(out)
        return out

    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), row)), compare), lambda r: r["v"])


def distinct_doubles(v: Val) -> Column:
    """Integers are told apart before they become floats, and there is one zero."""
    x = v.col.cast("double")
    return F.collect_set(v.col if v.kind == "integer" else F.when(x == 0, F.lit(0.0)).otherwise(x)).cast("array<double>")


def distinct_deviation(values: Column, whole: bool) -> Column:
    n = F.size(values)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    mean = total(values) / n
    squares = total(F.transform(values, lambda x: (x - mean) * (x - mean)))
    if whole:
        return F.when(n > 0, F.sqrt(squares / n))
    return F.when(n == 1, F.lit(0.0)).when(n > 1, F.sqrt(squares / (n - 1)))


def distinct_percentile(ordered: Column, p: float, between: bool) -> Column:
    """Of sorted values, as the plain forms below: interpolated, or the value at a place rounded up."""
    n = F.size(ordered)
    at = F.lit(p) * (n - 1)
    if not between:
        return F.try_element_at(ordered, (F.ceil(at) + 1).cast("int"))
    low = F.try_element_at(ordered, (F.floor(at) + 1).cast("int"))
    high = F.try_element_at(ordered, (F.ceil(at) + 1).cast("int"))
    return F.when(n > 0, low + (high - low) * (at - F.floor(at)))
