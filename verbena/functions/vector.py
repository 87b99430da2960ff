"""Vector functions: ranks, neighbours, running values and small helpers."""

from __future__ import annotations

import warnings
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbena.functions.registry import FROM_HERE, TABLE, UP_TO_HERE, column_function, distinct_count, lit

WHOLE = (UP_TO_HERE[0], FROM_HERE[1])


@column_function("window")
def cumall(c, x):
    """True while all so far are true."""
    return c.over_order(F.bool_and(lit(x)), UP_TO_HERE)


@column_function("window")
def cumany(c, x):
    """True once any so far is true."""
    return c.over_order(F.bool_or(lit(x)), UP_TO_HERE)


@column_function("window")
def cummean(c, x):
    """Running mean of the values that are there."""
    return c.over_order(F.avg(lit(x)), UP_TO_HERE)


class Descending:
    """A column in descending order: a mark for ``arrange``, ranks and ``order_by``."""

    def __init__(self, col: Any):
        self.col = lit(col)


def ranked(f: Any, name: str) -> Any:
    def impl(c: Any, x: Any, na_option: str | None = "keep") -> Column:
        own, descending = order_of(x)
        if na_option not in (None, "keep"):
            raise c.error(f"{name}: na_option {na_option!r} is not supported")
        order = [own.desc_nulls_last() if descending else own.asc_nulls_last()]
        if na_option is None:
            return c.over_order(f(), own_order=order)
        return F.when(own.isNotNull(), c.over_order(f(), partition=(own.isNull(),), own_order=order))

    impl.__name__, impl.__doc__ = name, f"{name} by value within the group; nulls have no rank unless ``na_option=None``."
    return column_function("window")(impl)


def order_of(x: Any) -> tuple[Column, bool]:
    """A column without its descending mark, and whether it had one."""
    return (x.col, True) if isinstance(x, Descending) else (lit(x), False)


@column_function("elwise")
def desc(c, x):
    """Descending order, for ``arrange``, ranks and ``order_by``."""
    return Descending(x)


dense_rank = ranked(F.dense_rank, "dense_rank")
min_rank = ranked(F.rank, "min_rank")
percent_rank = ranked(F.percent_rank, "percent_rank")
cume_dist = ranked(F.cume_dist, "cume_dist")


@column_function("window")
def row_number(c, x=TABLE):
    """1, 2, ... in arrange order within the group."""
    return c.over_order(F.row_number())


@column_function("window")
def ntile(c, x, n):
    """Which of ``n`` even parts, by value."""
    own, descending = order_of(x)
    return c.over_order(F.ntile(n), own_order=[own.desc_nulls_last() if descending else own.asc_nulls_last()])


@column_function("elwise")
def between(c, x, left, right, default=None):
    """From ``left`` to ``right``, both included."""
    out = lit(x).between(lit(left), lit(right))
    return out if default is None else F.coalesce(out, lit(default))


@column_function("elwise")
def coalesce(c, x, *args):
    """The first value that is there."""
    return F.coalesce(lit(x), *map(lit, args))


@column_function("window")
def lead(c, x, n=1, default=None):
    """The value ``n`` rows on."""
    return c.over_order(F.lead(lit(x), n, default))


@column_function("window")
def lag(c, x, n=1, default=None):
    """The value ``n`` rows back."""
    return c.over_order(F.lag(lit(x), n, default))


@column_function("agg")
def n(c, x=TABLE):
    """Rows in the group, nulls included."""
    return c.agg(F.count(F.lit(1)))


@column_function("agg")
def n_distinct(c, x):
    """Distinct values, nulls not counted."""
    return distinct_count(c, x)


@column_function("elwise")
def na_if(c, x, y):
    """Null where ``x`` is ``y`` (or one of a list)."""
    if isinstance(y, (list, tuple, set)):
        return F.when(~lit(x).isin(*y) | lit(x).isNull(), lit(x))
    return F.nullif(lit(x), lit(y))


@column_function("elwise")
def near(c, x, y, tol=1.5e-8):
    """Equal but for rounding."""
    return F.abs(lit(x) - lit(y)) < lit(tol)


def position(c: Any, x: Any, n: int, order_by: Any, default: Any) -> Column:
    if default is not None:
        raise c.error("nth: default is not supported")
    if c.aggregating:
        return nth_of_group(c, lit(x), n, order_by)
    x = lit(x)
    if order_by is not None:
        own, descending = order_of(order_by)
    if n >= 0:
        order = None if order_by is None else [own.desc_nulls_last() if descending else own.asc_nulls_last()]
        return c.over_order(F.nth_value(x, n + 1), WHOLE, own_order=order)
    if order_by is not None:
        order = [own.asc_nulls_first() if descending else own.desc_nulls_first()]
    elif c.order:
        order = [F.col(f"`{k.name}`").asc_nulls_first() if k.descending else F.col(f"`{k.name}`").desc_nulls_first() for k in c.order]
    else:
        raise c.error("nth with a negative n needs order_by or arrange()")
    return c.over_order(F.nth_value(x, -n), WHOLE, own_order=order)


def nth_of_group(c: Any, x: Column, n: int, order_by: Any) -> Column:
    """The value whose row number in the group is ``n`` + 1, from the end if ``n`` is negative."""
    if order_by is not None:
        own, descending = order_of(order_by)
        keys = [(own, descending)]
    elif c.order:
        keys = [(F.col(f"`{k.name}`"), k.descending) for k in c.order]
    else:
        raise c.error("nth in summarize needs order_by or arrange()")
    if n >= 0:
        order = [k.desc_nulls_last() if d else k.asc_nulls_last() for k, d in keys]
    else:
        order = [k.asc_nulls_first() if d else k.desc_nulls_first() for k, d in keys]
    at = c.stage(c.over_order(F.row_number(), own_order=order))
    return F.max(F.when(at == (n + 1 if n >= 0 else -n), x))


@column_function("agg")
def nth(c, x, n, order_by=None, default=None):
    """The value at place ``n`` (from 0; negative from the end)."""
    return position(c, x, n, order_by, default)


def edge(name: str, low: bool) -> Any:
    def impl(c: Any, x: Any, order_by: Any = None, default: Any = None) -> Column:
        if not c.aggregating:
            return position(c, x, 0 if low else -1, order_by, default)
        if default is not None:
            raise c.error(f"{name}: default is not supported")
        if order_by is None:
            if not c.order:
                warnings.warn(f"{name}: the result depends on row order; use arrange() or order_by", RuntimeWarning, stacklevel=2)
                return F.first(lit(x)) if low else F.last(lit(x))
            key, descending = F.col(f"`{c.order[0].name}`"), c.order[0].descending
            if len(c.order) > 1:
                place = c.stage(c.over_order(F.row_number()))
                key, descending = place, False
        else:
            key, descending = order_of(order_by)
        return (F.min_by if low != descending else F.max_by)(lit(x), key)

    impl.__name__, impl.__doc__ = name, f"The {name} value in ``order_by`` or arrange order."
    return column_function("agg")(impl)


first = edge("first", True)
last = edge("last", False)


@column_function("elwise")
def if_else(c, condition, true, false):
    """``true`` where the condition holds, else ``false`` (a null condition too)."""
    values = [v for v in (true, false) if v is not None]
    kind = c.common_type(values)
    a, b = (v if v is None else lit(v).cast(kind) if kind is not None else lit(v) for v in (true, false))
    return F.when(lit(condition), lit(a)).otherwise(lit(b))


def case_when(cases: Any, *rest: Any) -> Any:
    """The value of the first condition that holds; ``True`` as a condition is the default, else null."""
    from verbena.expr import Cases, Symbolic, strip

    if not isinstance(cases, dict):
        cases = rest[0] if rest and isinstance(rest[0], dict) else None
    if cases is None:
        raise TypeError("case_when takes a dict of condition: value")
    return Symbolic(Cases(tuple((strip(k), strip(v)) for k, v in cases.items())))
