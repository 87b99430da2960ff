"""Grouping and aggregation verbs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from verbena import expr as E
from verbena.operators.across import Across, named_expressions, translate_named
from verbena.operators.basic import assign
from verbena.table import Tbl, verb
from verbena.translate import Context, quoted


@verb
def group_by(t: Tbl, /, *args: Any, add: bool = False, **kwargs: Any) -> Tbl:
    """Set the group columns (``add=True``: more of them); keywords are computed first, without groups."""
    names: list[str] = []
    bare = t.with_(group_by=())
    for a in args:
        if isinstance(a, Across):
            bare, made = assign(bare, "group_by", (a,), {})
            names += made
            continue
        name = E.simple_name(a)
        if name is None:
            raise ValueError(f"group_by needs simple columns or keywords, not {E.show(a)}")
        if name not in t.columns:
            raise KeyError(f"no column {name!r}")
        names.append(name)
    if kwargs:
        bare, _ = assign(bare, "group_by", (), kwargs)
        names += list(kwargs)
    groups = (*t.group_by, *names) if add else tuple(names)
    return bare.with_(group_by=tuple(dict.fromkeys(groups)))


@verb
def ungroup(t: Tbl, /) -> Tbl:
    """No groups."""
    return t.with_(group_by=())


@verb
def summarize(t: Tbl, /, *args: Any, **kwargs: Any) -> Tbl:
    """One row for each group, or one in all; the result has no groups and no order."""
    c = t.context("summarize", aggregating=True)
    cols = []
    for name, current, x in named_expressions(t.df, args, kwargs):
        c.where = f"summarize, {name}"
        if name in t.group_by:
            raise ValueError(f"{name!r} is a group column")
        cols.append(translate_named(c, current, x).alias(name))
        c.siblings += (name,)
    if not cols:
        return Tbl(t.df.select(*map(quoted, t.group_by)).distinct())
    df = c.df.groupBy(*map(quoted, t.group_by)).agg(*cols) if t.group_by else c.df.agg(*cols)
    return Tbl(df)


summarise = summarize


def count_name(name: str | None, taken: list[str]) -> str:
    if name is not None:
        if name in taken:
            raise ValueError(f"the name {name!r} is taken; give another")
        return name
    out = "n"
    while out in taken:
        out += "n"
    return out


def counted(t: Tbl, args: tuple, kwargs: dict, verb_name: str) -> tuple[Tbl, list[str]]:
    """The table with all columns to count over, and their names after the groups."""
    names: list[str] = []
    for a in args:
        if isinstance(a, Across):
            t, made = assign(t, verb_name, (a,), {})
            names += made
            continue
        name = E.simple_name(a)
        if name is None:
            raise ValueError(f"{verb_name} needs simple columns or keywords, not {E.show(a)}")
        if name not in t.columns:
            raise AttributeError(f"no column {name!r}")
        names.append(name)
    if kwargs:
        t, _ = assign(t, verb_name, (), kwargs)
        names += list(kwargs)
    return t, list(dict.fromkeys([*t.group_by, *names]))


@verb
def count(t: Tbl, /, *args: Any, wt: Any = None, sort: bool = False, name: str | None = None, **kwargs: Any) -> Tbl:
    """Rows (or the sum of ``wt``) for each combination; the result has no groups."""
    t, over = counted(t, args, kwargs, "count")
    out = count_name(name, over)
    value = F.count(F.lit(1)) if wt is None else F.sum(Context(t.df, where="count").expression(wt))
    df = t.df.groupBy(*map(quoted, over)).agg(value.alias(out))
    return Tbl(df.orderBy(quoted(out).desc(), *map(quoted, over)) if sort else df)


@verb
def add_count(t: Tbl, /, *args: Any, wt: Any = None, sort: bool = False, name: str | None = None, **kwargs: Any) -> Tbl:
    """``count`` as a column on all rows; groups stay."""
    t, over = counted(t, args, kwargs, "add_count")
    out = count_name(name, t.columns)
    c = Context(t.df, tuple(over), where="add_count")
    value = F.count(F.lit(1)) if wt is None else F.sum(Context(t.df, where="add_count").expression(wt))
    col = c.over_group(value)
    done = t.with_(c.df.withColumn(out, col))
    done = done.settle(done.df, [*t.columns, out])
    return done.with_(done.df.orderBy(quoted(out).desc())) if sort else done


@verb
def cube(t: Tbl, /, *args: Any, **kwargs: Any) -> Tbl:
    """``summarize`` over all subsets of the given columns; left-out ones are null."""
    return levels(t, "cube", args, kwargs)


@verb
def rollup(t: Tbl, /, *args: Any, **kwargs: Any) -> Tbl:
    """``summarize`` over the given columns from the left, step by step fewer."""
    return levels(t, "rollup", args, kwargs)


def levels(t: Tbl, how: str, args: tuple, kwargs: dict) -> Tbl:
    names = [E.simple_name(a) for a in args]
    c = Context(t.df, tuple(names), where=how, aggregating=True)
    cols = [c.expression(x).alias(k) for k, x in kwargs.items()]
    return Tbl(getattr(c.df, how)(*map(quoted, names)).agg(*cols))


def group_apply(func: Any, schema: Any) -> Any:
    """A step: a pandas function for each group, by Arrow. Each group must fit in one task's memory."""
    from verbena.table import Pipe, as_tbl

    def step(data: Any) -> Tbl:
        t = as_tbl(data)
        return Tbl(t.to_spark().groupBy(*map(quoted, t.group_by)).applyInPandas(func, schema))

    return Pipe(step)
