"""Projection, filter, order and row-count verbs."""

from __future__ import annotations

import warnings
from typing import Any

from pyspark.sql import functions as F

from verbena import expr as E
from verbena.functions.vector import Descending
from verbena.operators.across import Across, named_expressions, translate_named
from verbena.table import Tbl, verb
from verbena.tidyselect import select as tidyselect
from verbena.translate import Key, hidden_name, quoted


def renamed(t: Tbl, chosen: list[tuple[str, str]]) -> Tbl:
    """Only the chosen columns under their new names; groups and order follow."""
    new = dict(chosen)
    cols = [quoted(o).alias(n) for o, n in chosen]
    order: list[Key] = []
    for k in t.order_by:
        if k.name in new:
            order.append(Key(new[k.name], k.descending))
        else:  # an order key that is no longer shown goes on as a hidden column
            h = k.name if k.name not in t.columns else hidden_name()
            cols.append(quoted(k.name).alias(h))
            order.append(Key(h, k.descending))
    return Tbl(t.df.select(*cols), tuple(new.get(g, g) for g in t.group_by), tuple(order))


@verb
def select(t: Tbl, /, *args: Any, **kwargs: Any) -> Tbl:
    """Keep and rename columns; group columns always stay."""
    if kwargs:
        raise NotImplementedError("select takes no keywords; rename with _.new == _.old")
    chosen = tidyselect(t.df, *args)
    lost = [g for g in t.group_by if g not in dict(chosen)]
    if lost:
        warnings.warn(f"adding the group columns {', '.join(lost)}", stacklevel=3)
        chosen = [(g, g) for g in lost] + chosen
    return renamed(t, chosen)


@verb
def rename(t: Tbl, /, **kwargs: Any) -> Tbl:
    """``new=_.old``: rename in place."""
    new: dict[str, str] = {}
    for name, old in kwargs.items():
        source = E.simple_name(old)
        if source is None:
            raise ValueError(f"rename needs simple columns, not {E.show(old)}")
        if source not in t.columns:
            raise KeyError(f"no column {source!r}")
        new[source] = name
    return renamed(t, [(c, new.get(c, c)) for c in t.columns])


def freeze_order(t: Tbl, name: str) -> Tbl:
    """Before ``name`` is overwritten: its old values stay as a hidden order key."""
    if name not in {k.name for k in t.order_by}:
        return t
    h = hidden_name()
    return t.with_(t.df.withColumn(h, quoted(name)), order_by=tuple(Key(h, k.descending) if k.name == name else k for k in t.order_by))


def independent(t: Tbl, kwargs: dict) -> list[dict]:
    """The arguments in runs that can be translated at once: none uses, or overwrites, what an earlier one of its run makes."""
    runs: list[dict] = []
    for name, x in kwargs.items():
        node = E.node_of(x)
        plain = not callable(node) and not any(isinstance(n, E.Raw) or isinstance(n, E.Root) and n.kind == "_" and node is n for n in E.walk(node))
        used = E.columns_used(node)
        ordered = name in t.columns  # a column that is there may be an order key, or be read by a neighbour
        if runs and plain and not ordered and runs[-1] is not None and not used & set(runs[-1]) and not set(runs[-1]) & set(t.columns) and runs[-1].get("\0") is None:
            runs[-1][name] = x
        else:
            runs.append({name: x} if plain else {name: x, "\0": True})
    return [{k: v for k, v in r.items() if k != "\0"} for r in runs]


def assign(t: Tbl, verb_name: str, args: tuple, kwargs: dict) -> tuple[Tbl, list[str]]:
    """Add columns one after the other, so that later ones see earlier ones."""
    made: list[str] = []
    groups = t.group_by
    # all of one across() see the columns as they were before it, and so do neighbours that use nothing of each other
    for a in (*args, *independent(t, kwargs)):
        parts = named_expressions(t.df, (), a) if isinstance(a, dict) else named_expressions(t.df, (a,), {})
        if not isinstance(a, (dict, Across)):
            made.append(parts[0][0])
            if parts[0][0] not in t.columns:
                raise AttributeError(f"no column {parts[0][0]!r}")
            continue
        c = t.context("")
        cols = {}
        for name, current, x in parts:
            c.where = f"{verb_name}, {name}"
            cols[name] = translate_named(c, current, x)
        t = t.with_(c.df)
        for name in cols:
            t = freeze_order(t, name)
        t = t.with_(t.df.withColumns(cols))
        made += list(cols)
    return t.settle(t.df, group_by=groups), made


@verb
def mutate(t: Tbl, /, *args: Any, **kwargs: Any) -> Tbl:
    """Add or overwrite columns; aggregates are computed over each group and put on all its rows."""
    return assign(t, "mutate", args, kwargs)[0]


@verb
def transmute(t: Tbl, /, *args: Any, **kwargs: Any) -> Tbl:
    """Like ``mutate``, but keep only the named and the group columns."""
    out, made = assign(t, "transmute", args, kwargs)
    keep = [*out.group_by, *[m for i, m in enumerate(made) if m not in out.group_by and m not in made[:i]]]
    return renamed(out, [(k, k) for k in keep])


@verb
def filter(t: Tbl, /, *args: Any) -> Tbl:
    """Rows for which all conditions hold; aggregates and ranks are taken within the groups."""
    c = t.context("filter")
    parts: list[tuple[str | None, Any]] = []
    for a in args:
        parts += [(cur, x) for _, cur, x in a.expand(t.df)] if isinstance(a, Across) else [(None, a)]
    cols = [translate_named(c, cur, x) for cur, x in parts]
    if not cols:
        return t
    if c.used_windows:  # windows can't stand in a WHERE
        names = [hidden_name() for _ in cols]
        df = c.df.withColumns(dict(zip(names, cols, strict=True)))
        cols = [F.col(n) for n in names]
    else:
        df = c.df
    condition = cols[0]
    for x in cols[1:]:
        condition = condition & x
    return t.settle(df.filter(condition), t.columns)


def order_keys(t: Tbl, args: tuple) -> tuple[Tbl, tuple[Key, ...]]:
    """The arrange keys as columns, hidden ones where they are expressions."""
    keys: list[Key] = []
    c = t.context("arrange")
    for a in args:
        if isinstance(a, Across):
            raise NotImplementedError("arrange takes no across()")
        x, descending = E.node_of(a), False
        while isinstance(x, E.Op) and x.name == "__neg__":
            x, descending = x.args[0], not descending
        name = E.simple_name(x)
        if name is not None:
            c.column(name)
        else:
            value = c.term(x).value
            if isinstance(value, Descending):
                value, descending = value.col, not descending
            name = hidden_name()
            c.df = c.df.withColumn(name, value if not isinstance(value, (str, int, float)) else F.lit(value))
        keys.append(Key(name, descending))
    return t.with_(c.df), tuple(keys)


@verb
def arrange(t: Tbl, /, *args: Any) -> Tbl:
    """Sort all rows (nulls last either way); running functions follow this order. Replaces an earlier order."""
    out, keys = order_keys(t, args)
    out = out.settle(out.df, t.columns, order_by=keys)
    return out.with_(out.df.orderBy(*[k.column() for k in keys])) if keys else out


@verb
def head(t: Tbl, /, n: int = 5) -> Tbl:
    """The first ``n`` rows of the whole table."""
    return t.with_(t.df.limit(n))


@verb
def tail(t: Tbl, /, n: int = 5) -> Tbl:
    """The last ``n`` rows in arrange order."""
    if not t.order_by:
        raise NotImplementedError("tail needs arrange() first")
    back = [quoted(k.name).asc_nulls_first() if k.descending else quoted(k.name).desc_nulls_first() for k in t.order_by]
    return t.with_(t.df.orderBy(*back).limit(n).orderBy(*[k.column() for k in t.order_by]))


@verb
def sample_rows(t: Tbl, /, fraction: float, seed: int = 0) -> Tbl:
    """A random share of the rows."""
    return t.with_(t.df.sample(fraction=fraction, seed=seed))


@verb
def top_n(t: Tbl, /, n: int, wt: Any = None) -> Tbl:
    """For each group the rows with the ``n`` greatest (or, if negative, least) weights, ties kept."""
    c = t.context("top_n")
    w = c.expression(E.Symbolic()[t.columns[-1]] if wt is None else wt)
    rank = c.over_order(F.rank(), own_order=[w.desc_nulls_last() if n > 0 else w.asc_nulls_last()]) if t.group_by else None
    if rank is None:  # no group: the n-th value by top-k, then a plain filter; no task sees all rows
        h = hidden_name()
        df = c.df.withColumn(h, w)
        edge = df.select(h).filter(F.col(h).isNotNull()).orderBy(F.col(h).desc() if n > 0 else F.col(h).asc()).limit(abs(n)).agg((F.min if n > 0 else F.max)(h).alias(f"{h}e"))
        df = df.join(F.broadcast(edge))  # one row
        return t.settle(df.filter(F.col(h) >= F.col(f"{h}e") if n > 0 else F.col(h) <= F.col(f"{h}e")), t.columns)
    h = hidden_name()
    return t.settle(c.df.withColumn(h, F.when(w.isNotNull(), rank)).filter(F.col(h) <= abs(n)), t.columns)


@verb
def distinct(t: Tbl, /, *args: Any, _keep_all: bool = False, **kwargs: Any) -> Tbl:
    """Distinct rows over the given columns (all without any); ``_keep_all`` keeps the first row of each."""
    if kwargs:
        t, _ = assign(t, "distinct", (), kwargs)
    names: list[str] = []
    for a in args:
        if isinstance(a, Across):
            t, made = assign(t, "distinct", (a,), {})
            names += made
        else:
            name = E.simple_name(a)
            if name is None:
                raise ValueError(f"distinct needs simple columns, not {E.show(a)}")
            if name not in t.columns:
                raise AttributeError(f"no column {name!r}")
            names.append(name)
    names += list(kwargs)
    if not names:
        names = t.columns
    names = [g for g in t.group_by if g not in names] + names
    if _keep_all:
        c = t.context("distinct").__class__(t.df, tuple(names), t.order_by, where="distinct")
        h = hidden_name()
        if t.order_by:
            first = c.over_order(F.row_number())
            return t.settle(c.df.withColumn(h, first).filter(F.col(h) == 1), t.columns)
        return t.with_(t.df.dropDuplicates(names))
    return Tbl(t.df.select(*map(quoted, names)).distinct(), t.group_by)


@verb
def repeat_rows(t: Tbl, /, times: Any) -> Tbl:
    """Each row as often as a number or column says."""
    c = t.context("repeat_rows")
    h = hidden_name()
    n = c.term(times).col
    return t.settle(c.df.withColumn(h, F.explode(F.array_repeat(F.lit(1), n.cast("int")))), t.columns)


@verb
def drop_missing(t: Tbl, /, *args: Any) -> Tbl:
    """Rows without nulls in the given columns (all without any)."""
    names = [o for o, _ in tidyselect(t.df, *args)] if args else t.columns
    return t.with_(t.df.dropna(subset=names))


@verb
def summary(t: Tbl, /, *args: Any) -> Tbl:
    """Count, mean, deviation, least, quartiles and greatest of each column."""
    return Tbl(t.to_spark().summary(*args))
