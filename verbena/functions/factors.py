"""Factors: string columns with an ordered list of levels in the column's metadata.

Functions that need data for the levels run one aggregate when called; its result has a row for each level. They take a
table and a column and return the table with the column's levels set.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbena import expr as E
from verbena.functions.registry import column_function, lit
from verbena.table import Tbl, verb
from verbena.translate import quoted

KEY = "levels"
#: Most levels of a factor.
MAX_LEVELS = 100_000


def levels(data: Any, col: Any) -> list | None:
    """A column's levels, None if it is no factor."""
    df = data.df if isinstance(data, Tbl) else data
    return df.schema[E.simple_name(col)].metadata.get(KEY)


def with_levels(t: Tbl, name: str, new: list, value: Column | None = None, ordered: bool = False) -> Tbl:
    col = (quoted(name) if value is None else value).alias(name, metadata={KEY: list(new), "ordered": ordered})
    return t.with_(t.df.select(*[col if c == name else quoted(c) for c in t.df.columns]))


def found(rows: DataFrame, name: str) -> list:
    got = rows.limit(MAX_LEVELS + 1).collect()
    if len(got) > MAX_LEVELS:
        raise ValueError(f"over {MAX_LEVELS} levels")
    return [r[name] for r in got if r[name] is not None]


def current(t: Tbl, name: str) -> list:
    own = levels(t, name)
    return own if own is not None else found(t.df.select(quoted(name)).distinct().orderBy(name), name)


@verb
def fct_inorder(t: Tbl, /, col: Any, ordered: bool = False) -> Tbl:
    """Levels by first appearance in arrange order."""
    name = E.simple_name(col)
    if not t.order_by:
        raise NotImplementedError("fct_inorder needs arrange() first")
    firsts = [(F.max if k.descending else F.min)(quoted(k.name)).alias(f"__o{i}") for i, k in enumerate(t.order_by)]
    rows = t.df.groupBy(quoted(name)).agg(*firsts).orderBy(*[F.col(f"__o{i}").desc() if k.descending else F.col(f"__o{i}").asc() for i, k in enumerate(t.order_by)])
    return with_levels(t, name, found(rows, name), ordered=ordered)


@verb
def fct_infreq(t: Tbl, /, col: Any, ordered: bool = False) -> Tbl:
    """Levels by frequency, most frequent first; ties by value."""
    name = E.simple_name(col)
    return with_levels(t, name, found(t.df.groupBy(quoted(name)).count().orderBy(F.desc("count"), quoted(name)), name), ordered=ordered)


#: Summaries by name (or NumPy function name) for ``fct_reorder``.
SUMMARIES = {"median": F.median, "mean": F.avg, "average": F.avg, "min": F.min, "amin": F.min, "max": F.max, "amax": F.max, "sum": F.sum}


@verb
def fct_reorder(t: Tbl, /, col: Any, x: Any, func: Any = "median", desc: bool = False) -> Tbl:
    """Levels by a summary of another column."""
    name = E.simple_name(col)
    key = func if isinstance(func, str) else getattr(func, "__name__", "")
    if key not in SUMMARIES:
        raise NotImplementedError(f"fct_reorder can't use {func!r}")
    rows = t.df.filter(quoted(name).isNotNull()).groupBy(quoted(name)).agg(SUMMARIES[key](quoted(E.simple_name(x))).alias("__v"))
    rows = rows.orderBy(F.col("__v").desc_nulls_last() if desc else F.col("__v").asc_nulls_last(), quoted(name))
    return with_levels(t, name, found(rows, name))


@verb
def fct_rev(t: Tbl, /, col: Any) -> Tbl:
    """Levels in reverse."""
    name = E.simple_name(col)
    return with_levels(t, name, current(t, name)[::-1])


@verb
def fct_lump(t: Tbl, /, col: Any, n: int | None = None, prop: float | None = None, w: Any = None, other_level: str = "Other", ties: Any = None) -> Tbl:
    """Keep the ``n`` most (or, if negative, least) frequent levels, or those over a share; lump the others."""
    name = E.simple_name(col)
    if ties is not None:
        raise NotImplementedError("fct_lump: ties is not supported")
    if (n is None) == (prop is None):
        raise ValueError("fct_lump takes n or prop")
    weight = F.count(F.lit(1)) if w is None else F.sum(quoted(E.simple_name(w)))
    sizes = t.df.filter(quoted(name).isNotNull()).groupBy(quoted(name)).agg(weight.alias("__w"))
    if n is not None:
        kept = found(sizes.orderBy(F.desc("__w") if n > 0 else F.asc("__w"), quoted(name)).limit(abs(n)), name)
    else:
        total = sizes.agg(F.sum("__w")).first()[0] or 0
        kept = found(sizes.filter(F.col("__w") > F.lit(prop) * F.lit(total)).orderBy(quoted(name)), name)
    kept = sorted(kept)
    value = F.when(quoted(name).isNull(), None).when(quoted(name).isin(*kept), quoted(name)).otherwise(other_level)
    return with_levels(t, name, [*kept, other_level], value)


def mapped(x: Any, pairs: list[tuple[list, str]], other: str | None) -> Column:
    x = lit(x)
    out = F
    for olds, new in pairs:
        out = out.when(x.isin(*olds), new)
    if out is F:
        return x
    return out.otherwise(x if other is None else F.when(x.isNotNull(), other))


@column_function("elwise")
def fct_recode(c, x, recat=None, **kwargs):
    """``new="old"``: rename levels."""
    both = {**(recat or {}), **kwargs}
    if recat and set(recat) & set(kwargs):
        raise ValueError("a level is named twice")
    pairs = [([old] if isinstance(old, str) else list(old), new) for new, old in both.items()]
    return releveled(c, x, pairs, None)


@column_function("elwise")
def fct_collapse(c, x, recat, group_other=None):
    """``{new: [old, ...]}``: many levels to one; others stay or go to ``group_other``."""
    olds = [o for v in recat.values() for o in ([v] if isinstance(v, str) else v)]
    if len(olds) != len(set(olds)):
        raise ValueError("a level is assigned twice")
    return releveled(c, x, [([v] if isinstance(v, str) else list(v), k) for k, v in recat.items()], group_other)


def releveled(c: Any, x: Any, pairs: list[tuple[list, str]], other: str | None) -> Column:
    """The mapped column; a factor's levels are mapped too, those put in ``other`` last."""
    out = mapped(x, pairs, other)
    field = c.df.select(lit(x)).schema[0]
    if KEY not in field.metadata:
        return out
    to = {old: new for olds, new in pairs for old in olds}
    own = [to.get(v, v if other is None else other) for v in field.metadata[KEY]]
    kept = [v for v in dict.fromkeys(own) if v != other] + [other] * (other in own and other is not None)
    return out.alias("x", metadata={KEY: kept, "ordered": bool(field.metadata.get("ordered"))})


def level_place(df: DataFrame, name: str) -> Column:
    """The place of each value among the levels, for sorting; nulls and unknown values have none."""
    own = df.schema[name].metadata.get(KEY) or []
    at = F.array_position(F.array(*map(F.lit, own)), quoted(name))
    return F.when(at > 0, at - 1)
