"""Join verbs. The plan is declared; Spark picks broadcast, hash or sort-merge and splits skewed partitions."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbena import expr as E
from verbena.table import Tbl, as_tbl, two_table_verb
from verbena.translate import hidden_name, quoted


def key_pairs(left: Tbl, right: Tbl, on: Any, infer: bool = True) -> dict[str, str]:
    """Left key to right key."""
    if on is None:
        if not infer:
            raise ValueError("the join needs on=")
        shared = [c for c in left.columns if c in right.columns]
        if not shared:
            raise ValueError("no columns in common to join on")
        warnings.warn(f"joining on the shared columns {', '.join(shared)}", stacklevel=4)
        return {c: c for c in shared}
    if isinstance(on, dict):
        pairs = {E.simple_name(k): E.simple_name(v) for k, v in on.items()}
    elif isinstance(on, (list, tuple, set)):
        pairs = {E.simple_name(c): E.simple_name(c) for c in on}
    else:
        pairs = {E.simple_name(on): E.simple_name(on)}
    if None in pairs:
        raise TypeError("join keys must be simple columns")
    for a, b in pairs.items():
        if a not in left.columns:
            raise KeyError(f"no column {a!r} in the left table")
        if b not in right.columns:
            raise KeyError(f"no column {b!r} in the right table")
    return pairs


class Side:
    """What ``sql_on`` gets for each table: columns by name."""

    def __init__(self, cols: dict[str, Column]):
        self._cols = cols

    def __getattr__(self, name: str) -> Column:
        if name not in self._cols:
            raise AttributeError(f"no column {name!r}")
        return self._cols[name]

    __getitem__ = __getattr__


def prepare(left: Tbl, right: Tbl, pairs: dict[str, str] | None, sql_on: Callable | None, na_matches: str) -> tuple[DataFrame, DataFrame, Column, dict[str, str], dict[str, str]]:
    """Both sides under unique hidden names (self joins stay clear), the condition, and the names' maps."""
    ln, rn = {c: hidden_name() for c in left.columns}, {c: hidden_name() for c in right.columns}
    ldf = left.df.select(*[quoted(c).alias(h) for c, h in ln.items()])
    rdf = right.df.select(*[quoted(c).alias(h) for c, h in rn.items()])
    if sql_on is not None:
        condition = sql_on(Side({c: F.col(h) for c, h in ln.items()}), Side({c: F.col(h) for c, h in rn.items()}))
    else:
        same = [F.col(ln[a]).eqNullSafe(F.col(rn[b])) if na_matches == "na" else F.col(ln[a]) == F.col(rn[b]) for a, b in pairs.items()]
        condition = same[0]
        for s in same[1:]:
            condition = condition & s
    return ldf, rdf, condition, ln, rn


def joined(left: Tbl, right: Any, on: Any, how: str, sql_on: Callable | None, suffixes: tuple[str, str], na_matches: str, broadcast: bool) -> Tbl:
    right = as_tbl(right)
    pairs = None if sql_on is not None else key_pairs(left, right, on)
    ldf, rdf, condition, ln, rn = prepare(left, right, pairs, sql_on, na_matches)
    df = ldf.join(F.broadcast(rdf) if broadcast else rdf, condition, how)
    pairs = pairs or {}
    dropped = set(pairs.values())
    rest = [c for c in right.columns if c not in dropped]
    clash = {c for c in left.columns if c in rest and c not in pairs}
    # a right column that is called like a left key: both are told apart
    clash |= {c for c in rest if c in pairs}
    cols = []
    for c in left.columns:
        own = F.col(ln[c])
        if c in pairs and how == "full":
            own = F.coalesce(own, F.col(rn[pairs[c]]))
        elif c in pairs and how == "right":
            own = F.col(rn[pairs[c]])
        cols.append(own.alias(c + suffixes[0] if c in clash else c))
    cols += [F.col(rn[c]).alias(c + suffixes[1] if c in clash else c) for c in rest]
    groups = tuple(g + suffixes[0] if g in clash else g for g in left.group_by)
    return Tbl(df.select(*cols), groups)


@two_table_verb
def join(left: Tbl, right: Any, on: Any = None, how: str | None = "inner", by: Any = None, sql_on: Callable | None = None, suffixes: tuple[str, str] = ("_x", "_y"), na_matches: str = "never", broadcast: bool = False) -> Tbl:
    """Join by key columns, or by any condition ``sql_on=lambda left, right: ...``.

    Null keys never match unless ``na_matches="na"``. Names that clash get suffixes; right key columns go. ``broadcast`` hints
    that the right table is small.
    """
    kinds = {"inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full"}
    if how not in kinds:
        raise ValueError(f"how must be one of {', '.join(kinds)}")
    return joined(left, right, by if on is None else on, kinds[how], sql_on, suffixes, na_matches, broadcast)


def fixed(how: str) -> Callable:
    def f(left: Tbl, right: Any, on: Any = None, by: Any = None, **kwargs: Any) -> Tbl:
        return join(left, right, on, how, by, **kwargs)

    f.__name__, f.__doc__ = f"{how}_join", f"{how.capitalize()} join; see ``join``."
    return two_table_verb(f)


inner_join, left_join, right_join, full_join = map(fixed, ("inner", "left", "right", "full"))
outer_join = full_join


def filtering(how: str, name: str, doc: str) -> Callable:
    def f(left: Tbl, right: Any, on: Any = None, by: Any = None, sql_on: Callable | None = None, na_matches: str = "never") -> Tbl:
        right = as_tbl(right)
        pairs = None if sql_on is not None else key_pairs(left, right, by if on is None else on)
        _, rdf, _, _, rn = prepare(left, right, pairs, sql_on or (lambda a, b: F.lit(True)), na_matches)
        lcols = {c: left.df[quoted_name(c)] for c in left.columns}
        if sql_on is not None:
            condition = sql_on(Side(lcols), Side({c: F.col(h) for c, h in rn.items()}))
        else:
            condition = None
            for a, b in pairs.items():
                same = lcols[a].eqNullSafe(F.col(rn[b])) if na_matches == "na" else lcols[a] == F.col(rn[b])
                condition = same if condition is None else condition & same
            rdf = rdf.select(*[rn[b] for b in dict.fromkeys(pairs.values())])  # only the keys are read and shuffled
        return left.with_(left.df.join(rdf, condition, how))

    f.__name__, f.__doc__ = name, doc
    return two_table_verb(f)


def quoted_name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


semi_join = filtering("left_semi", "semi_join", "Left rows that have a match, each once.")
anti_join = filtering("left_anti", "anti_join", "Left rows that have no match.")


def set_operation(name: str, run: Callable[[DataFrame, DataFrame], DataFrame], doc: str) -> Callable:
    def f(left: Tbl, right: Any) -> Tbl:
        r = as_tbl(right).to_spark()
        return Tbl(run(left.to_spark(), r))

    f.__name__, f.__doc__ = name, doc
    return two_table_verb(f)


bind_rows = set_operation("bind_rows", lambda a, b: a.unionByName(b, allowMissingColumns=True), "Rows of both tables, columns by name.")
union_all = set_operation("union_all", lambda a, b: a.unionByName(b), "Rows of both tables.")
union = set_operation("union", lambda a, b: a.unionByName(b).distinct(), "Distinct rows of both tables.")
intersect = set_operation("intersect", lambda a, b: a.intersect(b.select(*a.columns)), "Distinct rows that both tables have.")
setdiff = set_operation("setdiff", lambda a, b: a.subtract(b.select(*a.columns)), "Distinct rows of the left table that the right lacks.")
